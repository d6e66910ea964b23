"""Stream filters, each bytes and parameters to bytes, and their chain. ``FILTERS`` may be extended."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np

from .syntax import Name, PdfError


def flate(data: bytes, parms: dict) -> bytes:
    unpack = zlib.decompressobj()
    try:
        out = unpack.decompress(data) + unpack.flush()
    except zlib.error as e:
        raise PdfError("filter_failed", f"FlateDecode: {e}") from None
    return unpredict(out, parms)


def unpredict(data: bytes, parms: dict) -> bytes:
    """Undoes a predictor; distances are whole pixels."""
    kind = parms.get("Predictor", 1)
    if kind in (None, 1):
        return data
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    bpp, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        if bits != 8:
            raise PdfError("filter_failed", f"TIFF predictor of {bits} bits")
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    if not 10 <= kind <= 15:
        raise PdfError("filter_failed", f"predictor {kind}")
    out, above = bytearray(), np.zeros(width, np.uint8)
    for k in range(0, len(data), width + 1):
        line = np.zeros(width, np.uint8)
        got = np.frombuffer(data[k + 1 : k + 1 + width], np.uint8)
        line[: len(got)] = got
        above = _unfilter(data[k], line, above, bpp)
        out += above[: len(got)].tobytes()
    return bytes(out)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1 and len(line) % bpp == 0:
        return np.cumsum(line.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()
    x, up = line.tolist(), above.tolist()
    for i in range(len(x)):
        left = x[i - bpp] if i >= bpp else 0
        if kind == 1:
            x[i] = (x[i] + left) & 255
        elif kind == 3:
            x[i] = (x[i] + (left + up[i]) // 2) & 255
        elif kind == 4:
            corner = up[i - bpp] if i >= bpp else 0
            guess = left + up[i] - corner
            a, b, c = abs(guess - left), abs(guess - up[i]), abs(guess - corner)
            x[i] = (x[i] + (left if a <= b and a <= c else up[i] if b <= c else corner)) & 255
        else:
            raise PdfError("filter_failed", f"row filter {kind}")
    return np.array(x, np.uint8)


def lzw(data: bytes, parms: dict) -> bytes:
    """Codes of 9 to 12 bits; 256 clears the table, 257 ends, new ones count from 258."""
    early = parms.get("EarlyChange", 1)
    table: list[bytes] = []
    out, width, bits, held, last = [], 9, 0, 0, b""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table = base[:]
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = base[:], 9, b""
            continue
        if code < len(table):
            piece = table[code]
        elif code == len(table) and last:
            piece = last + last[:1]
        else:
            raise PdfError("filter_failed", f"LZWDecode: code {code}")
        out.append(piece)
        if last and len(table) < 4096:
            table.append(last + piece[:1])
        last = piece
        width = min(12, max(9, (len(table) + early).bit_length()))
    return unpredict(b"".join(out), parms)


def ascii85(data: bytes, parms: dict) -> bytes:
    body = re.sub(rb"\s", b"", data.split(b"~>", 1)[0]).removeprefix(b"<~")
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
            continue
        if not 33 <= c <= 117:
            raise PdfError("filter_failed", f"ASCII85Decode: byte {c}")
        group.append(c - 33)
        if len(group) == 5:
            out += _quad(group)
            group = []
    if len(group) > 1:
        out += _quad(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _quad(group: list[int]) -> bytes:
    n = 0
    for d in group:
        n = n * 85 + d
    if n >> 32:
        raise PdfError("filter_failed", "ASCII85Decode: a group is too large")
    return n.to_bytes(4, "big")


def ascii_hex(data: bytes, parms: dict) -> bytes:
    body = re.sub(rb"\s", b"", data.split(b">", 1)[0])
    if re.search(rb"[^0-9A-Fa-f]", body):
        raise PdfError("filter_failed", "ASCIIHexDecode: not a digit")
    return bytes.fromhex((body + b"0" * (len(body) % 2)).decode())


def run_length(data: bytes, parms: dict) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        if n == 128:
            break
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        else:
            out += data[k + 1 : k + 2] * (257 - n)
            k += 2
    return bytes(out)


FILTERS: dict[str, Callable[[bytes, dict], bytes]] = {
    "FlateDecode": flate, "Fl": flate, "LZWDecode": lzw, "LZW": lzw, "ASCII85Decode": ascii85, "A85": ascii85,
    "ASCIIHexDecode": ascii_hex, "AHx": ascii_hex, "RunLengthDecode": run_length, "RL": run_length, "Crypt": lambda data, parms: data,
}


def chain_of(d: dict) -> list[tuple[str, dict]]:
    """(filter, parameters) of a stream's dictionary; missing parameters are empty."""
    names = d.get("Filter", d.get("F"))
    names = [] if names is None else names if isinstance(names, list) else [names]
    parms = d.get("DecodeParms", d.get("DP"))
    parms = parms if isinstance(parms, list) else [parms]
    return [(str(n), (parms[k] if k < len(parms) and isinstance(parms[k], dict) else {})) for k, n in enumerate(names) if isinstance(n, Name)]


def decode(data: bytes, chain: list[tuple[str, dict]]) -> bytes:
    for name, parms in chain:
        if name not in FILTERS:
            raise PdfError("unsupported_filter", name)
        data = FILTERS[name](data, parms)
    return data
