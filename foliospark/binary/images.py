"""Raster images: size and kind, PNG and JPEG heads, PNG writing."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from . import filters
from .document import Document
from .syntax import PdfError, Stream


def jpeg_size(data: bytes) -> tuple[int, int, int] | None:
    """width, height, components from the start-of-frame marker."""
    k = 2
    if data[:2] != b"\xff\xd8":
        return None
    while k + 9 < len(data):
        if data[k] != 0xFF:
            k += 1
            continue
        marker = data[k + 1]
        if marker == 0xFF:
            k += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w, n = struct.unpack(">HHB", data[k + 5 : k + 10])
            return w, h, n
        elif marker in (0x01, *range(0xD0, 0xD9)):
            k += 2
        else:
            k += 2 + struct.unpack(">H", data[k + 2 : k + 4])[0]
    return None


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def color_type(size: int, width: int, height: int) -> tuple[int, int] | None:
    """(PNG colour type, bytes per pixel) by the bytes per pixel: 1 grey, 2 with alpha, 3 RGB, 4 with alpha."""
    if width <= 0 or height <= 0 or size % (width * height):
        return None
    n = size // (width * height)
    return {1: (0, 1), 2: (4, 2), 3: (2, 3), 4: (6, 4)}.get(n)


def encode_png(pixels: bytes, width: int, height: int) -> bytes:
    found = color_type(len(pixels), width, height)
    if not found:
        raise PdfError("unsupported_pixels", f"{len(pixels)} bytes for {width} x {height}")
    kind, n = found
    rows = np.frombuffer(pixels, np.uint8).reshape(height, width * n)
    body = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(body)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> dict:
    """width, height, bits, kind (colour type), palette, transparency, and the compressed rows as they stand."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise PdfError("not_a_png")
    out, k, idat = {"palette": b"", "alpha": b""}, 8, []
    while k + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[k : k + 8])
        body = data[k + 8 : k + 8 + size]
        if kind == b"IHDR":
            out["width"], out["height"], out["bits"], out["kind"], _, _, out["interlace"] = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            out["palette"] = body
        elif kind == b"tRNS":
            out["alpha"] = body
        elif kind == b"IDAT":
            idat.append(body)
        k += 12 + size
    out["data"] = b"".join(idat)
    return out


def split_alpha(png: dict) -> tuple[bytes, bytes]:
    """Colour and alpha rows of a picture of kind 4 or 6, both unfiltered."""
    colors = 2 if png["kind"] == 4 else 4
    raw = filters.flate(png["data"], {"Predictor": 15, "Colors": colors, "BitsPerComponent": 8, "Columns": png["width"]})
    px = np.frombuffer(raw, np.uint8).reshape(-1, colors)
    return px[:, :-1].tobytes(), px[:, -1].tobytes()


def decompose(ctm: tuple) -> tuple[float, float, float]:
    a, b, c, d = ctm[:4]
    return math.hypot(a, b), math.hypot(c, d), math.atan2(b, a)


def image_row(doc: Document, event) -> dict | None:
    """kind jpeg (bytes as they stand) or pixels (decoded); None for what is not supported."""
    s: Stream = event.image
    get = lambda *names: next((doc.resolve(s.dict[n]) for n in names if n in s.dict), None)
    chain = filters.chain_of({k: doc.resolve(v) for k, v in s.dict.items() if k in ("Filter", "DecodeParms")})
    names = [n for n, _ in chain]
    try:
        if names and names[-1] in ("DCTDecode", "DCT"):
            kind, data = "jpeg", filters.decode(s.raw, chain[:-1])
        elif names and names[-1] in ("JPXDecode", "JBIG2Decode", "CCITTFaxDecode", "CCF"):
            return None
        else:
            kind, data = "pixels", doc.stream_bytes(s)
    except PdfError:
        if not doc.recover:
            raise
        return None
    w, h, r = decompose(event.ctm)
    width, height = get("Width", "W"), get("Height", "H")
    if kind == "jpeg" and not (width and height) and (size := jpeg_size(data)):
        width, height = size[:2]
    return {"kind": kind, "bytes": data, "x": event.ctm[4], "y": event.ctm[5], "width": width, "height": height, "render_width": w, "render_height": h, "rotation": r, "ctm": list(event.ctm), "ref": f"{event.ref.n} {event.ref.g}" if event.ref else None}
