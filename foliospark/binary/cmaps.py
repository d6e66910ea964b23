"""Character maps: ToUnicode streams, predefined CMaps from a folder, and CID to text by inverting Unicode ones."""

from __future__ import annotations

import functools
import re
from pathlib import Path

from .syntax import Keyword, Lexer, Name, PdfError

SPAN_LIMIT = 1 << 16


def _utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace") if len(raw) > 1 else raw.decode("latin-1")


class ToUnicode:
    """code (an integer of any width) to text."""

    def __init__(self, data: bytes):
        self.chars: dict[int, str] = {}
        self.ranges: list[tuple[int, int, object]] = []
        stack: list = []
        lex = Lexer(data, refs=False)
        while True:
            try:
                v = lex.value()
            except EOFError:
                break
            except PdfError:
                lex.at += 1
                continue
            if not isinstance(v, Keyword):
                stack.append(v)
                continue
            if v == b"endbfchar":
                for code, text in zip(stack[::2], stack[1::2], strict=False):
                    if isinstance(code, bytes) and isinstance(text, bytes):
                        self.chars[int.from_bytes(code, "big")] = _utf16(text)
            elif v == b"endbfrange":
                for lo, hi, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                    if isinstance(lo, bytes) and isinstance(hi, bytes):
                        self.ranges.append((int.from_bytes(lo, "big"), int.from_bytes(hi, "big"), to))
            stack = []

    def get(self, code: int) -> str | None:
        if code in self.chars:
            return self.chars[code]
        for lo, hi, to in self.ranges:
            if lo <= code <= hi:
                if isinstance(to, list):
                    return _utf16(to[code - lo]) if code - lo < len(to) and isinstance(to[code - lo], bytes) else None
                text = _utf16(to)
                try:
                    return text[:-1] + chr(ord(text[-1]) + code - lo) if text else None
                except ValueError:
                    return None
        return None


class CMap:
    """Codes of 1 to 4 bytes to CIDs; ``parent`` is asked where a code is not found."""

    def __init__(self):
        self.spaces: list[tuple[int, bytes, bytes]] = []
        self.chars: dict[tuple[int, int], int] = {}
        self.ranges: list[tuple[int, int, int, int]] = []
        self.notdef: list[tuple[int, int, int, int]] = []
        self.parent: CMap | None = None
        self.use: str | None = None
        self.vertical = False

    def split(self, raw: bytes) -> list[bytes]:
        """Codes by the shortest prefix in a code space; a byte that begins none is dropped."""
        out, k, spaces = [], 0, self.code_spaces()
        while k < len(raw):
            for n in range(1, 5):
                code = raw[k : k + n]
                if len(code) == n and any(s == n and all(a <= c <= b for a, c, b in zip(lo, code, hi, strict=True)) for s, lo, hi in spaces):
                    out.append(code)
                    k += n
                    break
            else:
                k += 1
        return out

    def code_spaces(self) -> list[tuple[int, bytes, bytes]]:
        return self.spaces or (self.parent.code_spaces() if self.parent else [])

    def cid(self, code: bytes) -> int | None:
        n, c = len(code), int.from_bytes(code, "big")
        if (n, c) in self.chars:
            return self.chars[n, c]
        for table in (self.ranges, self.notdef):
            for size, lo, hi, to in table:
                if size == n and lo <= c <= hi:
                    return to + c - lo
        return self.parent.cid(code) if self.parent else None


def parse_cmap(data: bytes) -> CMap:
    out, stack, lex = CMap(), [], Lexer(data, refs=False)
    while True:
        try:
            v = lex.value()
        except EOFError:
            return out
        except PdfError:
            lex.at += 1
            continue
        if not isinstance(v, Keyword):
            stack.append(v)
            continue
        if v == b"usecmap" and stack and isinstance(stack[-1], Name):
            out.use = str(stack[-1])
        elif v == b"def" and len(stack) >= 2 and stack[-2] == "WMode":
            out.vertical = stack[-1] == 1
        elif v == b"endcodespacerange":
            out.spaces += [(len(a), bytes(a), bytes(b)) for a, b in zip(stack[::2], stack[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)]
        elif v in (b"endcidchar", b"endnotdefchar"):
            for code, cid in zip(stack[::2], stack[1::2], strict=False):
                if isinstance(code, bytes) and isinstance(cid, int):
                    key = (len(code), int.from_bytes(code, "big"))
                    if v == b"endcidchar":
                        out.chars[key] = cid
                    else:
                        out.notdef.append((key[0], key[1], key[1], cid))
        elif v in (b"endcidrange", b"endnotdefrange"):
            to = out.ranges if v == b"endcidrange" else out.notdef
            for lo, hi, cid in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                if isinstance(lo, bytes) and isinstance(hi, bytes) and isinstance(cid, int):
                    to.append((len(lo), int.from_bytes(lo, "big"), int.from_bytes(hi, "big"), cid))
        stack = [] if v not in (b"dict", b"begin", b"dup") else stack


@functools.lru_cache(maxsize=64)
def predefined(name: str, folder: str | None, above: tuple[str, ...] = ()) -> CMap | None:
    """A CMap by name from a folder of CMap files; Identity needs none. None where there is no such file."""
    if name in ("Identity-H", "Identity-V"):
        out = CMap()
        out.spaces, out.ranges, out.vertical = [(2, b"\0\0", b"\xff\xff")], [(2, 0, 0xFFFF, 0)], name.endswith("V")
        return out
    if name in above:
        raise PdfError("cmap_cycle", name)
    if not folder or not re.fullmatch(r"[A-Za-z0-9\-]+", name):
        return None
    path = Path(folder) / name
    if not path.is_file():
        return None
    out = parse_cmap(path.read_bytes())
    if out.use:
        out.parent = predefined(out.use, folder, (*above, name))
    return out


#: The Unicode CMap of each character collection (fixed names).
UNICODE_CMAPS = {"Japan1": "UniJIS-UTF16-H", "CNS1": "UniCNS-UTF16-H", "Korea1": "UniKS-UTF16-H", "GB1": "UniGB-UTF16-H"}


@functools.lru_cache(maxsize=8)
def cid_texts(ordering: str, folder: str | None) -> dict[int, str]:
    """CID to text of a collection, from its Unicode CMap turned round; the lowest code of a CID counts."""
    m = predefined(UNICODE_CMAPS.get(ordering, ""), folder)
    out: dict[int, str] = {}
    while m is not None:
        pairs = [((n, c), cid) for (n, c), cid in m.chars.items()]
        pairs += [((n, c), cid + c - lo) for n, lo, hi, cid in m.ranges for c in range(lo, min(hi, lo + SPAN_LIMIT) + 1)]
        for (n, c), cid in sorted(pairs):
            if cid not in out:
                out[cid] = c.to_bytes(n, "big").decode("utf-16-be", "ignore")
        m = m.parent
    return out
