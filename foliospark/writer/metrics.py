"""Glyph widths: three faces built in for ASCII, all others from AFM files in a folder."""

from __future__ import annotations

import codecs
import functools
import re
import unicodedata
from pathlib import Path

from ..binary.encodings import glyph, table

#: Advance widths of ASCII 32 to 126 in thousandths (fixed values of the standard faces).
HELVETICA = (278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584)
HELVETICA_BOLD = (278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 333, 333, 584, 584, 584, 611, 975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556, 333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584)
TIMES = (250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, *[500] * 10, 278, 278, 564, 564, 564, 444, 921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500, 333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541)
FACES = [f"{a}{b}" for a, bs in (("Helvetica", ("", "-Bold", "-Oblique", "-BoldOblique")), ("Courier", ("", "-Bold", "-Oblique", "-BoldOblique")), ("Times-", ("Roman", "Bold", "Italic", "BoldItalic"))) for b in bs] + ["Symbol", "ZapfDingbats"]


class Metrics:
    """Widths by character and kerning by pair of characters."""

    def __init__(self, name: str, widths: dict[str, int], kerns: dict[tuple[str, str], int] | None = None, default: int = 556):
        self.name, self.widths, self.kerns, self.default = name, widths, kerns or {}, default

    def width(self, c: str) -> int:
        w = self.widths.get(c)
        if w is None:
            base = unicodedata.normalize("NFD", c)[:1]  # a letter with a mark is as wide as the letter
            w = self.widths.get(base, self.default)
        return w

    def text_width(self, text: str, size: float, kerning: bool = False) -> float:
        total = sum(map(self.width, text))
        if kerning:
            total += sum(self.kerns.get(p, 0) for p in zip(text, text[1:], strict=False))
        return total * size / 1000

    def kerned(self, text: str) -> list[str | int]:
        """Pieces of text and the adjustments between them, as TJ takes them."""
        out: list[str | int] = []
        piece = text[:1]
        for a, b in zip(text, text[1:], strict=False):
            if k := self.kerns.get((a, b), 0):
                out += [piece, -k]
                piece = ""
            piece += b
        return [*out, piece] if piece else out


def parse_afm(data: str, name: str = "") -> Metrics:
    found = re.search(r"^FontName\s+(\S+)", data, re.M)
    widths = {c: int(float(w)) for w, n in re.findall(r"^C\s+-?\d+\s*;\s*WX\s+(-?[\d.]+)\s*;\s*N\s+(\S+)", data, re.M) if (c := glyph(n)) and len(c) == 1}
    kerns = {(a, b): int(float(k)) for x, y, k in re.findall(r"^KPX\s+(\S+)\s+(\S+)\s+(-?[\d.]+)", data, re.M) if (a := glyph(x)) and (b := glyph(y))}
    return Metrics(found[1] if found else name, widths, kerns)


@functools.lru_cache(maxsize=64)
def load(name: str, folder: str | None = None) -> Metrics:
    """Metrics of a face from ``folder``/name.afm, else from the built-in ones of its family."""
    if folder and (path := Path(folder) / f"{name}.afm").is_file():
        return parse_afm(path.read_text("latin-1"), name)
    if name.startswith("Courier"):
        return Metrics(name, {}, default=600)
    known = TIMES if name.startswith("Times") else HELVETICA_BOLD if "Bold" in name else HELVETICA
    return Metrics(name, {chr(32 + k): w for k, w in enumerate(known)})


@functools.cache
def _win() -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(table("WinAnsiEncoding")))) if c is not None}


def encode_win_ansi(text: str, replacement: str | None = None) -> bytes:
    """Bytes of the composed text. A character that has none raises, or is replaced."""
    composed = unicodedata.normalize("NFC", text)
    try:
        return codecs.charmap_encode(composed, "strict", _win_codes())[0]
    except UnicodeEncodeError as e:
        if replacement is None:
            raise ValueError(f"no WinAnsi byte for {composed[e.start]!r}") from None
    known, other = _win(), encode_win_ansi(replacement)
    return b"".join(known[c].to_bytes() if c in known else other for c in composed)


@functools.cache
def _win_codes() -> dict[int, int]:
    return {ord(c): b for c, b in _win().items()}


@functools.lru_cache(maxsize=64)
def win_ansi_widths(name: str, folder: str | None = None) -> tuple[int, ...]:
    """Widths of bytes 32 to 255."""
    m, codes = load(name, folder), table("WinAnsiEncoding")
    return tuple(m.width(codes[b] or " ") for b in range(32, 256))
