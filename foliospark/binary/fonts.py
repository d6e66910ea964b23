"""Fonts of a page: bytes to text with markers for what has none, and bytes to glyph widths."""

from __future__ import annotations

import codecs
import functools
from collections.abc import Callable

from . import cmaps, encodings
from .document import Document
from .syntax import PdfError, Stream

LOST = "�"
Decoder = Callable[[bytes], tuple[str, list[tuple[int, str]]]]


class Font:
    """``decode``: bytes to (text, [(place, marker)]). ``widths``: bytes to thousandths of the size, one per code."""

    def __init__(self, decode: Decoder, widths: Callable[[bytes], list[float]], wide: bool = False):
        self.decode, self.widths, self.wide = decode, widths, wide


def lost(raw: bytes) -> tuple[str, list[tuple[int, str]]]:
    return LOST * len(raw), [(i, f"byte:0x{b:02X}") for i, b in enumerate(raw)]


#: For a font that is not in the resources.
DEFAULT = Font(lambda raw: (raw.decode("latin-1"), []), lambda raw: [500.0] * len(raw))


def _number(v, other: float) -> float:
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else other


def load(doc: Document, d: dict, cmap_dir: str | None = None, base: str | None = None) -> Font:
    """The font of a resource. ``base``: the encoding of a simple font that names none (default: no text without ToUnicode)."""
    if not isinstance(d, dict):
        raise PdfError("malformed", "a font is no dictionary")
    s = doc.resolve(d.get("ToUnicode"))
    to_unicode = cmaps.ToUnicode(doc.stream_bytes(s)) if isinstance(s, Stream) else None
    if str(d.get("Subtype")) == "Type0":
        return _composite(doc, d, to_unicode, cmap_dir)
    return _simple(doc, d, to_unicode, base)


def _simple(doc: Document, d: dict, to_unicode, base: str | None) -> Font:
    enc = doc.resolve(d.get("Encoding"))
    names: dict[int, str] = {}
    if isinstance(enc, dict):
        base = str(doc.resolve(enc.get("BaseEncoding"))) if "BaseEncoding" in enc else base
        items = doc.resolve(enc.get("Differences"))
        names = encodings.differences([doc.resolve(x) for x in items]) if isinstance(items, list) else {}
    elif enc is not None:
        base = str(enc)
    table = encodings.table(base)
    plain = None if to_unicode or names else _charmap(tuple(table))

    def decode(raw: bytes):
        if plain:
            try:
                return codecs.charmap_decode(raw, "strict", plain)[0], []
            except UnicodeDecodeError:
                pass  # a byte without a text: one by one
        out, bad = [], []
        for i, b in enumerate(raw):
            c = to_unicode.get(b) if to_unicode else None
            if c is None and b in names:  # a name that is given is never replaced by the base encoding
                c = encodings.glyph(names[b])
                marker = names[b]
            elif c is None:
                c, marker = table[b], f"byte:0x{b:02X}"
            if c is None:
                bad.append((i, marker))
                c = LOST
            out.append(c)
        return "".join(out), bad

    widths = doc.resolve(d.get("Widths"))
    desc = doc.resolve(d.get("FontDescriptor"))
    first = int(_number(doc.resolve(d.get("FirstChar")), 0))
    missing = _number(doc.resolve(desc.get("MissingWidth")), 0.0) if isinstance(desc, dict) else 0.0
    known = [float(w) if type(w) is int else _number(doc.resolve(w), missing) for w in widths] if isinstance(widths, list) else None

    def measure(raw: bytes) -> list[float]:
        if known is None:
            return [500.0] * len(raw)
        return [known[b - first] if 0 <= b - first < len(known) else missing for b in raw]

    return Font(decode, measure)


@functools.lru_cache(maxsize=64)
def _charmap(table: tuple[str | None, ...]) -> str | None:
    """The table as codecs take it (U+FFFE: no text), or None where a byte has more than one character."""
    return "".join(c or "\ufffe" for c in table) if all(c is None or len(c) == 1 for c in table) else None


def _composite(doc: Document, d: dict, to_unicode, cmap_dir: str | None) -> Font:
    kids = doc.resolve(d.get("DescendantFonts"))
    child = doc.resolve(kids[0]) if isinstance(kids, list) and kids else {}
    child = child if isinstance(child, dict) else {}
    info = doc.resolve(child.get("CIDSystemInfo"))
    ordering = info.get("Ordering", b"") if isinstance(info, dict) else b""
    ordering = bytes(doc.resolve(ordering) or b"").decode("latin-1")
    enc = doc.resolve(d.get("Encoding"))
    if isinstance(enc, Stream):
        cmap = cmaps.parse_cmap(doc.stream_bytes(enc))
        if cmap.use:
            cmap.parent = cmaps.predefined(cmap.use, cmap_dir)
    else:
        cmap = cmaps.predefined(str(enc), cmap_dir)
        if cmap is None:
            raise PdfError("unknown_cmap", str(enc))
    texts = cmaps.cid_texts(ordering, cmap_dir) if ordering in cmaps.UNICODE_CMAPS else {}

    def decode(raw: bytes):
        out, bad, place = [], [], 0
        for code in cmap.split(raw):
            cid = cmap.cid(code)
            c = to_unicode.get(int.from_bytes(code, "big")) if to_unicode else None
            if c is None and cid is not None:
                c = texts.get(cid)
            if c is None:
                bad.append((place, f"cid:0x{cid if cid is not None else int.from_bytes(code, 'big'):04X}"))
                c = LOST
            out.append(c)
            place += len(c)
        return "".join(out), bad

    default = _number(doc.resolve(child.get("DW")), 1000.0)
    known, spans = _cid_widths(doc, doc.resolve(child.get("W")))

    def measure(raw: bytes) -> list[float]:
        out = []
        for code in cmap.split(raw):
            cid = cmap.cid(code)
            w = known.get(cid)
            if w is None:
                w = next((x for lo, hi, x in spans if cid is not None and lo <= cid <= hi), default)
            out.append(w)
        return out

    return Font(decode, measure, wide=True)


def _cid_widths(doc: Document, w) -> tuple[dict[int, float], list[tuple[int, int, float]]]:
    """Both forms of /W: first [w1 w2 ...], and first last w."""
    known, spans, k = {}, [], 0
    w = [doc.resolve(x) for x in w] if isinstance(w, list) else []
    while k + 1 < len(w):
        if isinstance(w[k + 1], list):
            for i, x in enumerate(w[k + 1]):
                known[int(w[k]) + i] = _number(doc.resolve(x), 0.0)
            k += 2
        elif k + 2 < len(w):
            spans.append((int(w[k]), int(w[k + 1]), _number(w[k + 2], 0.0)))
            k += 3
        else:
            break
    return known, spans


def of_resources(doc: Document, resources: dict, cmap_dir: str | None, base: str | None, failed: Callable[[str, str], None]) -> dict[str, Font]:
    """All fonts of a page's resources. In recovery a font that fails gives U+FFFD for each byte and is reported."""
    fonts = doc.resolve(resources.get("Font"))
    out: dict[str, Font] = {}
    for name, v in fonts.items() if isinstance(fonts, dict) else ():
        try:
            out[name] = load(doc, doc.resolve(v), cmap_dir, base)
        except (PdfError, EOFError, ValueError, TypeError, KeyError) as e:
            if not doc.recover:
                raise PdfError(getattr(e, "code", "font_failed"), str(e)) from None
            out[name] = Font(lost, lambda raw: [500.0] * len(raw))
            failed(name, str(e))
    return out
