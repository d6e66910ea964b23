"""A document under construction: pages of drawing commands, fonts, images, styles, templates, and its bytes."""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import math
import os
import zlib
from collections.abc import Callable

from ..binary import crypt, images
from ..binary.syntax import Ref
from . import metrics
from .text import wrap

#: Page sizes in points (fixed values).
SIZES = {"a3": (842, 1191), "a4": (595, 842), "a5": (420, 595), "a6": (298, 420), "letter": (612, 792), "legal": (612, 1008), "tabloid": (792, 1224)}
#: Colours by name, red, green and blue from 0 to 255 (fixed values).
COLORS = {"black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0), "cyan": (0, 255, 255), "magenta": (255, 0, 255), "gray": (128, 128, 128), "grey": (128, 128, 128), "silver": (192, 192, 192), "maroon": (128, 0, 0), "olive": (128, 128, 0), "lime": (0, 255, 0), "aqua": (0, 255, 255), "teal": (0, 128, 128), "navy": (0, 0, 128), "fuchsia": (255, 0, 255), "purple": (128, 0, 128), "orange": (255, 165, 0)}


def color(c) -> tuple[float, ...]:
    """A name, '#rrggbb', three bytes or shares, or four shares (CMYK), as shares."""
    if isinstance(c, str):
        c = tuple(int(c[k : k + 2], 16) for k in (1, 3, 5)) if c.startswith("#") else COLORS[c.lower()]
    c = tuple(c)
    if len(c) == 4:
        return tuple(map(float, c))
    return tuple(x / 255 if any(isinstance(v, int) and v > 1 for v in c) else float(x) for x in c)


def num(x: float) -> str:
    s = f"{x:.4f}".rstrip("0").rstrip(".")
    return "0" if s in ("-0", "") else s


def literal(raw: bytes) -> bytes:
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


class Widths(tuple):
    """Whole numbers that many files share; they are written once."""

    __slots__ = ()


@functools.lru_cache(maxsize=64)
def _widths(v: Widths) -> bytes:
    return b"[" + b" ".join(b"%d" % x for x in v) + b"]"


@functools.lru_cache(maxsize=4096)
def _name(v: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"#/()<>[]{}%" else b"#%02X" % c for c in v.encode())


def serialize(v) -> bytes:
    """A value as it is written: str is a name, bytes a string."""
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, Ref):
        return b"%d %d R" % v
    if isinstance(v, (int, float)):
        return num(v).encode()
    if isinstance(v, str):
        return _name(str(v))
    if isinstance(v, Widths):
        return _widths(v)
    if isinstance(v, bytes):
        return literal(v)
    if isinstance(v, dt.datetime):
        return literal(date(v).encode())
    if isinstance(v, dt.date):
        return literal(v.strftime("D:%Y%m%d").encode())
    if isinstance(v, (list, tuple)):
        return b"[" + b" ".join(map(serialize, v)) + b"]"
    if isinstance(v, dict):
        return b"<<" + b" ".join(serialize(k) + b" " + serialize(x) for k, x in v.items()) + b">>"
    raise TypeError(type(v).__name__)


def date(d: dt.datetime) -> str:
    out = d.strftime("D:%Y%m%d%H%M%S")
    off = d.utcoffset()
    if off is None:
        return out
    m = int(off.total_seconds() // 60)
    return out + ("Z" if m == 0 else f"{'+' if m > 0 else '-'}{abs(m) // 60:02d}'{abs(m) % 60:02d}")


def text_string(s: str) -> bytes:
    """ASCII as it stands, other text as UTF-16BE behind its mark."""
    return s.encode() if s.isascii() else b"\xfe\xff" + s.encode("utf-16-be")


class Page:
    def __init__(self, size: tuple[float, float]):
        self.size, self.ops, self.annots = size, [], []


class Pdf:
    """Coordinates are points from the lower left. The cursor is a height from which ``text`` and others go down."""

    def __init__(self, size="a4", margin=0, *, compress: bool = True, metrics_dir: str | None = None, version: str = "1.7"):
        self.page_size = SIZES[size] if isinstance(size, str) else tuple(size)
        m = (margin,) * 4 if isinstance(margin, (int, float)) else tuple(margin[k] for k in ("top", "right", "bottom", "left")) if isinstance(margin, dict) else tuple(margin)
        self.margin, self.compress, self.metrics_dir, self.version = m, compress, metrics_dir, version
        self.pages: list[Page] = []
        self.info: dict = {}
        self.fonts: dict[str, str] = {}
        self.images: dict[str, tuple[str, dict]] = {}
        self.alphas: dict[tuple, str] = {}
        self.styles: dict[str, dict] = {}
        self.templates: dict[str, Callable] = {}
        self.outline: list[tuple[int, str, int]] = []
        self.fields: list[dict] = []
        self.autoprint = False
        self.xmp: str | None = None
        self.font, self.font_size, self.leading, self.char_spacing = "Helvetica", 12.0, None, 0.0
        self._filling = (0.0, 0.0, 0.0)
        self.add_page(size)

    # pages and cursor

    @property
    def page(self) -> Page:
        return self.pages[-1]

    def add_page(self, size=None) -> Pdf:
        if self.pages and "footer" in self.templates:
            self._template("footer")
        self.pages.append(Page(self.page_size if size is None else SIZES[size] if isinstance(size, str) else tuple(size)))
        area = self.content_area()
        self.cursor, self.cursor_x = area["y"] + area["height"], area["x"]
        for name in ("background", "watermark", "header"):
            if name in self.templates:
                self._template(name)
        return self

    page_break = add_page

    def _template(self, name: str) -> None:
        held = self.cursor, self.cursor_x, self.font, self.font_size
        self.templates[name](self, {"number": len(self.pages), "size": self.page.size})
        self.cursor, self.cursor_x, self.font, self.font_size = held

    def on_page(self, name: str, draw: Callable) -> Pdf:
        if name not in ("header", "footer", "background", "watermark"):
            raise ValueError(f"no page template {name!r}")
        self.templates[name] = draw
        return self

    def page_number(self) -> int:
        return len(self.pages)

    def size(self) -> tuple[float, float]:
        return self.page.size

    def content_area(self) -> dict:
        w, h = self.page.size
        t, r, b, left = self.margin
        return {"x": left, "y": b, "width": w - left - r, "height": h - t - b}

    def set_cursor(self, y: float, x: float | None = None) -> Pdf:
        self.cursor = y
        if x is not None:
            self.cursor_x = x
        return self

    def set_cursor_x(self, x: float) -> Pdf:
        self.cursor_x = x
        return self

    def cursor_xy(self) -> tuple[float, float]:
        return self.cursor_x, self.cursor

    def move_down(self, by: float) -> Pdf:
        self.cursor -= by
        return self

    spacer = move_down

    def move_right(self, by: float) -> Pdf:
        self.cursor_x += by
        return self

    def reset_x(self) -> Pdf:
        self.cursor_x = self.content_area()["x"]
        return self

    def room(self, height: float) -> Pdf:
        """A new page if ``height`` does not fit under the cursor."""
        area = self.content_area()
        if self.cursor - height < area["y"] - 1e-6 and height <= area["height"]:
            self.add_page()
        return self

    # information

    def set_info(self, **items) -> Pdf:
        """title, author, subject, keywords, creator, producer, created, modified."""
        keys = {"created": "CreationDate", "modified": "ModDate"}
        for k, v in items.items():
            self.info[keys.get(k, k.capitalize())] = text_string(v) if isinstance(v, str) else v
        return self

    def set_title(self, v: str) -> Pdf:
        return self.set_info(title=v)

    def set_author(self, v: str) -> Pdf:
        return self.set_info(author=v)

    def set_subject(self, v: str) -> Pdf:
        return self.set_info(subject=v)

    def set_keywords(self, v: str) -> Pdf:
        return self.set_info(keywords=v)

    def set_creator(self, v: str) -> Pdf:
        return self.set_info(creator=v)

    def set_producer(self, v: str) -> Pdf:
        return self.set_info(producer=v)

    def set_autoprint(self, on: bool = True) -> Pdf:
        self.autoprint = on
        return self

    def add_outline(self, title: str, page: int | None = None, level: int = 0) -> Pdf:
        self.outline.append((level, title, page or len(self.pages)))
        return self

    def link(self, rect: tuple, url: str | None = None, page: int | None = None) -> Pdf:
        self.page.annots.append({"Subtype": "Link", "Rect": list(rect), "url": url, "page": page})
        return self

    def note(self, rect: tuple, contents: str, title: str = "") -> Pdf:
        self.page.annots.append({"Subtype": "Text", "Rect": list(rect), "Contents": text_string(contents), "T": text_string(title)})
        return self

    def field(self, name: str, kind: str = "Tx", value=None, *, flags: int = 0, rect: tuple = (0, 0, 0, 0), tooltip: str | None = None) -> Pdf:
        """A form field on the page; text values are str, states of buttons bytes of a name."""
        self.fields.append({"name": name, "kind": kind, "value": value, "flags": flags, "rect": rect, "tooltip": tooltip, "page": len(self.pages) - 1})
        return self

    # graphics

    def op(self, *parts) -> Pdf:
        self.page.ops.append(" ".join(p if isinstance(p, str) else num(p) for p in parts).encode("latin-1"))
        return self

    def save_state(self) -> Pdf:
        return self.op("q")

    def restore_state(self) -> Pdf:
        return self.op("Q")

    def transform(self, a, b, c, d, e, f) -> Pdf:
        return self.op(a, b, c, d, e, f, "cm")

    def translate(self, x, y) -> Pdf:
        return self.transform(1, 0, 0, 1, x, y)

    def scale(self, x, y=None) -> Pdf:
        return self.transform(x, 0, 0, x if y is None else y, 0, 0)

    def rotate(self, degrees: float, at: tuple | None = None) -> Pdf:
        r = math.radians(degrees)
        if at:
            self.translate(*at)
        self.transform(math.cos(r), math.sin(r), -math.sin(r), math.cos(r), 0, 0)
        return self.translate(-at[0], -at[1]) if at else self

    def set_fill_color(self, c) -> Pdf:
        self._filling = color(c)
        return self.op(*self._filling, "k" if len(self._filling) == 4 else "rg")

    def set_stroke_color(self, c) -> Pdf:
        v = color(c)
        return self.op(*v, "K" if len(v) == 4 else "RG")

    def set_opacity(self, fill: float, stroke: float | None = None) -> Pdf:
        key = (fill, fill if stroke is None else stroke)
        name = self.alphas.setdefault(key, f"G{len(self.alphas) + 1}")
        return self.op(f"/{name} gs")

    def set_line_width(self, w: float) -> Pdf:
        return self.op(w, "w")

    def set_line_cap(self, style: str) -> Pdf:
        return self.op({"butt": 0, "round": 1, "square": 2}[style], "J")

    def set_line_join(self, style: str) -> Pdf:
        return self.op({"miter": 0, "round": 1, "bevel": 2}[style], "j")

    def set_line_dash(self, pattern: list, phase: float = 0) -> Pdf:
        return self.op("[" + " ".join(map(num, pattern)) + "]", phase, "d")

    def rectangle(self, x, y, w, h) -> Pdf:
        return self.op(x, y, w, h, "re")

    def move_to(self, x, y) -> Pdf:
        return self.op(x, y, "m")

    def line_to(self, x, y) -> Pdf:
        return self.op(x, y, "l")

    def line(self, x1, y1, x2, y2) -> Pdf:
        return self.move_to(x1, y1).line_to(x2, y2)

    def curve_to(self, x1, y1, x2, y2, x3, y3) -> Pdf:
        return self.op(x1, y1, x2, y2, x3, y3, "c")

    def rounded_rectangle(self, x, y, w, h, r) -> Pdf:
        r = min(r, w / 2, h / 2)
        if r <= 0:
            return self.rectangle(x, y, w, h)
        k = r * (1 - 0.5523)
        self.move_to(x + r, y).line_to(x + w - r, y).curve_to(x + w - k, y, x + w, y + k, x + w, y + r)
        self.line_to(x + w, y + h - r).curve_to(x + w, y + h - k, x + w - k, y + h, x + w - r, y + h)
        self.line_to(x + r, y + h).curve_to(x + k, y + h, x, y + h - k, x, y + h - r)
        return self.line_to(x, y + r).curve_to(x, y + k, x + k, y, x + r, y).close_path()

    def circle(self, x, y, r) -> Pdf:
        return self.rounded_rectangle(x - r, y - r, 2 * r, 2 * r, r)

    def polygon(self, points) -> Pdf:
        self.move_to(*points[0])
        for p in points[1:]:
            self.line_to(*p)
        return self.close_path()

    def arc(self, x, y, r, start, end, *, moved: bool = False) -> Pdf:
        """Along a circle, in radians, by curves of a quarter at most."""
        n = max(1, math.ceil(abs(end - start) / (math.pi / 2) - 1e-9))
        step = (end - start) / n
        k = 4 / 3 * math.tan(step / 4)
        if not moved:
            self.move_to(x + r * math.cos(start), y + r * math.sin(start))
        for i in range(n):
            a, b = start + i * step, start + (i + 1) * step
            self.curve_to(x + r * (math.cos(a) - k * math.sin(a)), y + r * (math.sin(a) + k * math.cos(a)), x + r * (math.cos(b) + k * math.sin(b)), y + r * (math.sin(b) - k * math.cos(b)), x + r * math.cos(b), y + r * math.sin(b))
        return self

    def close_path(self) -> Pdf:
        return self.op("h")

    def stroke(self) -> Pdf:
        return self.op("S")

    def fill(self) -> Pdf:
        return self.op("f")

    def fill_and_stroke(self) -> Pdf:
        return self.op("B")

    def clip(self) -> Pdf:
        return self.op("W n")

    # text

    def set_font(self, name: str | None = None, size: float | None = None, *, bold: bool = False, italic: bool = False) -> Pdf:
        """A standard face; bold and italic pick the face of its family."""
        name = name or self.font
        if bold or italic:
            family = name.split("-")[0]
            tilt = "Italic" if family == "Times" else "Oblique"
            name = f"{family}-{'Bold' if bold else ''}{tilt if italic else ''}"
        self.font = name if name in metrics.FACES else {"Times": "Times-Roman"}.get(name) or self._unknown(name)
        if size is not None:
            self.font_size = float(size)
        return self

    def _unknown(self, name: str) -> str:
        if self.metrics_dir and os.path.isfile(os.path.join(self.metrics_dir, f"{name}.afm")):
            return name
        raise ValueError(f"unknown font {name!r}")

    def set_font_size(self, size: float) -> Pdf:
        self.font_size = float(size)
        return self

    def set_text_leading(self, v: float) -> Pdf:
        self.leading = v
        return self

    def line_height(self) -> float:
        return self.leading if self.leading is not None else self.font_size * 1.2

    def metrics(self, font: str | None = None) -> metrics.Metrics:
        return metrics.load(font or self.font, self.metrics_dir)

    def text_width(self, text: str, size: float | None = None, font: str | None = None, kerning: bool = False) -> float:
        return self.metrics(font).text_width(text, self.font_size if size is None else size, kerning)

    def text_at(self, x, y, text: str, *, kerning: bool = False, replacement: str | None = "?") -> Pdf:
        tag = self.fonts.setdefault(self.font, f"F{len(self.fonts) + 1}")
        head = f"BT /{tag} {num(self.font_size)} Tf {num(x)} {num(y)} Td ".encode()
        if kerning:
            parts = b"".join(literal(metrics.encode_win_ansi(p, replacement)) if isinstance(p, str) else num(p).encode() for p in self.metrics().kerned(text))
            self.page.ops.append(head + b"[" + parts + b"] TJ ET")
        else:
            self.page.ops.append(head + literal(metrics.encode_win_ansi(text, replacement)) + b" Tj ET")
        return self

    def text_lines(self, x, y, lines: list[str], *, align: str = "left", width: float | None = None) -> Pdf:
        """Lines from a first baseline down."""
        for k, s in enumerate(lines):
            w = self.text_width(s)
            shift = 0 if width is None else {"left": 0, "center": (width - w) / 2, "right": width - w}[align]
            self.text_at(x + shift, y - k * self.line_height(), s)
        return self

    def wrapped(self, text: str, width: float) -> list[str]:
        return wrap(text, width, self.text_width)

    def text_wrap(self, x, y, width, height, text: str, *, align: str = "left") -> list[str]:
        """Wrapped text under a top edge; the lines that did not fit come back."""
        lines = self.wrapped(text, width)
        fit = max(0, int((height + 1e-6) // self.line_height()))
        self.text_lines(x, y - self.font_size, lines[:fit], align=align, width=width)
        return lines[fit:]

    def text(self, text: str, *, align: str = "left", width: float | None = None) -> Pdf:
        """Wrapped text at the cursor, over as many pages as it takes."""
        area = self.content_area()
        width = area["width"] - (self.cursor_x - area["x"]) if width is None else width
        for line in self.wrapped(text, width):
            self.room(self.line_height())
            self.text_lines(self.cursor_x, self.cursor - self.font_size, [line], align=align, width=width)
            self.move_down(self.line_height())
        return self

    # styles and images

    def register_style(self, name: str, **props) -> Pdf:
        self.styles[name] = props
        return self

    def resolve_style(self, style) -> dict:
        """A name, a mapping, or a mapping with ``style`` naming its parent."""
        style = dict(self.styles.get(style, {})) if isinstance(style, str) else dict(style or {})
        parent = style.pop("style", None)
        return {**self.resolve_style(parent), **{k: v for k, v in style.items() if v is not None}} if parent else style

    def image(self, data: bytes, x, y, w=None, h=None) -> Pdf:
        """A JPEG or PNG with its lower left corner at x, y; the same bytes are stored once."""
        key = hashlib.md5(data).hexdigest()
        if key not in self.images:
            self.images[key] = (f"I{len(self.images) + 1}", _image(data))
        name, img = self.images[key]
        iw, ih = img["Width"], img["Height"]
        if w is None and h is None:
            w, h = iw, ih
        w = iw * h / ih if w is None else w
        h = ih * w / iw if h is None else h
        return self.save_state().op(w, 0, 0, h, x, y, "cm").op(f"/{name} Do").restore_state()

    # bytes

    def export(self, *, user_password: str | None = None, owner_password: str | None = None, cipher: str = "aes128", id_seed: bytes = b"foliospark") -> bytes:
        if "footer" in self.templates and not getattr(self, "_closed", False):
            self._closed = True
            self._template("footer")
        return _Output(self).bytes(user_password, owner_password, cipher, id_seed)

    def write_to(self, path: str, **options) -> None:
        with open(path, "wb") as f:
            f.write(self.export(**options))


def _image(data: bytes) -> dict:
    """Dictionary entries with the bytes under '' and a soft mask's under 'alpha'."""
    if size := images.jpeg_size(data):
        w, h, n = size
        return {"Width": w, "Height": h, "ColorSpace": {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[n], "BitsPerComponent": 8, "Filter": "DCTDecode", "": data}
    png = images.decode_png(data)
    if png["interlace"]:
        raise ValueError("interlaced PNG")
    base = {"Width": png["width"], "Height": png["height"], "BitsPerComponent": png["bits"], "Filter": "FlateDecode"}
    if png["kind"] in (4, 6):
        pixels, alpha = images.split_alpha(png)
        return {**base, "ColorSpace": "DeviceGray" if png["kind"] == 4 else "DeviceRGB", "": zlib.compress(pixels), "alpha": zlib.compress(alpha)}
    colors = 3 if png["kind"] == 2 else 1
    space = ["Indexed", "DeviceRGB", len(png["palette"]) // 3 - 1, png["palette"]] if png["kind"] == 3 else "DeviceRGB" if colors == 3 else "DeviceGray"
    return {**base, "ColorSpace": space, "DecodeParms": {"Predictor": 15, "Colors": colors, "BitsPerComponent": png["bits"], "Columns": png["width"]}, "": png["data"]}


class _Output:
    def __init__(self, doc: Pdf):
        self.doc, self.objects = doc, []

    def add(self, value, stream: bytes | None = None) -> Ref:
        self.objects.append((value, stream))
        return Ref(len(self.objects), 0)

    def stream(self, data: bytes, d: dict | None = None) -> Ref:
        d = dict(d or {})
        if self.doc.compress and "Filter" not in d:
            data, d["Filter"] = zlib.compress(data), "FlateDecode"
        return self.add({**d, "Length": len(data)}, data)

    def bytes(self, user, owner, cipher, seed) -> bytes:
        doc = self.doc
        root, tree = self.add({}), self.add({})
        fonts = {tag: self.add({"Type": "Font", "Subtype": "Type1", "BaseFont": name, **({} if name in ("Symbol", "ZapfDingbats") else {"Encoding": "WinAnsiEncoding"})}) for name, tag in doc.fonts.items()}
        for name, tag in doc.fonts.items():
            if name not in ("Symbol", "ZapfDingbats"):
                self.objects[fonts[tag].n - 1][0].update({"FirstChar": 32, "LastChar": 255, "Widths": Widths(metrics.win_ansi_widths(name, doc.metrics_dir))})
        pictures = {}
        for tag, img in doc.images.values():
            d = {"Type": "XObject", "Subtype": "Image", **{k: v for k, v in img.items() if k not in ("", "alpha")}}
            if "alpha" in img:
                d["SMask"] = self.stream(img["alpha"], {"Type": "XObject", "Subtype": "Image", "Width": img["Width"], "Height": img["Height"], "ColorSpace": "DeviceGray", "BitsPerComponent": 8, "Filter": "FlateDecode"})
            pictures[tag] = self.stream(img[""], d)
        resources = {"Font": fonts, **({"XObject": pictures} if pictures else {}), **({"ExtGState": {n: {"ca": a, "CA": b} for (a, b), n in doc.alphas.items()}} if doc.alphas else {})}
        refs = [self.add({}) for _ in doc.pages]
        for ref, page in zip(refs, doc.pages, strict=True):
            body = self.stream(b"\n".join(page.ops))
            d = {"Type": "Page", "Parent": tree, "MediaBox": [0, 0, *page.size], "Resources": resources, "Contents": body}
            if page.annots:
                d["Annots"] = [self._annotation(a, refs) for a in page.annots]
            self.objects[ref.n - 1] = (d, None)
        self.objects[tree.n - 1] = ({"Type": "Pages", "Kids": refs, "Count": len(refs)}, None)
        cat = {"Type": "Catalog", "Pages": tree}
        if doc.outline:
            cat["Outlines"] = self._outline(refs)
        if doc.fields:
            cat["AcroForm"] = {"Fields": self._fields(refs)}
        if doc.autoprint:
            cat["OpenAction"] = {"S": "Named", "N": "Print"}
        if doc.xmp:
            cat["Metadata"] = self.add({"Type": "Metadata", "Subtype": "XML", "Length": len(doc.xmp.encode())}, doc.xmp.encode())
        self.objects[root.n - 1] = (cat, None)
        info = self.add({k: v for k, v in doc.info.items()}) if doc.info else None
        return self._write(root, info, user, owner, cipher, hashlib.md5(seed).digest())

    def _annotation(self, a: dict, refs: list[Ref]) -> Ref:
        d = {"Type": "Annot", "Subtype": a["Subtype"], "Rect": a["Rect"], **{k: v for k, v in a.items() if k in ("Contents", "T") and v}}
        if a.get("url"):
            d["A"] = {"S": "URI", "URI": a["url"].encode()}
        elif a.get("page"):
            d["Dest"] = [refs[a["page"] - 1], "Fit"]
        return self.add(d)

    def _outline(self, refs: list[Ref]) -> Ref:
        top = self.add({"Type": "Outlines"})
        nodes = [self.add({"Title": text_string(t), "Dest": [refs[min(p, len(refs)) - 1], "Fit"]}) for _, t, p in self.doc.outline]
        last: dict[int, Ref] = {}
        parents = {-1: top}
        for ref, (level, _, _) in zip(nodes, self.doc.outline, strict=True):
            level = min(level, max(parents) + 1)
            parent, d = parents[level - 1], self.objects[ref.n - 1][0]
            up = self.objects[parent.n - 1][0]
            d["Parent"] = parent
            if level in last:
                self.objects[last[level].n - 1][0]["Next"] = ref
                d["Prev"] = last[level]
            up.setdefault("First", ref)
            up["Last"] = ref
            last = {k: v for k, v in last.items() if k < level} | {level: ref}
            parents = {k: v for k, v in parents.items() if k < level} | {level: ref}
        return top

    def _fields(self, refs: list[Ref]) -> list[Ref]:
        """Fields, those with dots in their names under common parents."""
        tops: list[Ref] = []
        groups: dict[str, Ref] = {}
        for f in self.doc.fields:
            *above, part = f["name"].split(".")
            kids, path, parent = tops, "", None
            for a in above:
                path = f"{path}.{a}"
                if path not in groups:
                    groups[path] = self.add({"T": text_string(a), "Kids": [], **({"Parent": parent} if parent else {})})
                    kids.append(groups[path])
                parent = groups[path]
                kids = self.objects[parent.n - 1][0]["Kids"]
            v = f["value"]
            v = text_string(v) if isinstance(v, str) else v.decode() if isinstance(v, bytes) else [text_string(x) for x in v] if isinstance(v, list) else v
            d = {"Type": "Annot", "Subtype": "Widget", "T": text_string(part), "FT": f["kind"], "Ff": f["flags"], "Rect": list(f["rect"]), "P": refs[f["page"]], **({"V": v} if v is not None else {}), **({"TU": text_string(f["tooltip"])} if f["tooltip"] else {}), **({"Parent": parent} if parent else {})}
            kids.append(self.add(d))
        return tops

    def _write(self, root, info, user, owner, cipher, file_id) -> bytes:
        secret = None
        if user is not None or owner is not None:
            secret = _Secret(user or "", owner or user or "", cipher, file_id)
        out = bytearray(f"%PDF-{self.doc.version}\n%\xe2\xe3\xcf\xd3\n".encode("latin-1"))
        places = []
        for n, (value, data) in enumerate(self.objects, 1):
            places.append(len(out))
            ref = Ref(n, 0)
            if secret:
                value = secret.strings(value, ref)
                if data is not None:
                    data = secret.seal(data, ref)
                    value = {**value, "Length": len(data)}
            out += b"%d 0 obj\n" % n + serialize(value)
            if data is not None:
                out += b"\nstream\n" + data + b"\nendstream"
            out += b"\nendobj\n"
        extra = {}
        if secret:
            places.append(len(out))
            out += b"%d 0 obj\n" % len(places) + serialize(secret.dict) + b"\nendobj\n"
            extra = {"Encrypt": Ref(len(places), 0)}
        at = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1)
        out += b"".join(b"%010d 00000 n \n" % p for p in places)
        trailer = {"Size": len(places) + 1, "Root": root, **({"Info": info} if info else {}), **extra, "ID": [file_id, file_id]}
        return bytes(out + b"trailer\n" + serialize(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at)


class _Secret:
    """Encryption of a new file: rc4 (40 or 128 bits), aes128 or aes256."""

    def __init__(self, user: str, owner: str, cipher: str, file_id: bytes):
        kinds = {"rc4-40": (1, 2, 5), "rc4": (2, 3, 16), "aes128": (4, 4, 16), "aes256": (5, 6, 32)}
        v, r, size = kinds[cipher]
        self.cipher, p = cipher, -4
        d: dict = {"Filter": "Standard", "V": v, "R": r, "P": p, "Length": size * 8}
        if v >= 4:
            d |= {"CF": {"StdCF": {"CFM": "AESV2" if v == 4 else "AESV3", "AuthEvent": "DocOpen", "Length": size}}, "StmF": "StdCF", "StrF": "StdCF"}
        h = crypt.Handler({**d, "O": b"", "U": b""}, file_id)
        if v == 5:
            salt = lambda k: hashlib.sha256(file_id + k.encode()).digest()[:8]
            self.key = hashlib.sha256(file_id + user.encode() + owner.encode()).digest()
            u = crypt.hash_r6(user.encode(), salt("uv")) + salt("uv") + salt("uk")
            d["U"], d["UE"] = u, crypt.aes_cbc_encrypt(crypt.hash_r6(user.encode(), salt("uk")), bytes(16), self.key)
            d["O"] = crypt.hash_r6(owner.encode(), salt("ov"), u) + salt("ov") + salt("ok")
            d["OE"] = crypt.aes_cbc_encrypt(crypt.hash_r6(owner.encode(), salt("ok"), u), bytes(16), self.key)
        else:
            d["O"] = h.o = crypt.owner_entry(h.owner_key(owner), user, 20 if r >= 3 else 1)
            self.key = h._from_user((user.encode("latin-1", "replace") + crypt.PAD)[:32])
            if r == 2:
                d["U"] = crypt.rc4(self.key, crypt.PAD)
            else:
                y = hashlib.md5(crypt.PAD + file_id).digest()
                for i in range(20):
                    y = crypt.rc4(bytes(b ^ i for b in self.key), y)
                d["U"] = y + bytes(16)
        self.dict = d

    def seal(self, data: bytes, ref: Ref) -> bytes:
        if self.cipher.startswith("rc4"):
            return crypt.rc4(crypt.object_key(self.key, ref, False), data)
        key = self.key if self.cipher == "aes256" else crypt.object_key(self.key, ref, True)
        return crypt.aes_seal(key, hashlib.md5(b"iv%d" % ref.n + data[:64]).digest(), data)

    def strings(self, v, ref: Ref):
        if isinstance(v, bytes):
            return self.seal(v, ref)
        if isinstance(v, (Ref, Widths)):
            return v
        if isinstance(v, (list, tuple)):
            return [self.strings(x, ref) for x in v]
        if isinstance(v, dict):
            return {k: self.strings(x, ref) for k, x in v.items()}
        return v
