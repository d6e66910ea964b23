"""Components: each function takes (doc, properties, width) and gives its height and a drawing function of (x, top)."""

from __future__ import annotations

import math
from collections.abc import Callable

from ..codes import code128, qr, shaped
from . import charts, tables
from .pdf import Pdf

INK, SOFT, LINE, ACCENT = "#111827", "#6B7280", "#D1D5DB", "#3B82F6"
KINDS = {"info": ("#EFF6FF", "#3B82F6", "i"), "success": ("#ECFDF5", "#10B981", "+"), "warning": ("#FFFBEB", "#F59E0B", "!"), "error": ("#FEF2F2", "#EF4444", "x")}
COMPONENTS: dict[str, Callable] = dict(charts.CHARTS)


def component(*names: str):
    def add(fn):
        for n in names:
            COMPONENTS[n] = fn
        return fn

    return add


def _say(doc: Pdf, x, y, text, size=10, hue=INK, *, font="Helvetica", bold=False, italic=False, align="left", width=None) -> None:
    doc.set_font(font.split("-")[0], size, bold=bold, italic=italic).set_fill_color(hue)
    doc.text_lines(x, y, [str(text)], align=align, width=width)


def _box(doc: Pdf, x, top, w, h, fill=None, border=0, border_color=LINE, radius=0) -> None:
    doc.save_state()
    if fill:
        doc.set_fill_color(fill)
    if border:
        doc.set_stroke_color(border_color).set_line_width(border)
    if fill or border:
        doc.rounded_rectangle(x, top - h, w, h, radius)
        doc.fill_and_stroke() if fill and border else doc.fill() if fill else doc.stroke()
    doc.restore_state()


def _lines(doc: Pdf, text, width, size, *, font="Helvetica", bold=False, italic=False) -> list[str]:
    doc.set_font(font.split("-")[0], size, bold=bold, italic=italic)
    return doc.wrapped(str(text), max(1.0, width))


def _shadow(doc: Pdf, x, top, w, h, radius, elevation) -> None:
    for k in range(int(elevation)):
        doc.save_state().set_opacity(0.08).set_fill_color("black").rounded_rectangle(x - k * 0.5, top - h - 1 - k, w + k, h + k * 0.5, radius + k).fill().restore_state()


@component("text")
def text(doc, p, width):
    size = p.get("font_size", 12)
    height = p.get("line_height", size * 1.2)
    lines = _lines(doc, p.get("content", ""), p.get("width", width), size, font=p.get("font", "Helvetica"), bold=p.get("bold", False), italic=p.get("italic", False))

    def draw(x, top):
        for k, s in enumerate(lines):
            _say(doc, x, top - size - k * height, s, size, p.get("color", INK), font=p.get("font", "Helvetica"), bold=p.get("bold", False), italic=p.get("italic", False), align=p.get("align", "left"), width=p.get("width", width))

    return height * len(lines), draw


@component("spacer")
def spacer(doc, p, width):
    return p.get("height", 10), lambda x, top: None


@component("line", "divider")
def divider(doc, p, width):
    above, below, thick = p.get("margin_top", 4), p.get("margin_bottom", 4), p.get("thickness", 1)
    upright = p.get("orientation") == "vertical"
    length = p.get("height", 40) if upright else p.get("width", width)

    def draw(x, top):
        doc.save_state().set_stroke_color(p.get("color", LINE)).set_line_width(thick)
        if p.get("style") in ("dashed", "dotted") or "dash" in p:
            doc.set_line_dash(p.get("dash", [1, 2] if p.get("style") == "dotted" else [4, 3]))
        y = top - above - thick / 2
        (doc.line(x, top - above, x, top - above - length) if upright else doc.line(x, y, x + length, y)).stroke().restore_state()

    return above + below + (length if upright else thick), draw


@component("line_segment")
def line_segment(doc, p, width):
    def draw(x, top):
        a, b = p.get("from", (x, top)), p.get("to", (x + width, top))
        doc.save_state().set_stroke_color(p.get("color", INK)).set_line_width(p.get("thickness", 1)).line(*a, *b).stroke().restore_state()

    return 0, draw


@component("rect")
def rect(doc, p, width):
    w, h = p.get("width", width), p.get("height", 20)
    return h, lambda x, top: _box(doc, x, top, w, h, p.get("background"), p.get("border", 0), p.get("border_color", LINE), p.get("border_radius", 0))


@component("avatar")
def avatar(doc, p, width):
    size = p.get("size", 40)

    def draw(x, top):
        radius = p.get("border_radius", size / 2)
        _shadow(doc, x, top, size, size, radius, p.get("elevation", 0))
        _box(doc, x, top, size, size, p.get("background", ACCENT), p.get("border", 0), p.get("border_color", LINE), radius)
        if p.get("image"):
            doc.save_state().rounded_rectangle(x, top - size, size, size, radius).clip().image(p["image"], x, top - size, size, size).restore_state()
        else:
            _say(doc, x, top - size / 2 - size * 0.14, p.get("initials", ""), size * 0.4, p.get("color", "white"), bold=True, align="center", width=size)

    return size, draw


@component("badge")
def badge(doc, p, width):
    size = p.get("font_size", {"small": 7, "medium": 9, "large": 12}.get(p.get("size", "medium"), 9))
    h = size * 1.8
    back = p.get("background", ACCENT)

    def draw(x, top):
        doc.set_font("Helvetica", size, bold=True)
        w = doc.text_width(str(p.get("content", ""))) + size * 1.4
        outline = p.get("variant") == "outline"
        _box(doc, x, top, w, h, None if outline else back, p.get("border", 1 if outline else 0), p.get("border_color", back), h / 2)
        _say(doc, x, top - h / 2 - size * 0.35, p.get("content", ""), size, p.get("color", back if outline else "white"), bold=True, align="center", width=w)

    return h, draw


@component("chip")
def chip(doc, p, width):
    size, h = p.get("font_size", 9), p.get("height", 20)

    def draw(x, top):
        doc.set_font("Helvetica", size)
        w = doc.text_width(str(p.get("label", ""))) + 2 * p.get("padding_h", 10)
        outline = p.get("variant") == "outlined"
        doc.save_state().set_opacity(p.get("background_opacity", p.get("opacity", 1.0)))
        _box(doc, x, top, w, h, None if outline else p.get("background", "#E5E7EB"), p.get("border", 1 if outline else 0), LINE, p.get("border_radius", h / 2))
        doc.set_opacity(p.get("text_opacity", p.get("opacity", 1.0)))
        _say(doc, x, top - h / 2 - size * 0.35, p.get("label", ""), size, p.get("color", INK), align="center", width=w)
        doc.restore_state()

    return h, draw


def clamp(v, low=0, high=100):
    return min(high, max(low, v))


@component("progress")
def progress(doc, p, width):
    w, h, v = p.get("width", width), p.get("height", 8), clamp(p.get("value", 0))

    def draw(x, top):
        radius = p.get("border_radius", h / 2)
        _box(doc, x, top, w, h, p.get("track_color", "#E5E7EB"), radius=radius)
        if v > 0:
            _box(doc, x, top, w * v / 100, h, p.get("color", ACCENT), radius=radius)
        if p.get("show_label"):
            _say(doc, x + w + 6, top - h / 2 - 3, f"{v:g}%", 8, p.get("label_color", SOFT))

    return h, draw


@component("meter")
def meter(doc, p, width):
    w = p.get("width", width)
    _, bar = progress(doc, {"width": w, "height": 10, "value": p.get("percent", 0), "show_label": False}, w)

    def draw(x, top):
        _say(doc, x, top - 9, p.get("label", ""), 9, SOFT)
        _say(doc, x, top - 9, f"{clamp(p.get('percent', 0)):g}%", 9, INK, align="right", width=w)
        bar(x, top - 14)

    return 26, draw


@component("key_value")
def key_value(doc, p, width):
    w, size = p.get("width", width), p.get("font_size", 10)
    step, side = p.get("line_height", size * 1.6), p.get("label_width", p.get("width", width) * 0.4)
    items = p.get("items", [])
    items = list(items.items()) if isinstance(items, dict) else [tuple(i) for i in items]
    rows = [(k, _lines(doc, v, w - side, size, bold=p.get("value_bold", False))) for k, v in items]

    def draw(x, top):
        y = top
        for n, (k, lines) in enumerate(rows):
            h = step * len(lines)
            if p.get("striped") and n % 2:
                _box(doc, x, y, w, h, p.get("stripe_color", "#F3F4F6"))
            _say(doc, x, y - size - (step - size) / 2, k, size, p.get("label_color", SOFT), bold=p.get("label_bold", False))
            for j, s in enumerate(lines):
                _say(doc, x + side, y - size - (step - size) / 2 - j * step, s, size, p.get("value_color", INK), bold=p.get("value_bold", False), align=p.get("value_align", "left"), width=w - side)
            y -= h
            if p.get("divider"):
                doc.save_state().set_stroke_color(p.get("divider_color", LINE)).set_line_width(0.5).line(x, y, x + w, y).stroke().restore_state()

    return step * sum(len(r[1]) for r in rows), draw


@component("alert")
def alert(doc, p, width):
    w, pad = p.get("width", width), p.get("padding", 10)
    back, bar, mark = KINDS.get(p.get("kind", "info"), KINDS["info"])
    lines = _lines(doc, p.get("message", ""), w - 2 * pad - 26, 10)
    h = 2 * pad + (16 if p.get("title") else 0) + 12 * len(lines)

    def draw(x, top):
        _box(doc, x, top, w, h, p.get("background", back), radius=p.get("border_radius", 4))
        _box(doc, x, top, 4, h, p.get("bar_color", bar))
        doc.save_state().set_fill_color(p.get("icon_bg", bar)).circle(x + pad + 10, top - pad - 8, 8).fill().restore_state()
        _say(doc, x + pad + 2, top - pad - 11, p.get("icon", mark), 9, "white", bold=True, align="center", width=16)
        y = top - pad - 9
        if p.get("title"):
            _say(doc, x + pad + 26, y, p["title"], 11, p.get("title_color", INK), bold=True)
            y -= 16
        for k, s in enumerate(lines):
            _say(doc, x + pad + 26, y - 12 * k, s, 10, p.get("message_color", "#374151"))

    return h, draw


@component("blockquote")
def blockquote(doc, p, width):
    w, pad, size = p.get("width", width), p.get("padding", 10), p.get("font_size", 11)
    lines = _lines(doc, p.get("content", ""), w - 2 * pad, size, italic=p.get("italic", True))
    h = 2 * pad + size * 1.3 * len(lines) + (16 if p.get("cite") else 0)

    def draw(x, top):
        _box(doc, x, top, w, h, p.get("background", "#F9FAFB"))
        _box(doc, x, top, p.get("bar_width", 3), h, p.get("bar_color", LINE))
        for k, s in enumerate(lines):
            _say(doc, x + pad, top - pad - size - k * size * 1.3, s, size, p.get("color", INK), italic=p.get("italic", True))
        if p.get("cite"):
            _say(doc, x + pad, top - h + pad, f"— {p['cite']}", size - 2, p.get("cite_color", SOFT))

    return h, draw


@component("code_block")
def code_block(doc, p, width):
    w, pad, size = p.get("width", width), p.get("padding", 8), p.get("font_size", 9)
    lines, step = str(p.get("content", "")).split("\n"), p.get("line_height", 12)
    h = 2 * pad + step * len(lines) + (16 if p.get("title") else 0)

    def draw(x, top):
        _box(doc, x, top, w, h, p.get("background", "#F3F4F6"), 0.5, p.get("border_color", LINE), p.get("border_radius", 4))
        y = top - pad
        if p.get("title"):
            _say(doc, x + pad, y - size, p["title"], size, SOFT, bold=True)
            y -= 16
        side = 24 if p.get("line_numbers") else 0
        for k, s in enumerate(lines):
            if side:
                _say(doc, x + pad, y - size - k * step, str(k + 1), size, p.get("line_number_color", SOFT), font="Courier")
            _say(doc, x + pad + side, y - size - k * step, s, size, p.get("color", INK), font="Courier")

    return h, draw


@component("footnote")
def footnote(doc, p, width):
    size = p.get("font_size", 8)
    step = p.get("line_height", size * 1.4)
    rows = [ln for k, t in enumerate(p.get("items", []), p.get("start_number", 1)) for ln in _lines(doc, f"{k}. {t}", p.get("width", width), size)]

    def draw(x, top):
        doc.save_state().set_stroke_color(p.get("line_color", LINE)).set_line_width(0.5).line(x, top - 2, x + p.get("separator_width", 100), top - 2).stroke().restore_state()
        for k, s in enumerate(rows):
            _say(doc, x, top - 6 - size - k * step, s, size, p.get("color", SOFT))

    return 8 + step * len(rows), draw


@component("list")
def bullets(doc, p, width):
    size = p.get("font_size", 11)
    step, gap = p.get("line_height", size * 1.5), p.get("marker_gap", 14)
    rows = []

    def add(items, level):
        for n, it in enumerate(items, 1):
            head, kids = (it[0], it[1]) if isinstance(it, (list, tuple)) else (it, [])
            mark = f"{n}." if p.get("kind") == "numbered" else "•"
            rows.extend((level, mark if j == 0 else "", s) for j, s in enumerate(_lines(doc, head, width - level * p.get("indent", 16) - gap, size)))
            add(kids, level + 1)

    add(p.get("items", []), 0)

    def draw(x, top):
        for k, (level, mark, s) in enumerate(rows):
            y, left = top - size - k * step, x + level * p.get("indent", 16)
            _say(doc, left, y, mark, size, p.get("marker_color", p.get("color", INK)))
            _say(doc, left + gap, y, s, size, p.get("color", INK))

    return step * len(rows), draw


@component("metric")
def metric(doc, p, width):
    w = p.get("width", width)
    now, before = p.get("current", 0), p.get("previous")
    delta = p.get("delta", None if not before or not isinstance(now, (int, float)) else f"{(now - before) / before * 100:+.1f}%")
    way = p.get("delta_direction") or ("neutral" if not delta else "down" if str(delta).startswith("-") else "up")

    def draw(x, top):
        _box(doc, x, top, w, 60, p.get("background", "#F9FAFB"), radius=p.get("border_radius", 6))
        _say(doc, x + 10, top - 16, p.get("label", ""), 9, p.get("label_color", SOFT))
        _say(doc, x + 10, top - 38, now, 18, p.get("value_color", INK), bold=True)
        if delta:
            hue = {"up": p.get("up_color", "#10B981"), "down": p.get("down_color", "#EF4444")}.get(way, p.get("neutral_color", SOFT))
            _say(doc, x + 10, top - 53, delta, 9, hue)

    return 60, draw


@component("stat_card")
def stat_card(doc, p, width):
    w, h = p.get("width", width), p.get("height", 80)

    def draw(x, top):
        _box(doc, x, top, w, h, p.get("background", "white"), p.get("border", 1), p.get("border_color", LINE), p.get("border_radius", 6))
        _box(doc, x, top, w, 3, p.get("accent_color", ACCENT))
        _say(doc, x + 12, top - 34, p.get("value", ""), 20, p.get("value_color", INK), bold=True)
        _say(doc, x + 12, top - 52, p.get("label", ""), 9, p.get("label_color", SOFT))
        if p.get("trend"):
            _say(doc, x + 12, top - 68, p["trend"], 9, p.get("trend_color", "#10B981"))

    return h, draw


@component("rating")
def rating(doc, p, width):
    size, most, gap = p.get("size", 14), p.get("max", 5), p.get("gap", 3)
    v = clamp(p.get("value", 0), 0, most)

    def star(cx, cy, r):
        return [(cx + (r if k % 2 == 0 else r * 0.4) * math.cos(math.pi / 2 + k * math.pi / 5), cy + (r if k % 2 == 0 else r * 0.4) * math.sin(math.pi / 2 + k * math.pi / 5)) for k in range(10)]

    def draw(x, top):
        for k in range(most):
            at = x + k * (size + gap)
            points = star(at + size / 2, top - size / 2, size / 2)
            doc.save_state().set_fill_color(p.get("empty_color", "#E5E7EB")).polygon(points).fill().restore_state()
            part = clamp(v - k, 0, 1)
            if part > 0:
                doc.save_state().rectangle(at, top - size, size * part, size).clip().set_fill_color(p.get("filled_color", "#F59E0B")).polygon(points).fill().restore_state()
        if p.get("show_label"):
            _say(doc, x + most * (size + gap) + 4, top - size * 0.75, f"{v:g}/{most}", size * 0.7, p.get("label_color", SOFT))

    return size, draw


@component("signature")
def signature(doc, p, width):
    w = p.get("width", 200)

    def draw(x, top):
        if p.get("label"):
            _say(doc, x, top - 9, p["label"], 8, SOFT)
        doc.save_state().set_stroke_color(p.get("line_color", INK)).set_line_width(0.7).line(x, top - 40, x + w, top - 40).stroke().restore_state()
        _say(doc, x, top - 52, p.get("name", ""), 10, p.get("name_color", INK), bold=True)
        _say(doc, x, top - 64, p.get("title", ""), 8, p.get("title_color", SOFT))
        if p.get("date"):
            _say(doc, x, top - 52, p["date"], 8, SOFT, align="right", width=w)

    return 70, draw


@component("step_indicator")
def step_indicator(doc, p, width):
    w, size, steps, now = p.get("width", width), p.get("step_size", 22), p.get("steps", []), p.get("current", 1)

    def draw(x, top):
        slot = w / max(1, len(steps))
        cy = top - size / 2
        for k, label in enumerate(steps):
            cx = x + slot * (k + 0.5)
            if k:
                doc.save_state().set_stroke_color(p.get("line_color", LINE)).line(cx - slot + size / 2, cy, cx - size / 2, cy).stroke().restore_state()
            hue = p.get("completed_color", "#10B981") if k + 1 < now else p.get("active_color", ACCENT) if k + 1 == now else p.get("pending_color", LINE)
            doc.save_state().set_fill_color(hue).circle(cx, cy, size / 2).fill().restore_state()
            _say(doc, cx - size / 2, cy - 3.5, str(k + 1), 10, "white", bold=True, align="center", width=size)
            _say(doc, cx - slot / 2, top - size - 12, label, 8, SOFT, align="center", width=slot)

    return size + 16, draw


@component("timeline")
def timeline(doc, p, width):
    step, side, items = p.get("row_height", 34), p.get("date_width", 70), p.get("items", [])

    def draw(x, top):
        doc.save_state().set_stroke_color(p.get("line_color", LINE)).line(x + side + 6, top, x + side + 6, top - step * len(items)).stroke().restore_state()
        for k, it in enumerate(items):
            y = top - k * step - 10
            _say(doc, x, y, it.get("date", ""), 9, p.get("date_color", SOFT))
            doc.save_state().set_fill_color(p.get("dot_color", ACCENT)).circle(x + side + 6, y + 3, p.get("dot_size", 4)).fill().restore_state()
            _say(doc, x + side + 18, y, it.get("title", ""), p.get("font_size", 10), p.get("color", INK), bold=True)
            _say(doc, x + side + 18, y - 12, it.get("text", ""), 9, SOFT)

    return step * len(items), draw


@component("toc")
def toc(doc, p, width):
    w, size, items = p.get("width", width), p.get("font_size", 11), p.get("items", [])
    step = p.get("line_height", size * 1.6)

    def draw(x, top):
        for k, it in enumerate(items):
            y, left = top - size - k * step, x + p.get("indent", 14) * (it.get("level", 1) - 1)
            _say(doc, left, y, it["title"], size, p.get("color", INK))
            a, page = left + doc.text_width(it["title"]) + 4, str(it.get("page", ""))
            b = x + w - doc.text_width(page) - 4
            if p.get("dots", True) and b > a:
                _say(doc, a, y, "." * int((b - a) / doc.text_width(".")), size, p.get("dot_color", LINE))
            _say(doc, x, y, page, size, p.get("page_color", INK), align="right", width=w)

    return step * len(items), draw


@component("qr")
def qr_code(doc, p, width):
    size, quiet, pad = p.get("size", 100), p.get("quiet_zone", 4), p.get("padding", 0)
    label = 14 if p.get("label") else 0

    def draw(x, top):
        rows = qr.encode(p["data"], p.get("ec_level", "M"))
        n = len(rows) + 2 * quiet
        _box(doc, x, top, size, size, p.get("background", "white"), p.get("border", 0), p.get("border_color", LINE), p.get("border_radius", 0))
        m = (size - 2 * pad) / n
        doc.save_state().set_fill_color(p.get("color", "black"))
        for r, row in enumerate(rows):
            c = 0
            while c < len(row):
                if row[c]:
                    e = c
                    while e < len(row) and row[e]:
                        e += 1
                    doc.rectangle(x + pad + (c + quiet) * m, top - pad - (r + quiet + 1) * m, (e - c) * m, m)
                    c = e
                else:
                    c += 1
        doc.fill().restore_state()
        if p.get("logo"):
            s = p.get("logo_size", size * 0.2)
            g = p.get("logo_padding", 2)
            _box(doc, x + (size - s) / 2 - g, top - (size - s) / 2 + g, s + 2 * g, s + 2 * g, p.get("logo_background", "white"), radius=p.get("logo_border_radius", 2))
            doc.image(p["logo"], x + (size - s) / 2, top - (size + s) / 2, s, s)
        if label:
            _say(doc, x, top - size - 10, p["label"], p.get("label_font_size", 8), p.get("label_color", INK), bold=p.get("label_bold", False), align="center", width=size)

    return size + label, draw


@component("barcode")
def barcode(doc, p, width):
    w, h, size = p.get("width", 200), p.get("height", 50), p.get("font_size", 9)
    shown = p.get("show_text", True)
    total = h + (size + 4 if shown else 0) + (12 if p.get("label") else 0)

    def draw(x, top):
        hue = p.get("color", "black")
        if p.get("label"):
            _say(doc, x, top - 9, p["label"], p.get("label_font_size", 8), p.get("label_color", SOFT), align="center", width=w)
            top -= 12
        if p.get("background"):
            _box(doc, x, top, w, h, p["background"])
        at = lambda q: (x + q[0] * w, top - h + q[1] * h)
        if p.get("shape") or p.get("contour_top") or p.get("contour_bottom"):
            got = shaped.encode(p["data"], shape=p.get("shape"), contour_top=p.get("contour_top"), contour_bottom=p.get("contour_bottom"), quiet_zone=p.get("quiet_zone", 2), bar_min=p.get("bar_min_height", 0.0))
            doc.save_state().set_fill_color(p.get("decoration_color", hue))
            for poly in got["silhouette"]:
                doc.polygon([at(q) for q in poly]).fill()
            if got["region"]:
                rx, ry, rw, rh = got["region"]
                doc.set_fill_color(p.get("background", "white")).rectangle(*at((rx, ry)), rw * w, rh * h).fill()
            bars = [(b["x"], b["y"], b["w"], b["h"]) for b in got["bars"]]
            marks = [(p.get("background", "white"), got["cutouts"]), (p.get("decoration_color", hue), got["decorations"])]
        else:
            doc.save_state()
            widths, quiet = code128.encode(p["data"]), p.get("quiet_zone", 10)
            m, place, bars, marks = 1 / (sum(widths) + 2 * quiet), quiet / (sum(widths) + 2 * quiet), [], []
            for k, n in enumerate(widths):
                if k % 2 == 0:
                    bars.append((place, 0.0, n * m, 1.0))
                place += n * m
        doc.set_fill_color(hue)
        for bx, by, bw, bh in bars:
            doc.rectangle(*at((bx, by)), bw * w, bh * h)
        doc.fill()
        for c, shapes in marks:
            doc.set_fill_color(c)
            for kind, v in shapes:
                if kind == "circle":
                    doc.circle(*at(v[:2]), v[2] * h).fill()
                elif kind == "polygon":
                    doc.polygon([at(q) for q in v]).fill()
        doc.restore_state()
        if p.get("image"):
            s = p.get("image_size", 20)
            doc.image(p["image"], x + (w - s) / 2, top - (h + s) / 2, s, s)
        if shown:
            _say(doc, x, top - h - size, p["data"], size, p.get("text_color", INK), align="center", width=w)

    return total, draw


@component("table")
def table(doc, p, width):
    w = p.get("width", width)
    if "columns" in p:
        t = tables.styled(p["columns"], p.get("rows", []), w, header=p.get("header"), row=p.get("row"), alt=p.get("alt"), footer=p.get("footer"), footer_style=p.get("footer_style"))
    else:
        t = tables.Table(p.get("rows", []), w, options=p.get("options"), col_options=p.get("col_options"), row_options=p.get("row_options"), repeat_header=p.get("repeat_header", 0), allow_row_overflow=p.get("allow_row_overflow", False))
    height = sum(h for h, _ in t.layout(doc)[1])
    return height, lambda x, top: t.draw(doc, x, top)


@component("header")
def header(doc, p, width):
    w, h = p.get("width", width), p.get("height", 40)

    def draw(x, top):
        _box(doc, x, top, w, h, p.get("background", "#F3F4F6"))
        _say(doc, x + 10, top - h / 2 - 6, p.get("text", ""), 16, INK, bold=True, align=p.get("align", "left"), width=w - 20)

    return h, draw


@component("nav")
def nav(doc, p, width):
    w = p.get("width", width)

    def draw(x, top):
        _say(doc, x, top - 14, p.get("brand", ""), 12, INK, bold=True)
        _say(doc, x, top - 14, "   ".join([*map(str, p.get("links", [])), str(p.get("phone", ""))]).strip(), 9, SOFT, align="right", width=w)

    return 24, draw


@component("aside")
def aside(doc, p, width):
    w, h = p.get("width", width), p.get("height", 120)
    side = p.get("size", 80)

    def draw(x, top):
        _box(doc, x, top, w, h, "#F9FAFB", 0.5, LINE, 4)
        if p.get("qr_payload"):
            qr_code(doc, {"data": p["qr_payload"], "size": side}, side)[1](x + (w - side) / 2, top - (h - side) / 2)

    return h, draw


@component("figure")
def figure(doc, p, width):
    w = p.get("width", width)

    def draw(x, top):
        if p.get("qr_payload"):
            qr_code(doc, {"data": p["qr_payload"], "size": 80}, 80)[1](x, top)
        if p.get("barcode_data"):
            _say(doc, x + 90, top - 10, p.get("barcode_top", ""), 8, SOFT)
            barcode(doc, {"data": p["barcode_data"], "width": w - 90, "height": 40}, w)[1](x + 90, top - 14)
            _say(doc, x + 90, top - 76, p.get("barcode_bottom", ""), 8, SOFT)
        _say(doc, x, top - 94, p.get("total_display", ""), 12, INK, bold=True)
        _say(doc, x + 90, top - 94, p.get("total_words", ""), 8, SOFT)

    return 100, draw


def watermark(doc: Pdf, p: dict) -> None:
    w, h = doc.page.size
    size = p.get("font_size", 60)
    doc.save_state().set_opacity(p.get("opacity", 0.12)).rotate(p.get("angle", 45), (w / 2, h / 2))
    _say(doc, 0, h / 2 - size / 3, p.get("text", ""), size, p.get("color", SOFT), bold=True, align="center", width=w)
    doc.restore_state()


def background(doc: Pdf, p: dict) -> None:
    w, h = doc.page.size
    if p.get("image"):
        doc.image(p["image"], 0, 0, w, h)
    else:
        doc.save_state().set_fill_color(p.get("color", "white")).rectangle(0, 0, w, h).fill().restore_state()


def page_header(p: dict) -> Callable:
    """A template that draws a head on each page but, if asked, the first."""

    def draw(doc: Pdf, info: dict) -> None:
        if p.get("skip_first") and info["number"] == 1:
            return
        area, (_, h) = doc.content_area(), doc.page.size
        y, size, hue = h - p.get("margin_top", 24), p.get("font_size", 9), p.get("color", SOFT)
        for key, align in (("left", "left"), ("title", "center"), ("right", "right")):
            if p.get(key):
                _say(doc, area["x"], y, p[key], size, hue, align=align, width=area["width"], bold=key == "title")
        if p.get("subtitle"):
            _say(doc, area["x"], y - size - 2, p["subtitle"], size - 1, hue, align="center", width=area["width"])
        if p.get("line"):
            doc.save_state().set_stroke_color(p.get("line_color", LINE)).set_line_width(p.get("line_width", 0.5)).line(area["x"], y - size - 6, area["x"] + area["width"], y - size - 6).stroke().restore_state()

    return draw


def paginator(p: dict) -> Callable:
    """A template that writes page numbers."""

    def draw(doc: Pdf, info: dict) -> None:
        area = doc.content_area()
        text = f"{p.get('prefix', '')}{info['number']}"
        if p.get("show_total") and p.get("total_pages"):
            text += f"{p.get('separator', ' / ')}{p['total_pages']}"
        _say(doc, area["x"], p.get("margin_bottom", 20), p["format"].format(page=info["number"], total=p.get("total_pages", "")) if p.get("format") else text, p.get("font_size", 9), p.get("color", SOFT), align="center", width=area["width"])

    return draw


def page_footer(p: dict) -> Callable:
    def draw(doc: Pdf, info: dict) -> None:
        area = doc.content_area()
        _say(doc, area["x"], p.get("margin_bottom", 20), p.get("text", ""), p.get("font_size", 8), p.get("color", SOFT), align=p.get("align", "center"), width=area["width"])

    return draw
