"""Charts. Data is (label, value) pairs, or named series of values for lines. Each is (height, draw), as components are."""

from __future__ import annotations

import math

PALETTE = ("#3B82F6", "#10B981", "#F59E0B", "#EF4444", "#8B5CF6", "#EC4899", "#14B8A6", "#F97316")


def nice_max(v: float) -> int:
    """v rounded up to 1, 1.5, 2, 3, 5, 7.5 or 10 times a power of ten; 10 where there is nothing."""
    if v <= 0:
        return 10
    mag = 10.0 ** math.floor(math.log10(v))
    return round(next(s for s in (1, 1.5, 2, 3, 5, 7.5, 10) if v / mag <= s) * mag)


def format_number(n: float) -> str:
    if isinstance(n, float):
        return f"{n:.1f}"
    return f"{n / 1_000_000:.1f}M" if n >= 1_000_000 else f"{n / 1_000:.1f}K" if n >= 10_000 else str(n)


def _title(doc, p, x, top, width) -> float:
    if not p.get("title"):
        return top
    doc.set_font("Helvetica", 12, bold=True).set_fill_color("black")
    doc.text_lines(x, top - 12, [p["title"]], align="center", width=width)
    return top - 20


def _axis(doc, x, y, w, h, low, high, lines=5) -> None:
    doc.save_state().set_line_width(0.5).set_font("Helvetica", 8)
    for k in range(lines + 1):
        at, v = y + h * k / lines, low + (high - low) * k / lines
        doc.set_stroke_color("#E5E7EB").line(x, at, x + w, at).stroke().set_fill_color("#6B7280")
        label = format_number(int(v) if v == int(v) else float(v))
        doc.text_at(x - 4 - doc.text_width(label), at - 3, label)
    doc.restore_state()


def bar_chart(doc, p, width):
    data, height = [(a, b) for a, b in p["data"]], p.get("height", 200)

    def draw(x, top):
        start = _title(doc, p, x, top, width)
        left, bottom, w, h = x + 36, top - height + 20, width - 40, start - (top - height) - 28
        high = nice_max(max((v for _, v in data), default=0))
        _axis(doc, left, bottom, w, h, 0, high)
        slot = w / max(1, len(data))
        for k, (label, v) in enumerate(data):
            doc.save_state().set_fill_color(p.get("colors", PALETTE)[k % len(p.get("colors", PALETTE))])
            doc.rectangle(left + slot * (k + 0.1), bottom, slot * 0.8, max(0.0, v / high * h)).fill().restore_state()
            doc.set_font("Helvetica", 8).set_fill_color("#374151")
            doc.text_lines(left + slot * k, bottom - 11, [str(label)], align="center", width=slot)
            if p.get("show_values", True):
                doc.text_lines(left + slot * k, bottom + max(0.0, v / high * h) + 3, [format_number(v)], align="center", width=slot)

    return height, draw


def horizontal_bar_chart(doc, p, width):
    data, row = list(p["data"]), p.get("bar_height", 18)
    height = p.get("height", len(data) * (row + 6) + (20 if p.get("title") else 0))

    def draw(x, top):
        y = _title(doc, p, x, top, width)
        side = p.get("label_width", 80)
        high = nice_max(max((v for _, v in data), default=0))
        for k, (label, v) in enumerate(data):
            y -= row + 6
            doc.set_font("Helvetica", 9).set_fill_color("#374151").text_at(x, y + row / 3, str(label))
            doc.save_state().set_fill_color(PALETTE[k % len(PALETTE)]).rectangle(x + side, y, max(0.0, v / high * (width - side - 40)), row).fill().restore_state()
            doc.set_fill_color("#374151").text_at(x + side + max(0.0, v / high * (width - side - 40)) + 4, y + row / 3, format_number(v))

    return height, draw


def line_chart(doc, p, width):
    series = p["series"] if "series" in p else {"": [v for _, v in p["data"]]}
    labels = p.get("labels") or [a for a, _ in p.get("data", [])]
    height = p.get("height", 200)

    def draw(x, top):
        start = _title(doc, p, x, top, width)
        left, bottom, w, h = x + 36, top - height + 20, width - 40, start - (top - height) - 28
        values = [v for s in series.values() for v in s]
        low = min(0, min(values, default=0))
        high = nice_max(max(values, default=0))
        _axis(doc, left, bottom, w, h, low, high)
        n = max((len(s) for s in series.values()), default=0)
        at = lambda k: left + w * k / max(1, n - 1)
        for c, s in enumerate(series.values()):
            points = [(at(k), bottom + (v - low) / (high - low) * h) for k, v in enumerate(s)]
            if not points:
                continue
            hue = PALETTE[c % len(PALETTE)]
            if p.get("fill") and len(points) > 1:
                doc.save_state().set_opacity(0.2).set_fill_color(hue).polygon([(points[0][0], bottom), *points, (points[-1][0], bottom)]).fill().restore_state()
            doc.save_state().set_stroke_color(hue).set_fill_color(hue).set_line_width(1.5).move_to(*points[0])
            for q in points[1:]:
                doc.line_to(*q)
            doc.stroke()
            for q in points if p.get("dots", True) else ():
                doc.circle(*q, 2).fill()
            doc.restore_state()
        doc.set_font("Helvetica", 8).set_fill_color("#374151")
        for k, label in enumerate(labels):
            doc.text_lines(at(k) - 30, bottom - 11, [str(label)], align="center", width=60)

    return height, draw


def pie_fractions(values: list[float]) -> list[tuple[float, float, float]]:
    """(share, start, end) of each value; angles in radians from the top, clockwise as they grow."""
    total, at, out = max(sum(values), 1), 0.0, []
    for v in values:
        out.append((v / total, at * 2 * math.pi - math.pi / 2, (at + v / total) * 2 * math.pi - math.pi / 2))
        at += v / total
    return out


def pie_chart(doc, p, width):
    data, height = list(p["data"]), p.get("height", 180)

    def draw(x, top):
        start = _title(doc, p, x, top, width)
        r = min(width * 0.3, (start - (top - height)) / 2 - 6)
        cx, cy = x + r + 6, start - r - 6
        for k, (share, a, b) in enumerate(pie_fractions([v for _, v in data])):
            if share > 0:
                doc.save_state().set_fill_color(PALETTE[k % len(PALETTE)]).move_to(cx, cy).line_to(cx + r * math.cos(-a), cy + r * math.sin(-a))
                doc.arc(cx, cy, r, -a, -b, moved=True).close_path().fill().restore_state()
            y = start - 16 - k * 14
            doc.save_state().set_fill_color(PALETTE[k % len(PALETTE)]).rectangle(cx + r + 16, y, 8, 8).fill().restore_state()
            doc.set_font("Helvetica", 9).set_fill_color("#374151").text_at(cx + r + 28, y, f"{data[k][0]} ({share * 100:.1f}%)")
        if p.get("donut"):
            doc.save_state().set_fill_color("white").circle(cx, cy, r * p.get("hole", 0.55)).fill().restore_state()

    return height, draw


CHARTS = {"bar_chart": bar_chart, "line_chart": line_chart, "pie_chart": pie_chart, "horizontal_bar_chart": horizontal_bar_chart}
