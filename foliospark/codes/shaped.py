"""Barcodes in shapes: bars cut to contours, or set into a silhouette. Coordinates run from 0 to 1, y upwards."""

from __future__ import annotations

import math

from . import code128

Points = list[tuple[float, float]]


def interpolate(points: Points, x: float) -> float:
    """Height of a contour at x; beyond its ends that of the end, of two points at one x the lower bound's."""
    if not points:
        return 1.0
    p, x = sorted(points, key=lambda q: q[0]), min(1.0, max(0.0, x))
    left = [q for q in p if q[0] <= x]
    right = [q for q in p if q[0] >= x]
    if not left or not right:
        return (left or right)[-1 if left else 0][1]
    (x1, y1), (x2, y2) = left[-1], right[0]
    return y1 if x1 == x2 else y1 + (x - x1) / (x2 - x1) * (y2 - y1)


def _ring(cx: float, cy: float, rx: float, ry: float, n: int = 24) -> Points:
    return [(cx + rx * math.cos(2 * math.pi * k / n), cy + ry * math.sin(2 * math.pi * k / n)) for k in range(n)]


def _legs(*xs: float, top: float = 0.25, width: float = 0.05) -> list[Points]:
    return [[(x, 0.0), (x + width, 0.0), (x + width, top), (x, top)] for x in xs]


def _animal(head: tuple, ears: list[Points], legs: list[Points], tail: Points, body: tuple = (0.5, 0.45, 0.34, 0.3), aspect: float = 1.8) -> dict:
    """A body, a head with an eye, ears, legs and a tail; the bars stand in a window of the body."""
    cx, cy, rx, ry = body
    hx, hy, hr = head
    window = (cx - rx * 0.75, cy - ry * 0.55, rx * 1.5, ry * 1.1)
    return {"style": "silhouette", "silhouette": [_ring(*body), _ring(hx, hy, hr, hr * aspect), *ears, *legs, *([tail] if tail else [])], "region": window, "cutouts": [("circle", (hx - hr * 0.2, hy + hr * 0.3, hr * 0.2))], "decorations": [("circle", (hx - hr * 0.2, hy + hr * 0.3, hr * 0.1))], "aspect_ratio": aspect}


def _contour(top: Points | None, bottom: Points | None, aspect: float, decorations: list | None = None) -> dict:
    return {"style": "contour", "top": top, "bottom": bottom, "decorations": decorations or [], "aspect_ratio": aspect}


def _wheels(*xs: float) -> list:
    return [("circle", (x, 0.05, 0.05)) for x in xs]


def _curve(f) -> Points:
    return [(k / 40, f(k / 40)) for k in range(41)]


SHAPES = {
    "rabbit": lambda: _animal((0.14, 0.6, 0.1), [_ring(0.12, 0.85, 0.025, 0.15), _ring(0.18, 0.85, 0.025, 0.15)], _legs(0.22, 0.3, 0.62, 0.7, top=0.2), _ring(0.86, 0.45, 0.05, 0.09)),
    "cat": lambda: _animal((0.14, 0.65, 0.11), [[(0.06, 0.75), (0.07, 0.98), (0.13, 0.82)], [(0.15, 0.82), (0.21, 0.98), (0.22, 0.75)]], _legs(0.24, 0.33, 0.63, 0.72), [(0.82, 0.5), (0.97, 0.85), (1.0, 0.8), (0.86, 0.42)]),
    "dog": lambda: _animal((0.14, 0.65, 0.12), [_ring(0.23, 0.62, 0.03, 0.14)], _legs(0.22, 0.31, 0.66, 0.75, top=0.3), [(0.82, 0.6), (0.95, 0.9), (0.98, 0.86), (0.85, 0.5)]),
    "bird": lambda: _animal((0.15, 0.68, 0.09), [[(0.07, 0.7), (0.0, 0.65), (0.07, 0.62)]], _legs(0.45, 0.55, top=0.2, width=0.015), [(0.8, 0.5), (1.0, 0.7), (1.0, 0.45), (0.82, 0.35)]),
    "fish": lambda: _animal((0.18, 0.47, 0.1), [[(0.4, 0.7), (0.55, 0.95), (0.62, 0.7)]], [], [(0.8, 0.45), (1.0, 0.8), (0.95, 0.45), (1.0, 0.1)], aspect=2.2),
    "horse": lambda: _animal((0.1, 0.85, 0.08), [[(0.08, 0.95), (0.1, 1.0), (0.13, 0.94)], [(0.12, 0.8), (0.3, 0.62), (0.22, 0.4), (0.08, 0.72)]], _legs(0.24, 0.33, 0.66, 0.75, top=0.35), [(0.82, 0.55), (0.93, 0.5), (0.92, 0.15), (0.86, 0.4)]),
    "elephant": lambda: _animal((0.14, 0.6, 0.13), [_ring(0.24, 0.6, 0.07, 0.2), [(0.03, 0.55), (0.0, 0.1), (0.05, 0.1), (0.09, 0.45)]], _legs(0.26, 0.38, 0.6, 0.72, top=0.3, width=0.09), [(0.83, 0.5), (0.9, 0.25), (0.88, 0.25), (0.81, 0.45)], aspect=1.6),
    "rv": lambda: _contour([(0.0, 0.75), (0.05, 0.95), (0.7, 0.95), (0.8, 0.9), (0.9, 0.55), (1.0, 0.5)], [(0.0, 0.1), (1.0, 0.1)], 2.8, _wheels(0.2, 0.8)),
    "camper": lambda: _contour([(0.0, 0.5), (0.1, 0.85), (0.25, 0.95), (0.75, 0.95), (0.9, 0.85), (1.0, 0.5)], [(0.0, 0.15), (1.0, 0.15)], 2.2, _wheels(0.5)),
    "city": lambda: _contour([p for k, h in enumerate((0.5, 0.8, 0.6, 1.0, 0.7, 0.9, 0.55, 0.75)) for p in ((k / 8, h), ((k + 1) / 8 - 1e-6, h))], None, 3.5),
    "wave": lambda: _contour(_curve(lambda x: 0.8 + 0.18 * math.sin(4 * math.pi * x)), _curve(lambda x: 0.18 + 0.15 * math.sin(4 * math.pi * x)), 3.0),
    "diamond": lambda: _contour([(0.0, 0.5), (0.5, 1.0), (1.0, 0.5)], [(0.0, 0.5), (0.5, 0.0), (1.0, 0.5)], 2.0),
    "hill": lambda: _contour(_curve(lambda x: 0.3 + 0.7 * math.sin(math.pi * x)), None, 3.0),
}


def available_shapes() -> list[str]:
    return list(SHAPES)


def encode(text: str, *, shape: str | None = None, contour_top: Points | None = None, contour_bottom: Points | None = None, quiet_zone: int = 2, bar_min: float = 0.0) -> dict:
    """style, bars (x, y, w, h), silhouette, region, cutouts, decorations, text, aspect_ratio. A shape that is not known is a plain one."""
    widths = code128.encode(text)
    if contour_top is not None or contour_bottom is not None:
        form = _contour(contour_top, contour_bottom, 2.5)
    else:
        form = SHAPES[shape]() if shape in SHAPES else _contour(None, None, 3.0)
    left, low, wide, high = form.get("region", (0.0, 0.0, 1.0, 1.0))
    module = wide / (sum(widths) + 2 * quiet_zone)
    at, bars = left + quiet_zone * module, []
    for k, n in enumerate(widths):
        w = n * module
        if k % 2 == 0:
            y, h = low, high
            if form["style"] == "contour":
                top = max(interpolate(form["top"], at + w / 2), bar_min) if form["top"] else 1.0
                y = interpolate(form["bottom"], at + w / 2) if form["bottom"] else 0.0
                h = max(top - y, 0.0)
            if h > 0:
                bars.append({"x": at, "y": y, "w": w, "h": h})
        at += w
    return {"style": form["style"], "bars": bars, "silhouette": form.get("silhouette", []), "region": form.get("region"), "cutouts": form.get("cutouts", []), "decorations": form["decorations"], "text": text, "aspect_ratio": form["aspect_ratio"]}
