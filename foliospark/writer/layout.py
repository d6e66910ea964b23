"""Where children go: flows, stacks, bands, weights, dimensions, containing blocks. Heights grow downwards here."""

from __future__ import annotations


def dimension(d, full: float) -> float | None:
    """A number, 'full' of a length, 'N%' of it, or None for 'auto'."""
    if d in ("full", ":full"):
        return full
    if isinstance(d, str) and d.endswith("%"):
        return float(d[:-1]) / 100 * full
    return None if d in ("auto", None) else float(d)


def sides(v) -> tuple[float, float, float, float]:
    """One to four values as top, right, bottom, left."""
    v = list(v) if isinstance(v, (list, tuple)) else [v or 0]
    return tuple({1: v * 4, 2: v * 2, 3: [*v, v[1]] if len(v) == 3 else v}.get(len(v), v))[:4]


def inner_width(outer: float, style: dict) -> float:
    _, right, _, left = sides(style.get("padding", 0))
    return outer - left - right


def outer_height(inner: float, style: dict) -> float:
    top, _, bottom, _ = sides(style.get("padding", 0))
    return inner + top + bottom


def flow_height(heights: list[float], gap: float = 0) -> float:
    return sum(heights) + gap * max(0, len(heights) - 1)


def stack_height(children: list[tuple[float, float]]) -> float:
    """children: (top, height), all from one edge."""
    return max((t + h for t, h in children), default=0.0)


def bands(children: list[tuple[float, float]], threshold: float = 12) -> list[list[int]]:
    """Children in one band if their tops fall into the same step of ``threshold``; bands from the top, in order within."""
    step = max(threshold, 1)
    out: dict[int, list[int]] = {}
    for k, (top, _) in enumerate(children):
        out.setdefault(int(top // step), []).append(k)
    return [out[b] for b in sorted(out)]


def reflow(children: list[tuple[float, float]], gap: float = 0, threshold: float = 12) -> tuple[list[float], float]:
    """New tops when bands follow each other by their tallest child; and the height of all."""
    tops, y = [0.0] * len(children), 0.0
    found = bands(children, threshold)
    for n, band in enumerate(found):
        for k in band:
            tops[k] = y
        y += max(children[k][1] for k in band) + (gap if n < len(found) - 1 else 0)
    return tops, y


def weighted(weights: list[float], available: float, gap: float = 0) -> list[tuple[float, float]]:
    """(offset, width) of columns by weight."""
    free = available - gap * max(0, len(weights) - 1)
    total, at, out = sum(weights), 0.0, []
    for w in weights:
        size = free * w / total
        out.append((at, size))
        at += size + gap
    return out


def containing_block(area: dict, style: dict) -> dict:
    """The area that children of a padded box fill; y is its top."""
    top, right, bottom, left = sides(style.get("padding", 0))
    return {"x": area["x"] + left, "y": area["y"] - top, "width": area["width"] - left - right, "height": area["height"] - top - bottom}
