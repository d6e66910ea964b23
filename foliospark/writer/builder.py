"""Templates: lists of nodes (mappings with ``type``) rendered to a document.

A node stands at the cursor and moves it down, over to a new page where it does not fit; with ``x`` and ``y``
(of its top left corner) it stands there and moves nothing. ``style`` names or gives properties to start from."""

from __future__ import annotations

from . import layout
from .components import COMPONENTS, _box, _shadow, background, page_footer, page_header, paginator, watermark
from .pdf import Pdf
from .tables import Table

CONTAINERS = ("box", "card", "row", "column", "stack")
TYPES = sorted({*COMPONENTS, *CONTAINERS, "page_break", "watermark", "background", "paginator", "page_header", "page_footer", "custom", "image"})


def render(template: list, config: dict | None = None) -> Pdf:
    """config: size, margin, font, font_size, compress, metrics_dir, styles, info, header, footer, watermark, background (callables or, but for header and footer, properties)."""
    c = {"size": "a4", "margin": 0, "font": "Helvetica", "font_size": 12, "compress": True} | (config or {})
    doc = Pdf(c["size"], c["margin"], compress=c["compress"], metrics_dir=c.get("metrics_dir"))
    doc.set_font(c["font"], c["font_size"])
    for name, props in c.get("styles", {}).items():
        doc.register_style(name, **props)
    doc.set_info(**c.get("info", {}))
    for name, make in (("background", background), ("watermark", watermark), ("header", None), ("footer", None)):
        t = c.get(name)
        if t is None:
            continue
        doc.on_page(name, t if callable(t) else (lambda d, info, t=t, make=make: make(d, t)) if make else page_header(t) if name == "header" else page_footer(t))
        if name != "footer":
            doc._template(name)
    return render_into(doc, template)


def render_into(doc: Pdf, template: list) -> Pdf:
    for node in _flat(template):
        _node(doc, node)
    return doc


def _flat(nodes):
    for n in nodes or ():
        if isinstance(n, (list, tuple)):
            yield from _flat(n)
        else:
            yield n


def _props(doc: Pdf, node: dict) -> dict:
    own = {k: v for k, v in node.items() if k not in ("type", "x", "y", "style")}
    return {**(doc.resolve_style(node["style"]) if node.get("style") is not None and (not isinstance(node["style"], str) or node["style"] in doc.styles) else {"style": node["style"]} if "style" in node else {}), **own}


def _node(doc: Pdf, node: dict) -> None:
    kind = node.get("type")
    if kind not in TYPES:
        raise ValueError(f"unknown element {kind!r}")
    p = _props(doc, node)
    if kind == "page_break":
        doc.add_page()
    elif kind == "custom":
        node["draw"](doc)
    elif kind in ("watermark", "background"):
        {"watermark": watermark, "background": background}[kind](doc, p)
    elif kind in ("paginator", "page_footer"):
        doc.on_page("footer", (paginator if kind == "paginator" else page_footer)(p))
    elif kind == "page_header":
        doc.on_page("header", page_header(p))
        doc._template("header")
    elif kind == "table" and "x" not in node and "columns" not in p:
        Table(p.get("rows", []), p.get("width", doc.content_area()["width"]), options=p.get("options"), col_options=p.get("col_options"), row_options=p.get("row_options"), repeat_header=p.get("repeat_header", 0), allow_row_overflow=p.get("allow_row_overflow", False)).flow(doc)
    elif "x" in node:
        width = layout.dimension(p.get("width"), doc.content_area()["width"]) or doc.page.size[0] - node["x"]
        measure(doc, node, width)[1](node["x"], node["y"])
    elif kind == "text" and not doc.content_area()["height"] >= measure(doc, node, doc.content_area()["width"])[0]:
        doc.set_font(p.get("font", "Helvetica"), p.get("font_size", 12), bold=p.get("bold", False), italic=p.get("italic", False)).set_fill_color(p.get("color", "#111827"))
        doc.text(p.get("content", ""), align=p.get("align", "left"))
    elif kind in ("box", "card", "column", "stack") and measure(doc, node, doc.content_area()["width"])[0] > doc.content_area()["height"]:
        for child in _flat(p.get("children", [])):  # higher than a page: its children flow
            _node(doc, {k: v for k, v in child.items() if k not in ("x", "y")})
    else:
        height, draw = measure(doc, node, doc.content_area()["width"] - (doc.cursor_x - doc.content_area()["x"]))
        doc.room(height)
        draw(doc.cursor_x, doc.cursor)
        doc.move_down(height)


def measure(doc: Pdf, node: dict, width: float):
    """Height and drawing function of a node in a width."""
    kind, p = node["type"], _props(doc, node)
    width = layout.dimension(p.get("width"), width) or width
    if "width" in p:
        p["width"] = width
    if kind == "image":
        h = p.get("height", width * 0.75)
        return h, lambda x, top: doc.image(p["data"], x, top - h, p.get("width"), h)
    if kind not in CONTAINERS:
        if kind not in COMPONENTS:
            raise ValueError(f"{kind} cannot stand inside another element")
        return COMPONENTS[kind](doc, p, width)
    return _container(doc, kind, p, width)


def _container(doc: Pdf, kind: str, p: dict, width: float):
    gap, children = p.get("gap", 0), list(_flat(p.get("children", [])))
    if kind == "card":
        p = {"padding": 12, "border": 1, "border_radius": 6, "background": "white"} | p
        children = [*_flat([p["header"]] if p.get("header") else []), *children, *_flat([p["footer"]] if p.get("footer") else [])]
    inner = layout.inner_width(width, p)
    margin = layout.sides(p.get("margin", 0))
    inner -= margin[1] + margin[3]
    if kind == "row":
        spots = layout.weighted([c.get("weight", 1) for c in children], inner, gap)
        parts = [(dx, 0.0, *measure(doc, c, w)) for (dx, w), c in zip(spots, children, strict=True)]
        body = max((h for *_, h, _ in parts), default=0.0)
    elif any("y" in c for c in children) and kind in ("box", "card", "stack"):
        placed = [(c.get("x", 0), c.get("y", 0), *measure(doc, {k: v for k, v in c.items() if k not in ("x", "y")}, inner - c.get("x", 0))) for c in children]
        if p.get("reflow"):
            tops, body = layout.reflow([(y, h) for _, y, h, _ in placed], gap, p.get("row_threshold", 12))
            placed = [(x, t, h, d) for (x, _, h, d), t in zip(placed, tops, strict=True)]
        else:
            body = layout.stack_height([(y, h) for _, y, h, _ in placed])
        parts = placed
    else:
        parts, y = [], 0.0
        for c in children:
            h, draw = measure(doc, c, inner)
            parts.append((0.0, y, h, draw))
            y += h + gap
        body = layout.flow_height([q[2] for q in parts], gap)
    height = layout.dimension(p.get("height"), doc.content_area()["height"]) or layout.outer_height(body, p) + margin[0] + margin[2]

    def draw(x, top):
        x, top = x + margin[3], top - margin[0]
        w, h = width - margin[1] - margin[3], height - margin[0] - margin[2]
        _shadow(doc, x, top, w, h, p.get("border_radius", 0), p.get("elevation", 0))
        _box(doc, x, top, w, h, p.get("background"), p.get("border", 0), p.get("border_color", "#D1D5DB"), p.get("border_radius", 0))
        block = layout.containing_block({"x": x, "y": top, "width": w, "height": h}, p)
        doc.save_state()
        if p.get("clip"):
            doc.rectangle(x, top - h, w, h).clip()
        for dx, dy, _, put in parts:
            put(block["x"] + dx, block["y"] - dy)
        doc.restore_state()

    return height, draw


def measure_box_height(style: dict, children: list, outer_width: float, doc: Pdf | None = None) -> float:
    return measure(doc or Pdf(), {"type": "box", **style, "children": children}, outer_width)[0]
