"""Tables: column widths, row heights, pages, drawing."""

from __future__ import annotations

from .pdf import Pdf


def _sides(v) -> tuple[float, float, float, float]:
    v = v if isinstance(v, (list, tuple)) else [v]
    return {1: lambda: (v[0],) * 4, 2: lambda: (v[0], v[1], v[0], v[1]), 3: lambda: (v[0], v[1], v[2], v[1])}.get(len(v), lambda: tuple(v))()


def _cell(c) -> tuple[str, dict]:
    if isinstance(c, (tuple, list)):
        return str(c[0]), dict(c[1])
    return "" if c is None else str(c), {}


class Table:
    """rows: cells are text, (text, options) or None. Options of cells win over those of rows in columns, rows, columns and the table.

    Options: padding, border, border_color, background, color, font, font_size, bold, align, colspan, width, min_width, max_width.
    ``row_options`` may be keyed by 'even', 'odd' and negative numbers; ``repeat_header`` rows are drawn again on each page."""

    def __init__(self, rows, width: float, *, options: dict | None = None, col_options: dict | None = None, row_options: dict | None = None, repeat_header: int = 0, allow_row_overflow: bool = False):
        self.rows, self.width = [list(r) for r in rows], width
        self.options = {"padding": 4, "border": 0.5, "align": "left"} | (options or {})
        self.col_options, self.row_options = col_options or {}, row_options or {}
        self.header, self.overflow = repeat_header, allow_row_overflow

    def cells(self, r: int) -> list[tuple[int, int, str, dict]]:
        """(column, columns spanned, text, options)."""
        out, col = [], 0
        own = {}
        for key in ("odd" if r % 2 else "even", r - len(self.rows), r):
            own |= self.row_options.get(key, {})
        per_column = own.get("columns", {})
        for c in self.rows[r]:
            text, given = _cell(c)
            o = {**self.options, **self.col_options.get(col, {}), **{k: v for k, v in own.items() if k != "columns"}, **per_column.get(col, {}), **given}
            span = o.get("colspan", 1)
            out.append((col, span, text, o))
            col += span
        return out

    def widths(self, doc: Pdf) -> list[float]:
        """By each column's widest unbreakable piece, shared out to the whole width within minimum and maximum."""
        n = max((sum(c[1] for c in self.cells(r)) for r in range(len(self.rows))), default=0)
        want, low, high, fixed = [1.0] * n, [0.0] * n, [float("inf")] * n, [None] * n
        for r in range(len(self.rows)):
            for col, span, text, o in self.cells(r):
                if span > 1:
                    continue
                top, right, bottom, left = _sides(o["padding"])
                _font(doc, o)
                want[col] = max(want[col], doc.text_width(text) + left + right)
                low[col] = max(low[col], o.get("min_width", 0.0))
                high[col] = min(high[col], o.get("max_width", float("inf")))
                fixed[col] = o.get("width", fixed[col])
        out = [0.0] * n
        free, left_over = [], self.width
        for k in range(n):
            if fixed[k] is not None:
                out[k] = fixed[k]
                left_over -= fixed[k]
            else:
                free.append(k)
        while free:
            total = sum(want[k] for k in free)
            bound = [k for k in free if not low[k] <= want[k] / total * left_over <= high[k]]
            if not bound:
                for k in free:
                    out[k] = want[k] / total * left_over
                break
            for k in bound:
                out[k] = min(high[k], max(low[k], want[k] / total * left_over))
            left_over -= sum(out[k] for k in bound)
            free = [k for k in free if k not in bound]
        return out

    def layout(self, doc: Pdf) -> tuple[list[float], list[tuple[float, list]]]:
        """Widths, and per row its height and cells with wrapped lines."""
        widths, rows = self.widths(doc), []
        for r in range(len(self.rows)):
            height, cells = 0.0, []
            for col, span, text, o in self.cells(r):
                w = sum(widths[col : col + span])
                top, right, bottom, left = _sides(o["padding"])
                _font(doc, o)
                lines = doc.wrapped(text, max(1.0, w - left - right))
                height = max(height, len(lines) * doc.line_height() + top + bottom)
                cells.append((sum(widths[:col]), w, lines, o))
            rows.append((height, cells))
        return widths, rows

    def draw(self, doc: Pdf, x: float, top: float, height: float | None = None) -> tuple[float, int]:
        """Rows that fit under ``top``; (height used, first row that did not fit)."""
        _, rows = self.layout(doc)
        used = 0.0
        for r, (h, cells) in enumerate(rows):
            if height is not None and used + h > height + 1e-6 and not (self.overflow and r == 0):
                return used, r
            self._row(doc, x, top - used, h, cells)
            used += h
        return used, len(rows)

    def flow(self, doc: Pdf) -> Pdf:
        """At the cursor, over as many pages as it takes, header rows repeated. A row higher than a page raises unless it may overflow."""
        _, rows = self.layout(doc)
        x, area = doc.cursor_x, doc.content_area()
        head = rows[: self.header]
        head_height = sum(h for h, _ in head)
        for r, (h, cells) in enumerate(rows):
            repeat = r >= self.header and bool(head)
            if h + (head_height if repeat else 0) > area["height"] + 1e-6 and not self.overflow:
                raise ValueError(f"row {r} is higher than a page")
            if doc.cursor - h < area["y"] - 1e-6 and doc.cursor < area["y"] + area["height"]:
                doc.add_page()
                doc.set_cursor_x(x)
                for hh, hc in head if repeat else ():
                    self._row(doc, x, doc.cursor, hh, hc)
                    doc.move_down(hh)
            self._row(doc, x, doc.cursor, h, cells)
            doc.move_down(h)
        return doc

    def _row(self, doc: Pdf, x: float, top: float, h: float, cells) -> None:
        for left, w, lines, o in cells:
            if o.get("background"):
                doc.save_state().set_fill_color(o["background"]).rectangle(x + left, top - h, w, h).fill().restore_state()
            if o.get("border"):
                doc.save_state().set_stroke_color(o.get("border_color", "black")).set_line_width(o["border"]).rectangle(x + left, top - h, w, h).stroke().restore_state()
            pt, pr, _, pl = _sides(o["padding"])
            _font(doc, o)
            doc.save_state().set_fill_color(o.get("color", "black"))
            doc.text_lines(x + left + pl, top - pt - doc.font_size, lines, align=o["align"], width=w - pl - pr)
            doc.restore_state()


def _font(doc: Pdf, o: dict) -> None:
    doc.set_font(o.get("font", doc.font.split("-")[0]), o.get("font_size", doc.font_size), bold=o.get("bold", False))


def styled(columns: list[dict], rows: list[dict], width: float, *, header: dict | None = None, row: dict | None = None, alt: dict | None = None, footer: list | None = None, footer_style: dict | None = None) -> Table:
    """A table of records: columns have key, label, width and align; every second row takes ``alt``."""
    free = width - sum(c.get("width", 0) for c in columns)
    open_columns = [c for c in columns if "width" not in c]
    cols = {k: {"width": c.get("width", free / max(1, len(open_columns))), "align": c.get("align", "left")} for k, c in enumerate(columns)}
    body = [[c.get("label", c["key"]) for c in columns], *[[r.get(c["key"], "") for c in columns] for r in rows]]
    opts: dict = {0: {"bold": True, "background": "#E5E7EB"} | (header or {})}
    opts |= {k: (row or {}) | ((alt or {}) if k % 2 == 0 else {}) for k in range(1, len(body))}
    if footer:
        body.append(footer)
        opts[len(body) - 1] = {"bold": True} | (footer_style or {})
    return Table(body, width, col_options=cols, row_options=opts, repeat_header=1)
