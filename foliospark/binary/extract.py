"""One file to the rows of all tables that are asked for; each page's content is read once."""

from __future__ import annotations

from . import content, fonts, images, structure
from .document import Document
from .syntax import PdfError

TABLES = ("docs", "runs", "images", "meta", "annotations", "outlines", "fields", "pages", "events")


def extract(data: bytes, wanted: set[str] | frozenset[str] = frozenset(TABLES), *, password: str = "", recover: bool = True, pages: set[int] | None = None, cmap_dir: str | None = None, base_encoding: str | None = None) -> dict[str, list[dict]]:
    """Rows by table. In recovery a fault ends in the error and log of table docs; else it raises.

    ``pages`` limits the pages whose content is read; it changes no page number."""
    out: dict[str, list[dict]] = {t: [] for t in wanted}
    head = {"version": None, "page_count": None, "encrypted": None, "recovery_log": [], "error": None}
    log: list[tuple[str, dict]] = []
    try:
        doc = Document(data, password, recover)
        head |= {"version": doc.version, "encrypted": doc.encrypted}
        leaves = doc.leaves()
        head["page_count"] = len(leaves)
        if not leaves:
            raise PdfError("no_pages")
        _pages(doc, leaves, out, log, pages, cmap_dir, base_encoding)
        log = doc.log + log
        _structure(doc, out)
    except (PdfError, EOFError, RecursionError) as e:
        if not recover:
            raise
        head["error"] = {"code": getattr(e, "code", "malformed"), "detail": str(e)}
    if "docs" in wanted:
        keys = ("page", "obj", "gen", "font", "n", "reason")
        head["recovery_log"] = [{"seq": k, "event": event, **{x: d.get(x) for x in keys}} for k, (event, d) in enumerate(log)]
        out["docs"].append(head)
    return out


def _pages(doc: Document, leaves, out, log, only, cmap_dir, base) -> None:
    need_content = bool({"runs", "images", "events"} & set(out))
    loaded: dict[int, dict] = {}
    for page_no, (ref, page, above) in enumerate(leaves, 1):
        if only is not None and page_no not in only:
            continue
        if "pages" in out:
            box = doc.inherited(page, above, "MediaBox")
            box = [float(doc.resolve(x)) for x in box] if isinstance(box, list) and len(box) == 4 else [0.0, 0.0, 612.0, 792.0]
            out["pages"].append({"page": page_no, "ref": f"{ref.n} {ref.g}" if ref else None, "width": box[2] - box[0], "height": box[3] - box[1]})
        if not need_content:
            continue
        failed: set[str] = set()

        def fonts_of(resources, page_no=page_no, failed=failed):
            if id(resources) not in loaded:

                def report(name, why):
                    if name not in failed:
                        failed.add(name)
                        log.append(("font_skipped", {"page": page_no, "font": name, "reason": why}))

                loaded[id(resources)] = (resources, fonts.of_resources(doc, resources, cmap_dir, base, report))
            return loaded[id(resources)][1]

        try:
            resources = doc.inherited(page, above, "Resources")
            events = content.Interpreter(doc, fonts_of).run(doc.contents(page), resources if isinstance(resources, dict) else {})
        except (PdfError, EOFError, ValueError, TypeError, IndexError, RecursionError) as e:
            if not doc.recover:
                raise PdfError(getattr(e, "code", "malformed"), f"page {page_no}: {e}") from None
            log.append(("page_failed", {"page": page_no, "reason": str(e)}))
            continue
        seq = shown = 0
        for k, e in enumerate(events):
            if "events" in out:
                out["events"].append({"page": page_no, "seq": k, "kind": e.kind, "text": e.text, "x": e.x, "y": e.y, "font": e.font, "size": e.size, "name": e.name, "ctm": list(e.ctm)})
            if e.kind == "text" and e.text and "runs" in out:
                out["runs"].append({"page": page_no, "seq": seq, "text": e.text, "x": e.x, "y": e.y, "font": e.font, "size": e.size, "unresolved": [{"idx": i, "marker": m} for i, m in e.unresolved]})
                seq += 1
            if e.kind == "image" and "images" in out and (row := images.image_row(doc, e)):
                out["images"].append({"page": page_no, "seq": shown, **row})
                shown += 1


def _structure(doc: Document, out) -> None:
    def safe(table, rows):
        """A part that fails leaves its table empty."""
        try:
            return rows()
        except (PdfError, EOFError, ValueError, TypeError, RecursionError, AttributeError):
            if not doc.recover:
                raise
            return []

    if "meta" in out:
        out["meta"] = [{"key": k, "value": v, "origin": o} for k, v, o in safe("meta", lambda: structure.metadata(doc))]
    dests = structure.Destinations(doc) if {"annotations", "outlines"} & set(out) else None
    if "annotations" in out:
        out["annotations"] = safe("annotations", lambda: structure.annotations(doc, dests))
    if "outlines" in out:
        out["outlines"] = safe("outlines", lambda: structure.outlines(doc, dests))
    if "fields" in out:
        out["fields"] = safe("fields", lambda: structure.form_fields(doc))
