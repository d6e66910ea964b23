"""What stands beside the pages' content: metadata, annotations, destinations, outlines and form fields."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from .document import Document
from .syntax import HexText, Name, PdfError, Ref, Stream, Text, decode_text, rectangle

MAX_OUTLINE, MAX_FIELDS, MAX_NAMES = 32, 8, 20
#: Annotation subtypes (fixed values).
SUBTYPES = {"Link": "link", "Text": "text", "Highlight": "highlight", "Underline": "underline", "StrikeOut": "strike_out", "Squiggly": "squiggly", "FreeText": "free_text", "Stamp": "stamp", "FileAttachment": "file_attachment", "Popup": "popup"}
#: XMP properties by namespace and name, and the Info keys that they stand for (fixed values).
XMP = {
    "{http://purl.org/dc/elements/1.1/}title": "Title", "{http://purl.org/dc/elements/1.1/}creator": "Author", "{http://purl.org/dc/elements/1.1/}description": "Description", "{http://purl.org/dc/elements/1.1/}subject": "Subject",
    "{http://ns.adobe.com/pdf/1.3/}Keywords": "Keywords", "{http://ns.adobe.com/pdf/1.3/}Producer": "Producer", "{http://ns.adobe.com/xap/1.0/}CreatorTool": "Creator", "{http://ns.adobe.com/xap/1.0/}CreateDate": "CreationDate", "{http://ns.adobe.com/xap/1.0/}ModifyDate": "ModDate",
}
_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"


def parse_xmp(data: bytes) -> dict[str, str]:
    """Properties that are known: plain values, attributes, the x-default (else first) of alternatives, the first of lists."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return {}
    out: dict[str, str] = {}
    for d in root.iter(f"{_RDF}Description"):
        for k, v in d.attrib.items():
            if k in XMP:
                out[XMP[k]] = v
        for child in d:
            if child.tag not in XMP:
                continue
            items = list(child.iter(f"{_RDF}li"))
            best = next((i for i in items if i.attrib.get("{http://www.w3.org/XML/1998/namespace}lang") == "x-default"), items[0] if items else child)
            if text := (best.text or "").strip():
                out[XMP[child.tag]] = text
    return out


def metadata(doc: Document) -> list[tuple[str, str, str]]:
    """(key, value, origin) of the Info dictionary and of XMP; XMP wins where both have a key."""
    out: dict[str, tuple[str, str]] = {}
    info = doc.resolve(doc.trailer.get("Info"))
    for k, v in info.items() if isinstance(info, dict) else ():
        v = doc.resolve(v)
        if isinstance(v, Text):
            out[k] = (decode_text(v), "info")
        elif isinstance(v, (Name, int, float)) and not isinstance(v, bool):
            out[k] = (str(v), "info")
    s = doc.resolve(doc.root.get("Metadata"))
    if isinstance(s, Stream):
        try:
            out |= {k: (v, "xmp") for k, v in parse_xmp(doc.stream_bytes(s)).items()}
        except PdfError:
            if not doc.recover:
                raise
    return [(k, v, o) for k, (v, o) in out.items()]


class Destinations:
    """Page numbers of destinations: arrays, names in the name tree or the old dictionary, and GoTo actions."""

    def __init__(self, doc: Document):
        self.doc = doc
        self.pages = {ref: k for k, (ref, _, _) in enumerate(doc.leaves(), 1) if ref is not None}
        self.names: dict[bytes, object] = {}
        old = doc.resolve(doc.root.get("Dests"))
        if isinstance(old, dict):
            self.names |= {k.encode(): v for k, v in old.items()}
        tree = doc.resolve(doc.root.get("Names"))
        if isinstance(tree, dict):
            self._walk(tree.get("Dests"), 0)

    def _walk(self, node, depth: int) -> None:
        d = self.doc.resolve(node)
        if not isinstance(d, dict) or depth > MAX_NAMES:
            return
        items = self.doc.resolve(d.get("Names"))
        for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(items, list) else ():
            k = self.doc.resolve(k)
            if isinstance(k, bytes):
                self.names[bytes(k)] = v
        for kid in self.doc.resolve(d.get("Kids")) or []:
            self._walk(kid, depth + 1)

    def page(self, dest, hops: int = 0) -> int | None:
        v = self.doc.resolve(dest)
        if hops > 4 or v is None:
            return None
        if isinstance(v, list):
            head = v[0] if v else None
            if isinstance(head, Ref):
                return self.pages.get(head)
            return head + 1 if isinstance(head, int) and 0 <= head < len(self.pages) else None
        if isinstance(v, (Text, HexText)):
            return self.page(self.names.get(bytes(v)), hops + 1)
        if isinstance(v, Name):
            return self.page(self.names.get(v.encode()), hops + 1)
        if isinstance(v, dict):
            if "D" in v and str(v.get("S", "GoTo")) == "GoTo":
                return self.page(v["D"], hops + 1)
        return None


def annotations(doc: Document, dests: Destinations) -> list[dict]:
    out = []
    for page_no, (_, page, _) in enumerate(doc.leaves(), 1):
        items = doc.resolve(page.get("Annots"))
        for item in items if isinstance(items, list) else ():
            d = doc.resolve(item)
            if not isinstance(d, dict):
                continue
            kind = str(doc.resolve(d.get("Subtype")))
            if kind == "Widget":
                continue
            rect = rectangle([doc.resolve(x) for x in doc.resolve(d.get("Rect")) or []]) or (None,) * 4
            action = doc.resolve(d.get("A"))
            action = action if isinstance(action, dict) else {}
            url = doc.resolve(action.get("URI")) if str(doc.resolve(action.get("S"))) == "URI" else None
            quads = doc.resolve(d.get("QuadPoints"))
            quads = [float(doc.resolve(x)) for x in quads] if isinstance(quads, list) else []
            own = {}
            if kind == "Text":
                own = {"open": str(doc.resolve(d.get("Open")) is True).lower(), "name": str(doc.resolve(d.get("Name")) or "Note")}
            elif kind not in SUBTYPES:
                own = {k: str(v) for k, v in d.items() if isinstance(v, (str, int, float))}
            out.append(
                {
                    "page": page_no, "seq": len(out), "type": SUBTYPES.get(kind, "unknown"), "x1": rect[0], "y1": rect[1], "x2": rect[2], "y2": rect[3], "contents": doc.text(d.get("Contents")), "title": doc.text(d.get("T")),
                    "subject": doc.text(d.get("Subj")), "created": doc.text(d.get("CreationDate")), "modified": doc.text(d.get("M")), "dest_page": dests.page(d.get("Dest")) or dests.page(action if "D" in action else None),
                    "url": decode_text(url) if isinstance(url, bytes) else None, "kind_specific": own, "quad_points": [quads[k : k + 8] for k in range(0, len(quads) - 7, 8)],
                }
            )
    return out


def outlines(doc: Document, dests: Destinations) -> list[dict]:
    """Bookmarks in pre-order. A node that is its own ancestor is cut; a child that two share is repeated."""
    out: list[dict] = []

    def walk(ref, parent: int | None, level: int, above: frozenset) -> None:
        order, seen = 0, set(above)
        while ref is not None and level < MAX_OUTLINE:
            key = ref if isinstance(ref, Ref) else id(ref)
            if key in seen:
                return
            seen.add(key)
            d = doc.resolve(ref)
            if not isinstance(d, dict):
                return
            me = len(out)
            out.append({"node_id": me, "parent_id": parent, "level": level, "ord": order, "title": doc.text(d.get("Title")) or "", "dest_page": dests.page(d.get("Dest")) or dests.page(d.get("A"))})
            walk(d.get("First"), me, level + 1, above | {key})
            order += 1
            ref = d.get("Next")

    top = doc.resolve(doc.root.get("Outlines"))
    if isinstance(top, dict):
        walk(top.get("First"), None, 0, frozenset())
    return out


#: Field flags and their bits (fixed values).
FLAGS = {"read_only": 1, "required": 2, "no_export": 3, "multiline": 13, "password": 14, "no_toggle_to_off": 15, "radio": 16, "pushbutton": 17, "combo": 18, "edit": 19, "sort": 20, "file_select": 21, "multi_select": 22, "do_not_spell_check": 23, "do_not_scroll": 24, "comb": 25, "rich_text": 26}
_KINDS = {"Tx": "text", "Btn": "button", "Ch": "choice", "Sig": "signature"}


def form_fields(doc: Document) -> list[dict]:
    """Leaves of the field tree with dotted names; the type is inherited, value and flags are not."""
    out: list[dict] = []
    form = doc.resolve(doc.root.get("AcroForm"))
    if not isinstance(form, dict):
        return out

    def walk(ref, prefix: str, kind: str | None, depth: int, above: frozenset) -> None:
        key = ref if isinstance(ref, Ref) else id(ref)
        d = doc.resolve(ref)
        if not isinstance(d, dict) or depth > MAX_FIELDS or key in above:
            return
        part = doc.text(d.get("T"))
        name = ".".join(x for x in (prefix, part) if x)
        own = doc.resolve(d.get("FT"))
        kind = str(own) if isinstance(own, Name) else kind
        kids = doc.resolve(d.get("Kids"))
        fields = [k for k in kids if not _widget_only(doc.resolve(k))] if isinstance(kids, list) else []
        if fields:
            for k in fields:
                walk(k, name, kind, depth + 1, above | {key})
            return
        ff = doc.resolve(d.get("Ff"))
        ff = ff if isinstance(ff, int) else 0
        rect = rectangle([doc.resolve(x) for x in doc.resolve(d.get("Rect")) or []]) or (None,) * 4
        out.append(
            {
                "seq": len(out), "name": name, "partial_name": part, "type": _KINDS.get(kind or "", "unknown"), "value": _value(doc, kind, ff, doc.resolve(d.get("V"))), "default": _plain(doc, d.get("DV")), "tooltip": doc.text(d.get("TU")),
                "flags": {n: bool(ff >> (b - 1) & 1) for n, b in FLAGS.items()}, "x1": rect[0], "y1": rect[1], "x2": rect[2], "y2": rect[3],
            }
        )

    for ref in doc.resolve(form.get("Fields")) or []:
        walk(ref, "", None, 0, frozenset())
    return out


def _widget_only(d) -> bool:
    return isinstance(d, dict) and str(d.get("Subtype")) == "Widget" and "T" not in d and "FT" not in d


def _plain(doc: Document, v) -> str | None:
    v = doc.resolve(v)
    return decode_text(v) if isinstance(v, Text) else str(v) if isinstance(v, (Name, int, float)) and not isinstance(v, bool) else None


def _value(doc: Document, kind: str | None, ff: int, v) -> dict:
    out = {"kind": "none", "s": None, "b": None, "arr": None}
    if kind == "Btn":
        if ff >> 16 & 1:
            return out
        on = isinstance(v, Name) and v != "Off"
        if ff >> 15 & 1:
            return out | ({"kind": "selected", "s": str(v)} if on else {})
        return out | {"kind": "boolean", "b": on}
    if kind == "Ch" and (isinstance(v, list) or ff >> 21 & 1):
        items = v if isinstance(v, list) else [] if v is None else [v]
        return out | {"kind": "list", "arr": [x for x in (_plain(doc, i) for i in items) if x is not None]}
    if kind == "Sig":
        return out | ({"kind": "present"} if v is not None else {})
    s = doc.stream_bytes(v).decode("utf-8", "replace") if isinstance(v, Stream) else _plain(doc, v)
    return out | ({"kind": "text", "s": s} if s is not None else {})
