"""An open file: cross references with recovery, objects, the page tree, resources and contents."""

from __future__ import annotations

import re
import struct

from . import filters
from .crypt import Handler
from .syntax import Lexer, PdfError, Ref, Stream, Text, parse_object

MAX_CHAIN = 1000


class Document:
    """``log`` lists what recovery did, as (event, details) pairs. ``recover`` off makes every fault raise."""

    def __init__(self, data: bytes, password: str = "", recover: bool = True):
        if data[:5] != b"%PDF-":
            raise PdfError("not_a_pdf")
        self.data, self.recover, self.log = data, recover, []
        self.version = re.split(rb"[\r\n]", data[5:64], maxsplit=1)[0].strip().decode("latin-1")
        self.cache: dict[Ref, object] = {}
        self.opening: set[Ref] = set()
        self.handler: Handler | None = None
        self.rebuilt = self.tree_rebuilt = False
        try:
            self.xref, self.trailer = load_xref(data, self.log if recover else None)
            if not isinstance(self.trailer.get("Root"), Ref):
                raise PdfError("no_root")
        except (PdfError, EOFError, ValueError, IndexError, KeyError, TypeError) as e:
            code = getattr(e, "code", "malformed")
            if not recover:
                raise PdfError(code, str(e)) from None
            self.xref, self.trailer = scan_objects(data)
            self.rebuilt = True
            self.log.append(("xref_recovered", {"reason": code, "n": len(self.xref)}))
        self._unlock(password)
        self._leaves: list[tuple[Ref | None, dict, list[dict]]] | None = None

    @property
    def encrypted(self) -> bool:
        return self.handler is not None

    def _unlock(self, password: str) -> None:
        d = self.resolve(self.trailer.get("Encrypt"))
        if d is None:
            return
        ids = self.resolve(self.trailer.get("ID"))
        handler = Handler({k: self.resolve(v) for k, v in d.items()}, bytes(ids[0]) if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b"")
        handler.unlock(password)
        self.cache.clear()
        self.handler = handler
        self.plain = self.trailer.get("Encrypt")

    def resolve(self, v):
        """The value behind a reference; null where there is none, an error in strict mode where it is broken."""
        hops = 0
        while isinstance(v, Ref):
            hops += 1
            if hops > 32:
                return None
            v = self._load(v)
        return v

    def _load(self, ref: Ref):
        if ref in self.cache:
            return self.cache[ref]
        entry = self.xref.get(ref)
        if entry is None or entry[0] == "free" or ref in self.opening:
            return None
        self.opening.add(ref)
        try:
            if entry[0] == "in_use":
                got, value = parse_object(self.data, entry[1])
                if got.n != ref.n:
                    raise PdfError("malformed", f"object {got.n} where {ref.n} should be")
                if self.handler and ref != self.plain:
                    value = self.handler.value(value, ref)
            else:
                value = self._from_stream(entry[1], entry[2], ref.n)
        except (PdfError, EOFError) as e:
            if not self.recover:
                raise PdfError(getattr(e, "code", "malformed"), str(e)) from None
            if not self.rebuilt:  # a wrong offset: look for the objects themselves
                found, trailer = scan_objects(self.data)
                self.rebuilt = True
                self.xref = {**self.xref, **found}
                self.log.append(("xref_recovered", {"reason": getattr(e, "code", "malformed"), "n": len(found)}))
                self.opening.discard(ref)
                return self._load(ref)
            value = None
        finally:
            self.opening.discard(ref)
        self.cache[ref] = value
        return value

    def _from_stream(self, n: int, index: int, want: int):
        box = self.resolve(Ref(n, 0))
        if not isinstance(box, Stream):
            raise PdfError("malformed", f"no object stream {n}")
        key = ("objstm", n)
        if key not in self.cache:
            body = self.stream_bytes(box)
            lex = Lexer(body)
            head = [lex.value() for _ in range(2 * self.resolve(box.dict.get("N", 0)))]
            self.cache[key] = (body, self.resolve(box.dict.get("First", 0)), dict(zip(head[::2], head[1::2], strict=True)))
        body, first, places = self.cache[key]
        if want not in places:
            raise PdfError("malformed", f"object {want} is not in stream {n}")
        return Lexer(body, first + places[want]).value()

    def stream_bytes(self, s: Stream) -> bytes:
        d = {k: self.resolve(v) for k, v in s.dict.items() if k in ("Filter", "F", "DecodeParms", "DP")}
        for k in ("Filter", "DecodeParms", "DP"):
            if isinstance(d.get(k), list):
                d[k] = [self.resolve(x) for x in d[k]]
        chain = [(n, {k: self.resolve(v) for k, v in p.items()}) for n, p in filters.chain_of(d)]
        return filters.decode(s.raw, chain)

    @property
    def root(self) -> dict:
        r = self.resolve(self.trailer.get("Root"))
        if isinstance(r, dict):
            return r
        if not self.recover:
            raise PdfError("no_root")
        return {}

    def leaves(self) -> list[tuple[Ref | None, dict, list[dict]]]:
        """(reference, page, ancestors from the nearest) of each page in order; loops are cut."""
        if self._leaves is not None:
            return self._leaves
        out, seen, root = [], set(), self.root
        top = self.trailer.get("Root") if str(root.get("Type")) == "Pages" else root.get("Pages")
        stack = [(top, [])]
        while stack:
            node, above = stack.pop()
            if isinstance(node, Ref):
                if node in seen:
                    continue
                seen.add(node)
            d = self.resolve(node)
            if not isinstance(d, dict):
                continue
            kids = self.resolve(d.get("Kids"))
            if isinstance(kids, list):
                stack += [(k, [d, *above]) for k in reversed(kids)]
            else:
                out.append((node if isinstance(node, Ref) else None, d, above))
        count = self.resolve(self.resolve(top).get("Count")) if isinstance(self.resolve(top), dict) else None
        if not out or count is not None and count != len(out):
            if not self.recover:
                raise PdfError("no_pages" if not out else "page_count_mismatch", f"{count} told, {len(out)} found")
            if not out:
                for ref in sorted(self.xref):
                    d = self._safe(ref)
                    if isinstance(d, dict) and str(d.get("Type")) == "Page" and ("Contents" in d or "Parent" in d):
                        out.append((ref, d, []))
                self.tree_rebuilt = True
                self.log.append(("page_tree_recovered", {"n": len(out)}))
        self._leaves = out
        return out

    def _safe(self, v):
        try:
            return self.resolve(v)
        except (PdfError, EOFError):
            return None

    def inherited(self, page: dict, above: list[dict], key: str):
        for d in (page, *above):
            if key in d:
                return self.resolve(d[key])
        return None

    def contents(self, page: dict) -> bytes:
        """Decoded content; the parts of an array each begin on a new line, those that cannot be decoded are left out."""
        c = self.resolve(page.get("Contents"))
        if isinstance(c, Stream):
            return self.stream_bytes(c)
        out = []
        for part in c if isinstance(c, list) else []:
            part = self.resolve(part)
            if isinstance(part, Stream):
                try:
                    out.append(b"\n" + self.stream_bytes(part))
                except PdfError:
                    if not self.recover:
                        raise
        if "Contents" in page and c is None:
            raise PdfError("malformed", "the page's content is missing")
        return b"".join(out)

    def text(self, v) -> str | None:
        from .syntax import decode_text

        v = self.resolve(v)
        return decode_text(v) if isinstance(v, Text) else None


def load_xref(data: bytes, log: list | None) -> tuple[dict[Ref, tuple], dict]:
    """Cross references by following /Prev, the newest section first; with a log, a missing end marker is noted, else an error."""
    tail = data.rfind(b"%%EOF")
    if tail < 0:
        if log is None:
            raise PdfError("eof_marker_missing")
        log.append(("eof_marker_missing", {}))
        raise PdfError("eof_marker_missing")
    found = re.findall(rb"(\d+)\s*\Z", data[:tail].rstrip())
    if not found:
        raise PdfError("startxref_missing")
    at, seen, xref, trailer = int(found[0]), set(), {}, {}
    todo = [at]
    while todo:
        at = todo.pop(0)
        if at in seen or len(seen) > MAX_CHAIN:
            continue
        seen.add(at)
        entries, d = _classic(data, at) if data[at : at + 24].lstrip(b"\x00\t\n\x0c\r ").startswith(b"xref") else _stream(data, at)
        for ref, e in entries.items():
            xref.setdefault(ref, e)
        trailer = {**d, **trailer}
        for k in ("XRefStm", "Prev"):
            if isinstance(d.get(k), (int, float)):
                todo.append(int(d[k]))
    return xref, trailer


def _classic(data: bytes, at: int) -> tuple[dict, dict]:
    lex, out = Lexer(data, at), {}
    if lex.value() != b"xref":
        raise PdfError("malformed", "no xref")
    while True:
        first = lex.value()
        if first == b"trailer":
            break
        count = lex.value()
        if not isinstance(first, int) or not isinstance(count, int):
            raise PdfError("malformed", "xref section")
        for k in range(count):
            offset, gen, kind = lex.value(), lex.value(), lex.value()
            out[Ref(first + k, gen)] = ("in_use", offset) if kind == b"n" else ("free",)
    d = lex.value()
    if not isinstance(d, dict):
        raise PdfError("malformed", "trailer")
    return out, d


def _stream(data: bytes, at: int) -> tuple[dict, dict]:
    _, s = parse_object(data, at)
    if not isinstance(s, Stream):
        raise PdfError("malformed", "no xref stream")
    body = filters.decode(s.raw, filters.chain_of(s.dict))
    w = s.dict.get("W", [1, 2, 1])
    index = s.dict.get("Index", [0, s.dict.get("Size", 0)])
    out, k = {}, 0
    take = lambda n, other: other if n == 0 else int.from_bytes(body[k : k + n], "big")
    for first, count in zip(index[::2], index[1::2], strict=True):
        for i in range(count):
            if k + sum(w) > len(body):
                break
            kind = take(w[0], 1)
            k += w[0]
            a = take(w[1], 0)
            k += w[1]
            b = take(w[2], 0)
            k += w[2]
            if kind == 1:
                out[Ref(first + i, b)] = ("in_use", a)
            elif kind == 2:
                out[Ref(first + i, 0)] = ("compressed", a, b)
            else:
                out[Ref(first + i, b)] = ("free",)
    return out, s.dict


_HEAD = re.compile(rb"(?:\A|[\r\n\x00\t\x0c ])(\d{1,10})[ \t]+(\d{1,5})[ \t]+obj(?![A-Za-z])")
_STREAMS = re.compile(rb"[\r\n >]stream\r?\n.*?endstream", re.S)


def scan_objects(data: bytes) -> tuple[dict[Ref, tuple], dict]:
    """Objects by their heads outside streams; of one number the highest generation, then the last. The last trailer, or a catalog."""
    skip = [(m.start(), m.end()) for m in _STREAMS.finditer(data)]
    best: dict[int, tuple[int, int]] = {}
    s = 0
    for m in _HEAD.finditer(data):
        at = m.start(1)
        while s < len(skip) and skip[s][1] <= at:
            s += 1
        if s < len(skip) and skip[s][0] < at < skip[s][1]:
            continue
        n, g = int(m[1]), int(m[2])
        if n not in best or (g, at) > best[n]:
            best[n] = (g, at)
    xref: dict[Ref, tuple] = {Ref(n, g): ("in_use", at) for n, (g, at) in best.items()}
    trailer: dict = {}
    for m in re.finditer(rb"trailer", data):
        try:
            d = Lexer(data, m.end()).value()
        except (PdfError, EOFError):
            continue
        if isinstance(d, dict):
            trailer = {**trailer, **d}
    for ref in sorted(list(xref)):
        try:
            _, v = parse_object(data, xref[ref][1])
        except (PdfError, EOFError):
            continue
        d = v.dict if isinstance(v, Stream) else v
        kind = str(d.get("Type", "")) if isinstance(d, dict) else ""
        if kind == "Catalog" and not isinstance(trailer.get("Root"), Ref):
            trailer["Root"] = ref
        elif kind == "XRef":
            trailer = {**{k: x for k, x in d.items() if k in ("Root", "Info", "ID", "Encrypt")}, **trailer}
        elif kind == "ObjStm":
            try:
                body = filters.decode(v.raw, filters.chain_of(d))
                lex = Lexer(body)
                head = [lex.value() for _ in range(2 * d.get("N", 0))]
                for k, n in enumerate(head[::2]):
                    xref.setdefault(Ref(n, 0), ("compressed", ref.n, k))
            except (PdfError, EOFError, struct.error, TypeError):
                continue
    if not xref:
        raise PdfError("malformed", "no object")
    return xref, trailer
