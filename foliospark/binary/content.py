"""Content streams to events: text and images where they are put, in the order they are drawn."""

from __future__ import annotations

from typing import NamedTuple

from . import fonts as F
from .document import Document
from .syntax import HexText, Keyword, Lexer, PdfError, Ref, Stream, Text

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
MAX_FORMS = 8


class Event(NamedTuple):
    kind: str
    text: str | None = None
    x: float = 0.0
    y: float = 0.0
    font: str | None = None
    size: float = 0.0
    unresolved: tuple = ()
    name: str | None = None
    ctm: tuple = IDENTITY
    image: object = None
    ref: Ref | None = None


def multiply(a: tuple, b: tuple) -> tuple:
    """a, then b (row vectors)."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


class State:
    __slots__ = ("ctm", "font", "leading", "name", "rise", "scale", "size", "spacing", "word")

    def __init__(self):
        self.ctm, self.name, self.font, self.size = IDENTITY, None, F.DEFAULT, 0.0
        self.leading = self.spacing = self.word = self.rise = 0.0
        self.scale = 1.0

    def copy(self) -> State:
        s = State.__new__(State)
        for k in State.__slots__:
            setattr(s, k, getattr(self, k))
        return s


class Interpreter:
    """``fonts_of`` gives the fonts of a resource dictionary; forms bring their own."""

    def __init__(self, doc: Document, fonts_of):
        self.doc, self.fonts_of, self.events = doc, fonts_of, []

    def run(self, content: bytes, resources: dict) -> list[Event]:
        self.events = []
        self._stream(content, resources, State(), 0, frozenset())
        return self.events

    def _stream(self, content: bytes, resources: dict, state: State, depth: int, inside: frozenset) -> None:
        fonts, stack = self.fonts_of(resources), []
        tm = tlm = IDENTITY
        in_text = False
        shown = None  # what the last text was shown with, until its width is needed
        args: list = []
        lex = Lexer(content, refs=False)

        def number(k: int) -> float:
            v = args[k] if -len(args) <= k < len(args) else 0
            return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else 0.0

        def advance() -> None:
            nonlocal tm, shown
            if shown is None:
                return
            raw, font, size, spacing, word, scale = shown
            shown, step, total = None, 2 if font.wide else 1, 0.0
            for i, w in enumerate(font.widths(bytes(raw))):
                code = raw[i * step : (i + 1) * step]
                total += (w / 1000 * size + spacing + (word if code in (b" ", b"\0 ") else 0.0)) * scale
            tm = multiply((1, 0, 0, 1, total, 0), tm)

        def show(raw) -> None:
            nonlocal shown
            if not isinstance(raw, bytes) or not in_text:
                return
            advance()
            text, bad = state.font.decode(bytes(raw))
            at = multiply(tm, state.ctm)
            self.events.append(Event("text", text, at[4] + state.rise * at[2], at[5] + state.rise * at[3], state.name, state.size, tuple(bad)))
            shown = raw, state.font, state.size, state.spacing, state.word, state.scale

        def move(x: float, y: float) -> None:
            nonlocal tm, tlm, shown
            tm = tlm = multiply((1, 0, 0, 1, x, y), tlm)
            shown = None

        while True:
            try:
                v = lex.value()
            except EOFError:
                return
            except PdfError:
                if not self.doc.recover:
                    raise
                return
            if not isinstance(v, Keyword):
                args.append(v)
                continue
            op = bytes(v)
            if op == b"Tj":
                show(args[-1] if args else None)
            elif op == b"TJ":
                for x in args[-1] if args and isinstance(args[-1], list) else []:
                    if isinstance(x, (Text, HexText)):
                        show(x)
                    elif isinstance(x, (int, float)) and in_text:
                        advance()
                        tm = multiply((1, 0, 0, 1, -x / 1000 * state.size * state.scale, 0), tm)
            elif op == b"Td":
                move(number(-2), number(-1))
            elif op == b"TD":
                state.leading = -number(-1)
                move(number(-2), number(-1))
            elif op == b"T*":
                move(0, -state.leading)
            elif op in (b"'", b'"'):
                if op == b'"':
                    state.word, state.spacing = number(-3), number(-2)
                move(0, -state.leading)
                show(args[-1] if args else None)
            elif op == b"Tm":
                tm, shown = tuple(number(k) for k in range(-6, 0)), None
                tlm = tm
            elif op == b"BT":
                tm = tlm = IDENTITY
                in_text, shown = True, None
            elif op == b"ET":
                in_text = False
            elif op == b"Tf":
                name = str(args[-2]) if len(args) > 1 else None
                state.name, state.size, state.font = name, number(-1), fonts.get(name, F.DEFAULT)
            elif op == b"Tc":
                state.spacing = number(-1)
            elif op == b"Tw":
                state.word = number(-1)
            elif op == b"Tz":
                state.scale = number(-1) / 100
            elif op == b"TL":
                state.leading = number(-1)
            elif op == b"Ts":
                state.rise = number(-1)
            elif op == b"cm":
                state.ctm = multiply(tuple(number(k) for k in range(-6, 0)), state.ctm)
            elif op == b"q":
                stack.append(state.copy())
            elif op == b"Q":
                if stack:
                    state = stack.pop()
            elif op == b"Do":
                self._object(str(args[-1]) if args else "", resources, state, depth, inside)
            elif op == b"BI":
                self._inline(lex, state, resources)
            args = []

    def _object(self, name: str, resources: dict, state: State, depth: int, inside: frozenset) -> None:
        table = self.doc.resolve(resources.get("XObject"))
        ref = table.get(name) if isinstance(table, dict) else None
        s = self.doc.resolve(ref)
        if not isinstance(s, Stream):
            return
        kind = str(self.doc.resolve(s.dict.get("Subtype")))
        key = ref if isinstance(ref, Ref) else id(s)
        if kind == "Image":
            self.events.append(Event("image", name=name, ctm=state.ctm, image=s, ref=ref if isinstance(ref, Ref) else None))
        elif kind == "Form":
            if key in inside:
                self.events.append(Event("cycle_detected", name=name))
                return
            if depth >= MAX_FORMS:
                self.events.append(Event("max_depth_exceeded", name=name))
                return
            inner = state.copy()
            matrix = self.doc.resolve(s.dict.get("Matrix"))
            if isinstance(matrix, list) and len(matrix) == 6:
                inner.ctm = multiply(tuple(float(self.doc.resolve(x)) for x in matrix), state.ctm)
            try:
                body = self.doc.stream_bytes(s)
            except PdfError:
                if not self.doc.recover:
                    raise
                return
            self._stream(body, merged(self.doc, resources, self.doc.resolve(s.dict.get("Resources"))), inner, depth + 1, inside | {key})

    def _inline(self, lex: Lexer, state: State, resources: dict) -> None:
        """An image written into the stream: skipped to EI with white space before and no letter behind."""
        import re

        d: dict = {}
        while True:
            v = lex.value()
            if v == b"ID":
                break
            d[str(v)] = lex.value()
        m = re.compile(rb"[\x00\t\n\x0c\r ]EI(?![^\x00\t\n\x0c\r /])").search(lex.data, lex.at + 1)
        end = m.start() if m else len(lex.data)
        full = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "F": "Filter", "DP": "DecodeParms", "IM": "ImageMask"}
        s = Stream({full.get(k, k): x for k, x in d.items()}, lex.data[lex.at + 1 : end])
        lex.at = m.end() if m else len(lex.data)
        self.events.append(Event("image", name=None, ctm=state.ctm, image=s))


def merged(doc: Document, outer: dict, own) -> dict:
    """Resources of a form over those of its surroundings, entry by entry within each kind."""
    if not isinstance(own, dict):
        return outer
    out = dict(outer)
    for k, v in own.items():
        a, b = doc.resolve(outer.get(k)), doc.resolve(v)
        out[k] = {**a, **b} if isinstance(a, dict) and isinstance(b, dict) else v
    return out
