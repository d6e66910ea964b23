"""PDF tokens and values. Values are None, bool, int, float, Name, Text (a byte string), list, dict, Ref and Stream."""

from __future__ import annotations

import re
from typing import NamedTuple

WHITE = b"\x00\t\n\x0c\r "
DELIMS = b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]*(?:\d+\.?\d*|\.\d+)\Z")
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_PLAIN = re.compile(rb"[^()\\]*")
_INTS = re.compile(rb"[\t\n\x0c\r ]*(?:-?\d{1,9}[\t\n\x0c\r ]+)*(?:-?\d{1,9})?[\t\n\x0c\r ]*\]")
_ESCAPES = {0x6E: b"\n", 0x72: b"\r", 0x74: b"\t", 0x62: b"\b", 0x66: b"\f"}


class PdfError(Exception):
    """A fault in a file; ``code`` names its kind."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail


class Name(str):
    __slots__ = ()


class Text(bytes):
    """A string; ``hexa`` tells that it was written in hexadecimal."""

    hexa = False


class HexText(Text):
    hexa = True


class Ref(NamedTuple):
    n: int
    g: int


class Stream:
    __slots__ = ("dict", "raw")

    def __init__(self, d: dict, raw: bytes):
        self.dict, self.raw = d, raw


class Keyword(bytes):
    """An operator or another bare word."""


class Lexer:
    """Reads values from ``data`` at ``at``; in content streams ``refs`` is off, since R is no reference there."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def value(self):
        """The next value or Keyword; EOFError at the end."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            raise EOFError
        c = data[at]
        if c == 0x2F:
            return self._name()
        if c == 0x28:
            return self._literal()
        if c == 0x3C:
            if data[at + 1 : at + 2] == b"<":
                self.at += 2
                return self._dict()
            return self._hex()
        if c == 0x5B:
            self.at += 1
            return self._array()
        if self.refs and 0x30 <= c <= 0x39 and (m := _REF.match(data, at)):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        m = _REGULAR.match(data, at)
        if not m:  # a stray delimiter
            self.at = at + (2 if data[at : at + 2] == b">>" else 1)
            return Keyword(data[at : self.at])
        self.at = m.end()
        return _bare(m[0])

    def _name(self) -> Name:
        m = _REGULAR.match(self.data, self.at + 1)
        self.at = m.end() if m else self.at + 1
        raw = m[0] if m else b""
        if b"#" in raw:
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw)
        try:
            return Name(raw.decode("utf-8"))
        except UnicodeDecodeError:
            return Name(raw.decode("latin-1"))

    def _literal(self) -> Text:
        data, depth = self.data, 1
        k = _PLAIN.match(data, self.at + 1).end()
        n, out = len(data), bytearray(data[self.at + 1 : k])
        if k < n and data[k] == 0x29:
            self.at = k + 1
            return Text(out)
        while k < n:
            c = data[k]
            if c == 0x5C:
                k += 1
                e = data[k] if k < n else 0
                if e in _ESCAPES:
                    out += _ESCAPES[e]
                elif 0x30 <= e <= 0x37:
                    m = re.compile(rb"[0-7]{1,3}").match(data, k)
                    out.append(int(m[0], 8) & 255)
                    k = m.end() - 1
                elif e == 0x0D:
                    k += data[k + 1 : k + 2] == b"\n"
                elif e != 0x0A and k < n:
                    out.append(e)
            elif c == 0x28:
                depth += 1
                out.append(c)
            elif c == 0x29:
                depth -= 1
                if not depth:
                    self.at = k + 1
                    return Text(out)
                out.append(c)
            m = _PLAIN.match(data, min(k + 1, n))
            out += m[0]
            k = m.end()
        self.at = n
        raise PdfError("malformed", "a string has no end")

    def _hex(self) -> Text:
        end = self.data.find(b">", self.at)
        if end < 0:
            raise PdfError("malformed", "a hexadecimal string has no end")
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at + 1 : end])
        self.at = end + 1
        return HexText(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))

    def _array(self) -> list:
        if m := _INTS.match(self.data, self.at):
            self.at = m.end()
            return [*map(int, m[0][:-1].split())]
        out = []
        while True:
            self.skip()
            if self.data[self.at : self.at + 1] == b"]":
                self.at += 1
                return out
            try:
                out.append(self.value())
            except EOFError:
                raise PdfError("malformed", "an array has no end") from None

    def _dict(self) -> dict:
        out = {}
        while True:
            self.skip()
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            try:
                key = self.value()
                if not isinstance(key, Name):
                    continue
                self.skip()
                out[str(key)] = None if self.data[self.at : self.at + 2] == b">>" else self.value()
            except EOFError:
                raise PdfError("malformed", "a dictionary has no end") from None


def _bare(raw: bytes):
    if raw == b"true":
        return True
    if raw == b"false":
        return False
    if raw == b"null":
        return None
    if _NUMBER.match(raw):
        sign = -1 if raw[:1] == b"-" else 1
        body = raw.lstrip(b"+-")
        return sign * (float(body) if b"." in body else int(body))
    return Keyword(raw)


_OBJ = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj")


def parse_object(data: bytes, at: int) -> tuple[Ref, object]:
    """``N G obj ... endobj`` at a place."""
    m = _OBJ.match(data, at)
    if not m:
        raise PdfError("malformed", f"no object at {at}")
    lex = Lexer(data, m.end())
    try:
        value = lex.value()
    except EOFError:
        raise PdfError("malformed", "an object has no value") from None
    lex.skip()
    if isinstance(value, dict) and data[lex.at : lex.at + 6] == b"stream":
        k = lex.at + 6
        k += 2 if data[k : k + 2] == b"\r\n" else data[k : k + 1] in (b"\n", b"\r")
        size = value.get("Length")
        if not (isinstance(size, int) and data[k + size : k + size + 20].lstrip(WHITE).startswith(b"endstream")):
            end = data.find(b"endstream", k)
            size = (end if end >= 0 else len(data)) - k
        value = Stream(value, data[k : k + size])
    return Ref(int(m[1]), int(m[2])), value


def decode_text(raw: bytes | None) -> str | None:
    """UTF-16BE behind a byte order mark, else UTF-8 if valid, else ASCII with '?'."""
    if raw is None:
        return None
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    try:
        return bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        return bytes(raw).decode("ascii", "replace").replace("�", "?")


def rectangle(v) -> tuple[float, float, float, float] | None:
    if isinstance(v, list) and len(v) == 4 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
        return tuple(map(float, v))
    return None
