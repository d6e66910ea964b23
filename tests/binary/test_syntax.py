import pytest
from foliospark.binary.syntax import HexText, Keyword, Lexer, Name, PdfError, Ref, Stream, decode_text, parse_object, rectangle


def value(data, **kw):
    return Lexer(data, **kw).value()


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"true", True), (b"false", False), (b"null", None), (b"12", 12), (b"-7", -7), (b"+3.5", 3.5), (b".5", 0.5), (b"4.", 4.0), (b"--5", -5), (b"/Name", "Name"), (b"/A#20B", "A B"), (b"(a(b)c)", b"a(b)c"),
        (rb"(a\)\\\n\101\7)", b"a)\\\nA\x07"), (b"(a\\\nb)", b"ab"), (b"<48656C6C6F>", b"Hello"), (b"<4>", b"@"), (b"[1 /A (x) [2]]", [1, "A", b"x", [2]]), (b"<</A 1/B<</C 2>>>>", {"A": 1, "B": {"C": 2}}), (b"12 0 R", Ref(12, 0)), (b"% note\n 5", 5), (b"<</A>>", {"A": None}),
    ],
)
def test_values(data, want):
    assert value(data) == want


def test_kinds():
    assert isinstance(value(b"/X"), Name) and isinstance(value(b"<41>"), HexText) and isinstance(value(b"BT"), Keyword)
    assert value(b"12 0 R", refs=False) == 12


@pytest.mark.parametrize("data", [b"(open", b"<41", b"[1 2", b"<</A 1"])
def test_open_ends_are_errors(data):
    with pytest.raises(PdfError):
        value(data)


def test_objects_and_streams():
    ref, v = parse_object(b"3 1 obj (x) endobj", 0)
    assert (ref, v) == (Ref(3, 1), b"x")
    _, s = parse_object(b"1 0 obj <</Length 5>> stream\nhello\nendstream endobj", 0)
    assert isinstance(s, Stream) and s.raw == b"hello"
    _, s = parse_object(b"1 0 obj <</Length 9 0 R>> stream\r\nhello\nendstream endobj", 0)
    assert s.raw == b"hello\n"  # the length is elsewhere: all up to the end mark
    with pytest.raises(PdfError):
        parse_object(b"nothing", 0)


def test_text_strings_and_rectangles():
    assert decode_text(b"\xfe\xff\x00A\x20\xac") == "A€"
    assert decode_text("é".encode()) == "é"
    assert decode_text(b"a\xe9b") == "a?b"
    assert rectangle([1, 2.5, 3, 4]) == (1.0, 2.5, 3.0, 4.0)
    assert rectangle([1, 2, 3]) is None and rectangle([1, 2, 3, True]) is None
