"""Whole files: recovery, fonts, content, structure."""

import zlib

import pytest
from foliospark.binary import cmaps, encodings
from foliospark.binary.content import Interpreter
from foliospark.binary.document import Document
from foliospark.binary.extract import extract
from foliospark.binary.syntax import PdfError
from foliospark.writer.pdf import Pdf


def build(objects: dict, root="1 0 R", extra="", eof=True, start=None) -> bytes:
    """Objects by number: text, or (dictionary text, stream bytes)."""
    out, at = bytearray(b"%PDF-1.4\n"), {}
    for n, v in objects.items():
        at[n] = len(out)
        if isinstance(v, tuple):
            out += f"{n} 0 obj <<{v[0]} /Length {len(v[1])}>> stream\n".encode() + v[1] + b"\nendstream endobj\n"
        else:
            out += f"{n} 0 obj {v} endobj\n".encode("latin-1")
    x = len(out)
    out += f"xref\n0 {max(objects) + 1}\n".encode()
    out += b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(max(objects) + 1))
    out += f"trailer <</Size {max(objects) + 1} {f'/Root {root}' if root else ''} {extra}>>\nstartxref\n{x if start is None else start}\n".encode()
    return bytes(out + (b"%%EOF\n" if eof else b""))


FONT = "<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"


def pages(*contents, font=FONT, more=None, resources="") -> dict:
    n = len(contents)
    kids = " ".join(f"{10 + k} 0 R" for k in range(n))
    out = {1: "<</Type/Catalog/Pages 2 0 R>>", 2: f"<</Type/Pages/Kids[{kids}]/Count {n}/Resources<</Font<</F1 5 0 R>>{resources}>>>>", 5: font}
    for k, c in enumerate(contents):
        out[10 + k] = f"<</Type/Page/Parent 2 0 R{f'/Contents {30 + k} 0 R' if c is not None else '/Contents 99 0 R'}>>"
        if c is not None:
            out[30 + k] = ("", c)
    return out | (more or {})


HELLO = b"BT /F1 12 Tf 100 700 Td (Hello) Tj ET"


def runs(content, **kw):
    return extract(build(pages(content, **kw)), {"runs"}, recover=False)["runs"]


def events(log):
    return [e["event"] for e in log["docs"][0]["recovery_log"]]


def test_minimal_file():
    got = extract(build(pages(HELLO)), recover=False)
    assert got["docs"][0] | {"recovery_log": None} == {"version": "1.4", "page_count": 1, "encrypted": False, "recovery_log": None, "error": None}
    r = got["runs"][0]
    assert (r["text"], r["x"], r["y"], r["font"], r["size"]) == ("Hello", 100.0, 700.0, "F1", 12.0)


def test_recovery_of_references():
    whole = pages(HELLO)
    for data in (build(whole, start=7), build(whole, eof=False), build(whole, root=None), build(whole)[:-60]):
        got = extract(data)
        assert [r["text"] for r in got["runs"]] == ["Hello"] and "xref_recovered" in events(got)
        with pytest.raises(PdfError):
            extract(data, recover=False)


def test_one_page_of_three_fails():
    got = extract(build(pages(HELLO, None, HELLO)))
    assert [r["page"] for r in got["runs"]] == [1, 3]
    assert [(e["event"], e["page"]) for e in got["docs"][0]["recovery_log"]] == [("page_failed", 2)]
    with pytest.raises(PdfError):
        extract(build(pages(HELLO, None, HELLO)), recover=False)


def test_bad_font_and_not_a_document():
    got = extract(build(pages(HELLO, font="<</Type/Font/Subtype/Type0/Encoding/Nowhere-H/DescendantFonts[]>>")))
    assert got["runs"][0]["text"] == "�" * 5 and events(got) == ["font_skipped"]
    for data in (b"", b"GIF89a", b"%PDX-"):
        assert extract(data, {"docs"})["docs"][0]["error"]["code"] == "not_a_pdf"


def test_later_generations_and_fake_objects():
    objects = pages(b"BT /F1 1 Tf (1 0 obj) Tj ET")
    data = build(objects, start=0) + b"30 1 obj <</Length 30>> stream\nBT /F1 1 Tf (newer) Tj ET      \nendstream endobj\n"
    data = data.replace(b"30 0 R", b"30 1 R")
    assert [r["text"] for r in extract(data)["runs"]] == ["newer"]


def test_page_tree_loops_and_recovery():
    objects = pages(HELLO)
    objects[2] = "<</Type/Pages/Kids[2 0 R 10 0 R]/Count 1/Resources<</Font<</F1 5 0 R>>>>>>"
    assert len(extract(build(objects), recover=False)["runs"]) == 1
    objects[1] = "<</Type/Catalog/Pages 77 0 R>>"
    assert "page_tree_recovered" in events(extract(build(objects)))
    objects = pages(HELLO)
    objects[2] = objects[2].replace("/Count 1", "/Count 4")
    with pytest.raises(PdfError, match="page_count_mismatch"):
        extract(build(objects), recover=False)


def test_object_and_reference_streams():
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>", FONT.encode()]
    numbers, body, head = [1, 2, 3, 5], b"", ""
    for n, v in zip(numbers, inner, strict=True):
        head += f"{n} {len(body)} "
        body += v + b" "
    packed = zlib.compress(head.encode() + body)
    out = bytearray(b"%PDF-1.5\n")
    places = {}
    places[4] = len(out)
    out += b"4 0 obj <</Length %d>> stream\n" % len(HELLO) + HELLO + b"\nendstream endobj\n"
    places[6] = len(out)
    out += b"6 0 obj <</Type/ObjStm/N 4/First %d/Filter/FlateDecode/Length %d>> stream\n" % (len(head), len(packed)) + packed + b"\nendstream endobj\n"
    at = len(out)
    rows = [(0, 0, 0), (2, 6, 0), (2, 6, 1), (2, 6, 2), (1, places[4], 0), (2, 6, 3), (1, places[6], 0), (1, at, 0)]
    table = b"".join(bytes([k]) + a.to_bytes(2, "big") + bytes([b]) for k, a, b in rows)
    out += b"7 0 obj <</Type/XRef/Size 8/W[1 2 1]/Root 1 0 R/Length %d>> stream\n" % len(table) + table + b"\nendstream endobj\nstartxref\n%d\n%%%%EOF" % at
    assert extract(bytes(out), recover=False)["runs"][0]["text"] == "Hello"
    assert extract(bytes(out[:-40]))["runs"][0]["text"] == "Hello"  # found again by scanning


@pytest.mark.parametrize(
    ("content", "want"),
    [
        (b"(out) Tj BT /F1 10 Tf (in) Tj ET", [("in", 0, 0)]),
        (b"BT /F1 10 Tf 10 20 Td (a) Tj 5 -10 Td (b) Tj ET", [("a", 10, 20), ("b", 15, 10)]),
        (b"BT /F1 10 Tf 12 TL 1 0 0 1 50 60 Tm (a) Tj T* (b) Tj (c) ' ET", [("a", 50, 60), ("b", 50, 48), ("c", 50, 36)]),
        (b"BT /F1 10 Tf 0 -14 TD (a) Tj T* (b) Tj ET", [("a", 0, -14), ("b", 0, -28)]),
        (b"2 0 0 2 10 10 cm BT /F1 10 Tf 5 5 Td (a) Tj ET", [("a", 20, 20)]),
        (b"q 1 0 0 1 7 7 cm Q Q BT /F1 10 Tf (a) Tj ET", [("a", 0, 0)]),
        (b"BT /F1 10 Tf [(a) -1000 (b)] TJ ET", [("a", 0, 0), ("b", 15, 0)]),
        (b"BT /F1 10 Tf 2 Tc (ab) Tj (c) Tj ET", [("ab", 0, 0), ("c", 14, 0)]),
        (b"BT /F1 10 Tf 3 Tw (a ) Tj (c) Tj ET", [("a ", 0, 0), ("c", 13, 0)]),
        (b"BT /F1 10 Tf 50 Tz (a) Tj (c) Tj ET", [("a", 0, 0), ("c", 2.5, 0)]),
        (b"BT /F1 10 Tf 1 2 (a) \" (b) Tj ET", [("a", 0, 0), ("b", 7, 0)]),
    ],
)
def test_text_operators(content, want):
    """Widths are 500 where a font has none."""
    assert [(r["text"], r["x"], r["y"]) for r in runs(content)] == want


def test_forms_loops_and_images():
    form = ("/Type/XObject/Subtype/Form/Matrix[1 0 0 1 100 0]", b"BT /F1 10 Tf (form) Tj ET /X0 Do")
    image = ("/Type/XObject/Subtype/Image/Width 2/Height 1/ColorSpace/DeviceGray/BitsPerComponent 8", b"\x00\xff")
    data = build(pages(b"/X0 Do q 30 0 0 40 5 6 cm /I0 Do Q /None Do", more={50: form, 51: image}, resources="/XObject<</X0 50 0 R/I0 51 0 R>>"))
    got = extract(data, recover=False)
    assert [(r["text"], r["x"]) for r in got["runs"]] == [("form", 100.0)]
    assert "cycle_detected" in [e["kind"] for e in got["events"]]
    i = got["images"][0]
    assert (i["kind"], i["bytes"], i["width"], i["height"], i["render_width"], i["render_height"], i["x"], i["y"], i["ref"]) == ("pixels", b"\x00\xff", 2, 1, 30.0, 40.0, 5.0, 6.0, "51 0")
    inline = extract(build(pages(b"q BI /W 2 /H 1 /CS /G /BPC 8 ID \x00\xff EI Q BT /F1 1 Tf (x) Tj ET")), recover=False)
    assert inline["images"][0]["bytes"] == b"\x00\xff" and inline["runs"][0]["text"] == "x"


def test_encodings():
    assert encodings.table("WinAnsiEncoding")[0x80] == "€" and encodings.table("MacRomanEncoding")[0x8A] == "ä" and encodings.table("StandardEncoding")[0x27] == "’"
    assert [encodings.glyph(n) for n in ("A", "eacute", "Scaron", "uni20AC", "u1F600", "f_i", "a.alt", "Omega", "alpha", "zero", "nosuch")] == ["A", "é", "Š", "€", "😀", "fi", "a", "Ω", "α", "0", None]
    assert encodings.differences([65, "x", "y", 70, "z"]) == {65: "x", 66: "y", 70: "z"}
    font = "<</Type/Font/Subtype/Type1/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[65/eacute/nosuch]>>>>"
    r = runs(b"BT /F1 1 Tf (ABC) Tj ET", font=font)[0]
    assert r["text"] == "é�C" and r["unresolved"] == [{"idx": 1, "marker": "nosuch"}]
    r = runs(b"BT /F1 1 Tf (A) Tj ET", font="<</Type/Font/Subtype/Type1>>")[0]
    assert r["text"] == "�" and r["unresolved"] == [{"idx": 0, "marker": "byte:0x41"}]


def test_to_unicode_and_widths():
    cmap = b"begincmap 1 beginbfchar <41> <00660069> endbfchar 2 beginbfrange <42> <43> <0061> <44> <45> [<0078> <0079>] endbfrange endcmap"
    font = "<</Type/Font/Subtype/TrueType/ToUnicode 60 0 R/FirstChar 65/Widths[1000 200]/FontDescriptor<</MissingWidth 300>>>>"
    got = runs(b"BT /F1 10 Tf (ABCDE) Tj (A) Tj ET", font=font, more={60: ("", cmap)})
    assert got[0]["text"] == "fiabxy" and got[1]["x"] == pytest.approx(10 + 2 + 9)


def test_identity_and_predefined_cmaps(tmp_path):
    cmap = b"beginbfchar <0041> <4E00> endbfchar"
    cmap = b"1 " + cmap
    font = "<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 60 0 R/DescendantFonts[<</Subtype/CIDFontType2/DW 500/W[65[250] 70 71 100]>>]>>"
    got = runs(b"BT /F1 10 Tf <00410042> Tj <0046> Tj <0041> Tj ET", font=font, more={60: ("", cmap)})
    assert got[0]["text"] == "一�" and got[0]["unresolved"] == [{"idx": 1, "marker": "cid:0x0042"}]
    assert [r["x"] for r in got] == [0.0, 7.5, 8.5]
    (tmp_path / "Base").write_bytes(b"1 begincodespacerange <00> <7F> endcodespacerange 1 begincidrange <20> <7e> 1 endcidrange")
    (tmp_path / "Own-H").write_bytes(b"/Base usecmap 1 begincodespacerange <8140> <9FFC> endcodespacerange 1 begincidchar <8140> 633 endcidchar")
    m = cmaps.predefined("Own-H", str(tmp_path))
    assert m.split(b"\x81\x40") == [b"\x81\x40"] and m.cid(b"\x81\x40") == 633 and m.cid(b"\x21") == 2
    (tmp_path / "Loop").write_bytes(b"/Loop usecmap")
    with pytest.raises(PdfError):
        cmaps.predefined("Loop", str(tmp_path))
    (tmp_path / "UniJIS-UTF16-H").write_bytes(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 begincidrange <4e00> <4e02> 1200 endcidrange")
    assert cmaps.cid_texts("Japan1", str(tmp_path))[1201] == "丁"


def test_structure_of_written_files():
    doc = Pdf("a4", 40).set_info(title="Tïtel", author="A").text("one").add_page().text("two")
    doc.add_outline("first", 1).add_outline("inner", 2, 1).add_outline("last", 2)
    doc.link((0, 0, 5, 5), url="mailto:a@b.cd").link((1, 1, 2, 2), page=1).note((0, 0, 9, 9), "said", "me")
    doc.field("p.name", "Tx", "Ann", tooltip="tip").field("p.ok", "Btn", b"Yes").field("p.no", "Btn", b"Off").field("r", "Btn", b"b", flags=1 << 15).field("push", "Btn", flags=1 << 16).field("many", "Ch", ["a", "b"], flags=1 << 21 | 1).field("sig", "Sig")
    got = extract(doc.export(), recover=False)
    assert {(m["key"], m["value"]) for m in got["meta"]} == {("Title", "Tïtel"), ("Author", "A")}
    assert [(o["title"], o["level"], o["parent_id"], o["ord"], o["dest_page"]) for o in got["outlines"]] == [("first", 0, None, 0, 1), ("inner", 1, 0, 0, 2), ("last", 0, None, 1, 2)]
    assert [(a["type"], a["page"], a["url"], a["dest_page"], a["contents"]) for a in got["annotations"]] == [("link", 2, "mailto:a@b.cd", None, None), ("link", 2, None, 1, None), ("text", 2, None, None, "said")]
    f = {x["name"]: x for x in got["fields"]}
    assert f["p.name"]["value"]["s"] == "Ann" and f["p.name"]["tooltip"] == "tip" and f["p.name"]["partial_name"] == "name"
    assert (f["p.ok"]["value"]["b"], f["p.no"]["value"]["b"], f["r"]["value"]["s"], f["push"]["value"]["kind"], f["many"]["value"]["arr"], f["sig"]["value"]["kind"]) == (True, False, "b", "none", ["a", "b"], "none")
    assert f["many"]["flags"]["multi_select"] and f["many"]["flags"]["read_only"] and not f["many"]["flags"]["required"]


def test_named_destinations_and_outline_loops():
    objects = pages(HELLO, HELLO)
    objects[1] = "<</Type/Catalog/Pages 2 0 R/Names<</Dests 60 0 R>>/Dests<</old[10 0 R/Fit]>>/Outlines 61 0 R>>"
    objects |= {60: "<</Kids[<</Names[(in)[11 0 R/Fit]]>>]>>", 61: "<</First 62 0 R>>", 62: "<</Title(a)/Dest(in)/Next 63 0 R>>", 63: "<</Title(b)/A<</S/GoTo/D/old>>/Next 62 0 R/First 64 0 R>>", 64: "<</Title(c)/A<</S/URI/URI(x)>>/First 63 0 R>>"}
    got = extract(build(objects), {"outlines"}, recover=False)["outlines"]
    assert [(o["title"], o["level"], o["dest_page"]) for o in got] == [("a", 0, 2), ("b", 0, 1), ("c", 1, None)]


def test_xmp_wins():
    doc = Pdf().set_info(title="info", author="A")
    doc.xmp = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:pdf="http://ns.adobe.com/pdf/1.3/" pdf:Keywords="k"><dc:title><rdf:Alt><rdf:li xml:lang="fr">non</rdf:li><rdf:li xml:lang="x-default">xmp</rdf:li></rdf:Alt></dc:title></rdf:Description></rdf:RDF></x:xmpmeta>'
    got = {m["key"]: (m["value"], m["origin"]) for m in extract(doc.export(), {"meta"})["meta"]}
    assert got == {"Title": ("xmp", "xmp"), "Author": ("A", "info"), "Keywords": ("k", "xmp")}


def test_only_some_pages_are_read():
    data = build(pages(HELLO, None, HELLO))
    got = extract(data, {"runs", "docs"}, pages={3})
    assert [r["page"] for r in got["runs"]] == [3] and events(got) == [] and got["docs"][0]["page_count"] == 3


def test_deep_forms_stop():
    forms = {50 + k: (f"/Type/XObject/Subtype/Form/Resources<</XObject<</N {51 + k} 0 R>>>>", b"/N Do") for k in range(12)}
    doc = Document(build(pages(b"/N Do", more=forms | {62: ("/Type/XObject/Subtype/Form", b"")}, resources="/XObject<</N 50 0 R>>")))
    got = Interpreter(doc, lambda r: {}).run(b"/N Do", doc.resolve(doc.leaves()[0][2][0]["Resources"]))
    assert [e.kind for e in got] == ["max_depth_exceeded"]
