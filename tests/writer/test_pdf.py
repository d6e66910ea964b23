import datetime as dt
import struct
import zlib

import pytest
from foliospark.binary import images
from foliospark.binary.extract import extract
from foliospark.writer import builder, charts, layout, metrics
from foliospark.writer.pdf import Pdf, color, date, serialize
from foliospark.writer.tables import Table, styled
from foliospark.writer.text import chunks, wrap


def page(doc, k=0):
    return b"\n".join(doc.pages[k].ops).decode("latin-1")


def test_values():
    assert serialize({"A": [1, 2.50, True, None, "N x", b"a(b)\\"]}) == b"<</A [1 2.5 true null /N#20x (a\\(b\\)\\\\)]>>"
    assert date(dt.datetime(2026, 1, 2, 3, 4, 5)) == "D:20260102030405"
    assert date(dt.datetime(2026, 1, 2, tzinfo=dt.timezone(dt.timedelta(hours=-3, minutes=-30)))) == "D:20260102000000-03'30"
    assert date(dt.datetime(2026, 1, 2, tzinfo=dt.UTC)).endswith("Z")
    assert color("red") == (1.0, 0.0, 0.0) and color("#0000FF") == (0.0, 0.0, 1.0) and color((0.1, 0.2, 0.3, 0.4)) == (0.1, 0.2, 0.3, 0.4) and color((255, 0, 51)) == (1.0, 0.0, 0.2)


def test_pages_cursor_templates():
    seen = []
    doc = Pdf("a4", {"top": 10, "right": 20, "bottom": 30, "left": 40})
    assert doc.content_area() == {"x": 40, "y": 30, "width": 535, "height": 802} and doc.cursor_xy() == (40, 832)
    doc.on_page("header", lambda d, i: seen.append(("h", i["number"]))).on_page("footer", lambda d, i: seen.append(("f", i["number"])))
    doc.move_down(100).move_right(5).add_page()
    assert doc.cursor_xy() == (40, 832) and doc.page_number() == 2
    doc.export()
    doc.export()
    assert seen == [("f", 1), ("h", 2), ("f", 2)]
    with pytest.raises(ValueError):
        doc.on_page("side", print)


def test_commands():
    doc = Pdf()
    doc.save_state().set_fill_color("red").set_line_width(2).rectangle(1, 2, 3, 4).fill_and_stroke().set_line_dash([3, 1]).set_line_cap("round").set_line_join("bevel").set_opacity(0.5).restore_state()
    assert page(doc) == "q\n1 0 0 rg\n2 w\n1 2 3 4 re\nB\n[3 1] 0 d\n1 J\n2 j\n/G1 gs\nQ"
    assert b"/ExtGState" in doc.export()


def test_text_and_fonts():
    doc = Pdf(margin=50).set_font("Times", 10, italic=True)
    assert doc.font == "Times-Italic"
    assert Pdf().set_font("Courier", 10, bold=True).text_width("abc") == pytest.approx(18)
    assert metrics.load("Helvetica").text_width("AV é", 1000) == 667 + 667 + 278 + 556
    with pytest.raises(ValueError):
        doc.set_font("Nowhere")
    with pytest.raises(ValueError):
        doc.text_at(0, 0, "漢", replacement=None)
    afm = metrics.parse_afm("FontName Own\nC 65 ; WX 700 ; N A ;\nC 86 ; WX 600 ; N V ;\nKPX A V -80\n")
    assert afm.text_width("AV", 1000, kerning=True) == 1220 and afm.kerned("AVA") == ["A", 80, "VA"]


def test_wrapping():
    m = len
    assert chunks("a-b c\nd") == ["a-", "b ", "c", "\n", "d"]
    assert wrap("aaa bbb ccc", 7, m) == ["aaa bbb", "ccc"]
    assert wrap("aaaaaaaaaa b", 4, m) == ["aaaaaaaaaa", "b"]
    assert wrap("a\n\nb", 9, m) == ["a", "", "b"] and wrap("", 5, m) == [""]
    assert wrap("extra­ordinary", 6, m) == ["extra-", "ordinary"] and wrap("soft­ly", 20, m) == ["softly"]
    left = Pdf().set_font("Courier", 10).text_wrap(0, 100, 30, 24, "aa bb cc dd ee ff")
    assert left == ["ee ff"]


def test_named_styles():
    doc = Pdf().register_style("a", size=1, color="red").register_style("b", style="a", size=2)
    assert doc.resolve_style("b") == {"size": 2, "color": "red"} and doc.resolve_style({"style": "a", "color": None, "x": 3}) == {"size": 1, "color": "red", "x": 3}
    assert doc.resolve_style("none") == {}


def test_images():
    px = bytes(range(24))
    png = images.encode_png(px, 4, 2)
    assert struct.unpack(">II", png[16:24]) == (4, 2)
    alpha = images.encode_png(bytes(range(16)), 2, 2)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x03xxxxxx" + bytes(10)
    assert images.jpeg_size(jpeg) == (7, 5, 3) and images.jpeg_size(b"x") is None
    doc = Pdf().image(png, 10, 20, 40).image(png, 1, 1).image(alpha, 5, 5, 8, 8).image(jpeg, 0, 0)
    got = extract(doc.export(), {"images"}, recover=False)["images"]
    assert [(i["kind"], i["width"], i["height"]) for i in got] == [("pixels", 4, 2), ("pixels", 4, 2), ("pixels", 2, 2), ("jpeg", 7, 5)]
    assert got[0]["bytes"] == px and (got[0]["render_width"], got[0]["render_height"]) == (40.0, 20.0) and got[0]["ref"] == got[1]["ref"]
    assert got[2]["bytes"] == bytes(v for k, v in enumerate(range(16)) if k % 4 != 3) and got[3]["bytes"] == jpeg
    assert images.color_type(8, 2, 2) == (4, 2) and images.color_type(7, 2, 2) is None
    assert zlib.decompress(images.decode_png(png)["data"])[1:13] == px[:12]


def test_tables():
    doc = Pdf("a4", 40).set_font("Courier", 10)
    t = Table([["a", "bbbb"], [("x", {"colspan": 2})], [None, "z"]], 200, col_options={0: {"min_width": 80}})
    assert sum(t.widths(doc)) == pytest.approx(200) and t.widths(doc)[0] >= 80
    assert Table([["a", "b"]], 100, col_options={1: {"width": 30}}).widths(doc) == [70, 30]
    o = Table([["c"], ["d"], ["e"]], 100, options={"color": "t"}, col_options={0: {"color": "col", "font_size": 1}}, row_options={"odd": {"color": "odd"}, -1: {"color": "last"}})
    assert [o.cells(r)[0][3]["color"] for r in range(3)] == ["col", "odd", "last"]
    long = Table([["head"], *[[f"row {k}"] for k in range(100)]], 300, repeat_header=1)
    long.flow(doc)
    got = [(r["page"], r["text"]) for r in extract(doc.export(), {"runs"}, recover=False)["runs"]]
    n = doc.page_number()
    assert n > 1 and [p for p, t in got if t == "head"] == list(range(1, n + 1)) and [t for _, t in got if t != "head"] == [f"row {k}" for k in range(100)]
    with pytest.raises(ValueError):
        Table([["x\n" * 200]], 100).flow(Pdf("a4", 40))
    s = styled([{"key": "a", "width": 50}, {"key": "b", "align": "right"}], [{"a": 1, "b": 2}], 150, footer=["", "sum"])
    assert s.widths(doc) == [50, 100] and [c[2] for c in s.cells(1)] == ["1", "2"]


def test_layout():
    assert layout.dimension("50%", 80) == 40 and layout.dimension("full", 80) == 80 and layout.dimension("auto", 80) is None and layout.dimension(7, 80) == 7
    assert layout.sides([1, 2]) == (1, 2, 1, 2) and layout.sides([1, 2, 3]) == (1, 2, 3, 2) and layout.sides(4) == (4, 4, 4, 4)
    assert layout.flow_height([1, 2, 3], 5) == 16 and layout.stack_height([(0, 10), (4, 3)]) == 10
    assert layout.reflow([(0, 10), (3, 20), (40, 5)], 2, 12) == ([0.0, 0.0, 22.0], 27.0)
    assert layout.weighted([1, 3], 84, 4) == [(0.0, 20.0), (24.0, 60.0)]
    assert layout.containing_block({"x": 0, "y": 100, "width": 50, "height": 40}, {"padding": [1, 2, 3, 4]}) == {"x": 4, "y": 99, "width": 44, "height": 36}


def test_charts():
    assert [charts.nice_max(v) for v in (0, -3, 1, 1.2, 17, 28, 42, 61, 90, 101)] == [10, 10, 1, 2, 20, 30, 50, 75, 100, 150]
    assert [charts.format_number(v) for v in (5, 9999, 10_000, 1_500_000, 2.25)] == ["5", "9999", "10.0K", "1.5M", "2.2"]
    assert [round(f[0], 3) for f in charts.pie_fractions([1, 3])] == [0.25, 0.75] and charts.pie_fractions([0.25])[0][0] == 0.25


SIMPLE = [t for t in builder.TYPES if t not in ("custom", "image", "qr", "barcode", *builder.CONTAINERS, *charts.CHARTS)]


@pytest.mark.parametrize("kind", SIMPLE)
def test_every_element_renders_without_properties(kind):
    assert extract(builder.render([{"type": kind}], {"margin": 30}).export(), {"docs"}, recover=False)["docs"][0]["page_count"] >= 1


CASES = {
    "alert": ({"title": "Mind", "message": "the gap", "kind": "error"}, ["x", "Mind", "the gap"]), "avatar": ({"initials": "AB"}, ["AB"]), "badge": ({"content": "new", "variant": "outline"}, ["new"]), "barcode": ({"data": "X1234"}, ["X1234"]),
    "blockquote": ({"content": "said", "cite": "who"}, ["said", "— who"]), "chip": ({"label": "tag"}, ["tag"]), "code_block": ({"content": "a\nb", "line_numbers": True, "title": "t"}, ["t", "1", "a", "2", "b"]), "footnote": ({"items": ["n"]}, ["1. n"]),
    "header": ({"text": "H"}, ["H"]), "key_value": ({"items": {"k": "v"}}, ["k", "v"]), "list": ({"items": ["a", ["b", ["c"]]], "kind": "numbered"}, ["1.", "a", "2.", "b", "1.", "c"]), "meter": ({"label": "m", "percent": 40}, ["m", "40%"]),
    "metric": ({"label": "m", "current": 12, "previous": 10}, ["m", "12", "+20.0%"]), "nav": ({"brand": "b", "links": ["x", "y"]}, ["b", "x   y"]), "progress": ({"value": 140, "show_label": True}, ["100%"]), "qr": ({"data": "q", "label": "l"}, ["l"]),
    "rating": ({"value": 9, "show_label": True}, ["5/5"]), "signature": ({"name": "n", "title": "t", "date": "d"}, ["n", "t", "d"]), "stat_card": ({"value": 1, "label": "l", "trend": "+"}, ["1", "l", "+"]), "step_indicator": ({"steps": ["s"]}, ["1", "s"]),
    "text": ({"content": "t", "align": "right"}, ["t"]), "timeline": ({"items": [{"date": "d", "title": "t", "text": "x"}]}, ["d", "t", "x"]), "toc": ({"items": [{"title": "t", "page": 4}], "dots": False}, ["t", "4"]), "table": ({"rows": [["a", "b"]]}, ["a", "b"]),
    "watermark": ({"text": "W"}, ["W"]), "horizontal_bar_chart": ({"data": [("a", 3)]}, ["a", "3"]), "pie_chart": ({"data": [("a", 1), ("b", 1)]}, ["a (50.0%)", "b (50.0%)"]),
    "box": ({"children": [{"type": "text", "content": "in"}], "padding": 4}, ["in"]), "card": ({"children": [{"type": "text", "content": "in"}]}, ["in"]), "row": ({"children": [{"type": "text", "content": "l"}, {"type": "text", "content": "r", "weight": 2}]}, ["l", "r"]),
    "column": ({"children": [{"type": "text", "content": "u"}, {"type": "text", "content": "d"}], "gap": 3}, ["u", "d"]), "stack": ({"children": [{"type": "text", "content": "s", "x": 3, "y": 5}]}, ["s"]),
}


@pytest.mark.parametrize("kind", CASES)
def test_elements_say_what_they_are_given(kind):
    props, want = CASES[kind]
    got = extract(builder.render([{"type": kind, **props}], {"margin": 30}).export(), {"runs"}, recover=False)["runs"]
    assert sorted(r["text"] for r in got if r["text"]) == sorted(want)


def test_templates_flow_and_named_styles():
    doc = builder.render([{"type": "text", "content": "x", "style": "big"}, [{"type": "spacer", "height": 700}], {"type": "text", "content": "next"}, {"type": "custom", "draw": lambda d: d.text_at(5, 5, "own")}, {"type": "paginator", "prefix": "p. "}], {"margin": 40, "styles": {"big": {"font_size": 30}}, "watermark": {"text": "W"}})
    got = extract(doc.export(), {"runs"}, recover=False)["runs"]
    assert [(r["page"], r["text"]) for r in got] == [(1, "W"), (1, "x"), (1, "next"), (1, "own"), (1, "p. 1")]
    assert next(r["size"] for r in got if r["text"] == "x") == 30.0
    with pytest.raises(ValueError):
        builder.render([{"type": "nothing"}])
    assert builder.measure_box_height({"padding": 5}, [{"type": "spacer", "height": 7}, {"type": "spacer", "height": 3}], 100) == 20


def test_boxes_higher_than_a_page_flow():
    doc = builder.render([{"type": "box", "children": [{"type": "spacer", "height": 300}] * 4 + [{"type": "text", "content": "end"}]}], {"margin": 40})
    assert doc.page_number() == 2
