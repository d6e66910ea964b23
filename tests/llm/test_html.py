"""Operator 2: main text."""

import math
import random

from foliospark.llm import html_style_tree as h

from .fixtures import prose

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site head</header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<main><article><h1>Title &amp; more</h1><p>First   para
graph.<p>Second &lt;b&gt; <b>bold</b>&nbsp;x<br>line<table><tr><td>c1<td>c2</table><form><input value=x>Sign up</form></article>
<aside class="sidebar">Side</aside><section id="comments"><p>Reader says</p></section></main><footer>(c)</footer></body></html>"""


def test_main_text():
    assert h.main_text(PAGE) == "Title & more First para graph. Second <b> bold x line c1 c2"


def test_broken_markup():
    assert h.main_text("") == ""
    assert h.main_text("plain a < b & c") == "plain a < b & c"
    assert h.main_text("<p>one<div>two</p>three") == "one two three"
    assert h.main_text("<!-- open <p>never") == ""
    assert h.main_text("<script>alert(1)") == ""


def test_site_furniture_goes_and_articles_stay(spark):
    rows = [(k, f"http://a.example/{k}", f"<body><div><p>{prose(k, 20)}</p></div><div><p>Same on every page of this site</p></div></body>") for k in range(30)]
    rows += [(100, "http://b.example/1", "<body><p>Same on every page of this site</p></body>"), (101, None, None), (102, "http://a.example/x", ""), (103, "x", "<p>no host</p>")]
    got = {r.page_id: r for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert all(got[k].text == prose(k, 20) for k in range(30))
    assert got[100].text == "Same on every page of this site"
    assert (got[101].text, got[101].n_chars, got[102].text, got[103].text) == ("", 0, "", "no host")


def test_copies_of_a_page_keep_their_article(spark):
    page = "<body><article><h1>H</h1><p>Text of the article.</p></article></body>"
    got = h.extract(spark.createDataFrame([(k, "http://a.example/", page) for k in range(20)], "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"H Text of the article."}


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "t", 5, "h", None)], "page_id long, url string, html string, text string, n_chars int, host string, keys string")
    assert h.extract(df).first().text == "x"
    assert h.extract(df.limit(0)).count() == 0


def test_hot_hosts_are_dealt_and_change_nothing(spark, monkeypatch):
    rows = [(k, f"http://{'hot' if k % 3 else k % 9}.example/{k}", f"<body><div><p>{prose(k, 5)}</p></div><div><p>Furniture</p></div></body>") for k in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r.page_id: r.text for r in h.extract(df).collect()}
    monkeypatch.setattr(h, "HOST_PAGES", 7)
    assert {r.host: r.parts for r in h.hot_hosts(h.page_trees(df, url_col="url", html_col="html")).collect()}["hot.example"] == 9
    assert {r.page_id: r.text for r in h.extract(df).collect()} == want
    assert want[1] == prose(1, 5)


def test_a_notice_inside_the_article_goes(spark):
    rows = [(k, f"http://a.example/{k}", f"<body><article><h1>{prose(k, 4)}</h1><p>{prose(500 + k, 30)}</p><p>All rights reserved by this site.</p></article></body>") for k in range(40)]
    # the same notice on a host where it is rare stays
    rows += [(100 + k, f"http://b.example/{k}", f"<body><article><p>{prose(900 + k, 30)}</p>{'<p>All rights reserved by this site.</p>' if k < 3 else ''}</article></body>") for k in range(40)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"{prose(k, 4)} {prose(500 + k, 30)}" for k in range(40))
    assert all(("All rights" in got[100 + k]) == (k < 3) for k in range(40))


def test_a_branch_goes_as_a_whole(spark):
    # one text of its own among nine that every page has: the branch is of low importance
    box = "".join(f"<div>Fixed line {i}</div>" for i in range(19))
    rows = [(k, f"http://a.example/{k}", f"<body><div><p>{prose(k, 20)}</p></div><section class=k>{box}<div>Visitor {k}</div></section></body>") for k in range(300)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == prose(k, 20) for k in range(300))


def brute(pages, least):
    """The same tree, worked out page by page in dictionaries."""
    trees = {k: h.parse(page) for k, (_, page) in pages.items()}
    texts, styles, size, classes = {}, {}, {}, {}
    for k, (host, _) in pages.items():
        copy, rows = h.tree_rows(trees[k])
        classes.setdefault((host, copy), []).append(sorted(rows))
    for (host, _), alike in classes.items():
        size[host] = size.get(host, 0) + 1
        for node, value, is_text in min(alike):
            if is_text:
                texts[host, value] = texts.get((host, value), 0) + 1
            else:
                s = styles.setdefault((host, node), {})
                s[value] = s.get(value, 0) + 1

    def text(host, key):
        m, n = size[host], texts.get((host, key), 1)
        return 1 - math.log(n) / math.log(m) * (m - 1) / m if m > 1 else 1.0

    def low(host, n):
        return n > 1 and text(host, n) <= least

    def element(host, n):
        if not n.kids:
            return 1.0
        s = styles.get((host, h._signed(n.path)), {}).values()
        m = sum(s)
        pages_of_host = size[host]
        if pages_of_host < 2 or m < 0.999 * pages_of_host ** ((1 - least) * pages_of_host / (pages_of_host - 1)):
            return 1.0  # too few pages to be furniture
        flat = -sum(x / m * math.log(x / m) for x in s) / math.log(m) if m > 1 else 1.0
        g = h.GAMMA ** len(s)
        own = (1 - g) * (1 - (1 - flat) * (m - 1) / m)
        return own + g * sum(element(host, k) if isinstance(k, h.Node) else text(host, h.text_key(n.path, k)) for k in n.kids) / len(n.kids)

    def walk(host, n, out):
        if n.dropped or n.tag and n.tag not in h.ROOTS and element(host, n) <= least:
            return
        for k in n.kids:
            if isinstance(k, h.Node):
                walk(host, k, out)
            elif text(host, h.text_key(n.path, k)) > least:
                out[n.region].append(k)

    got = {}
    for k, (host, _) in pages.items():
        out = [[], [], []]
        walk(host, trees[k], out)
        got[k] = " ".join(out[2] or out[1] or out[0])
    return got


def test_against_brute_force(spark):
    r = random.Random(3)
    pages = {}
    for k in range(240):
        blocks = [f"<{t}{c}>{prose(r.choice([1, 2, 3, 1000 + k]), 3)}</{t}>" for t, c in ((r.choice(["p", "div", "li"]), r.choice(["", " class=a", " class=b"])) for _ in range(r.randrange(1, 7)))]
        pages[k] = f"h{k % 7 if k % 2 else 0}.example", f"<body><div>{''.join(blocks)}</div><p>Fixed</p>{'<article><p>' + prose(k, 9) + '</p><p>Fixed</p></article>' if k % 3 else ''}</body>"
    pages[240] = "h0.example", pages[2][1]
    want = brute(pages, 0.15)
    df = spark.createDataFrame([(k, f"https://{host}/{k}", page) for k, (host, page) in pages.items()], "page_id long, url string, html string")
    assert {x.page_id: x.text for x in h.extract(df).collect()} == want
    assert len({v for v in want.values()}) > 100


def test_class_names_do_not_delete_articles():
    for page, text in (
        ('<article class="article-search-engines"><p>x</p></article>', "x"),
        ('<article class="post comments-open"><p>a</p></article>', "a"),
        ('<p>k</p><div class="legal-analysis">x</div><div id="share-prices">p</div>', "k x p"),
        ('<p>k</p><div class="site-footer">f</div><div class="comment-list">c</div><div class="ad ad1">a</div>', "k"),
        ("<p>a</p><!--><p>b</p>", "a b"),
        ('a <p class="x>leak c', "a leak c"),
        ("<p>f <math><mi>x</mi></math> <svg><text>y</text></svg></p>", "f x y"),
        ("<p>Hi <button>Share</button> there</p>", "Hi there"),
    ):
        assert h.main_text(page) == text


def test_a_very_long_page_and_repeated_rows(spark):
    body = "".join(f"<p>{prose(k, 40)}</p>" for k in range(3000))
    rows = [(1, "http://a.example/", f"<article>{body}</article>"), (2, "http://b.example/", "<p>twice</p>"), (2, "http://b.example/", "<p>twice</p>"), (None, "http://c.example/", "<p>no id</p>")]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in got)[-1] == sum(len(prose(k, 40)) + 1 for k in range(3000)) - 1
    assert sorted(r.text for r in got)[-2:] == ["twice", "twice"] and len(got) == 4


def test_pages_travel_compressed(spark):
    """And come back as they were: null, empty, long, any letters."""
    html = [None, "", "<p>a</p>", "<p>" + prose(3, 3000) + "</p>", "Ünïcödé 漢字 😀\x00"]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    rows = h.packed(df).collect()
    assert [h.unpacked(r.html) for r in rows] == [x or "" for x in html]
    assert len(rows[3].html) < 0.6 * len(html[3])
