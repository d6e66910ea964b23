"""Operator 2: main text of web pages by a site style tree.

Pass 1 parses every page into its tree of block elements. The trees of one host merge into a site style tree:
an element node is a presentation path (tags with classes from the root), its style nodes are the sequences of
children (repeats as one) that pages give it, and its leaves are the texts that stand there. What is kept of the merged tree
are counts: in how many pages a node has each sequence, and each text. Pages of a host with
the same longest text are copies and count once, so an article that stands at many addresses is no furniture.

Importance, from entropies to the base of the number of pages m:
* presentation: an element whose pages all lay it out alike has 0, one that each page lays out its own way has 1;
* content: a text on n of m pages spreads evenly, so it has 1 - log n / log m: page-specific text has 1, furniture 0;
* both shrink towards 1 by (m - 1) / m, so a few pages prove little and one page proves nothing;
* composite: (1 - g**l) x presentation + g**l x mean composite of the children, with l style nodes and
  g = ``GAMMA``, worked out from the leaves to the root of each page's own tree.
Pass 2 takes each page's tree and removes every branch of composite importance ``least`` or less (never the body, main or an article as a
whole, only what stands in it), together with elements whose tag or classes say menu, header, footer, sidebar, notice, advert,
form or comments, whose texts can differ on every page. What is left of the article
(or <main>, or else the body) is the main text.

Only what stands on as many pages as a text of low importance is judged at all, about m**(1 - least) of m; the rest has importance 1.

Scale: pages become rows of 64-bit hashes; copies, nodes and texts are counted with map-side combining, so a hot host is
spread over its contents. A host has at most nodes_per_page * m**least nodes that are judged. Their list
joins the pages by host. Hosts that hold a share of 1 / ``HOT`` of all pages or more (so ``HOT`` hosts at
most, the only thing broadcast) are dealt over as many parts as they hold such shares, each with a copy of the list.

Defined cases: null or empty html gives '' and 0; null urls share one host ''; equal importances are equal decisions;
broken markup, unclosed elements, unclosed quotes and bare '<' are text or closed by their parents; repeated rows are
pages of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, map_arrow

HOT = 10_000
#: Pages that one task takes of a host in any case.
HOST_PAGES = 250
GAMMA = 0.9

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style|template|noscript|textarea|title|iframe|noembed|noframes)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
DROP_TAG = frozenset("nav footer header aside form menu button select dialog head iframe object embed applet canvas audio video map".split())
DROP_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay "
    "sidebar aside rail widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar topbar header masthead footer colophon copyright legal "
    "comment comments reply replies disqus respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search skip".split()
)
#: Words that stand beside such a word and say nothing of their own: "site-footer", "comment-list".
PLAIN_WORD = frozenset("site page main top bottom left right inner outer box bar list item items container wrapper wrap section area block slot unit links link primary secondary global content the js new".split())
#: Never dropped by a class.
ROOTS = frozenset("html body main article".split())
CLOSES_P = BLOCK - {"br", "option", "body", "html", "head"}
#: An element of the key's kind ends an open one of the value's, within the nearest list, table or select.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = frozenset("ul ol dl table select article section div body html main td th".split())


def says_drop(names: str) -> bool:
    """Whether one of the names (classes or an id) is made of words that say furniture, with plain ones at most beside."""
    for name in names.split():
        words = [w for w in (x.rstrip("0123456789") for x in re.split(r"[^a-z0-9]+", name)) if w]
        if any(w in DROP_WORD for w in words) and all(w in DROP_WORD or w in PLAIN_WORD for w in words):
            return True
    return False


def _style(attrs: str) -> tuple[str, bool, bool]:
    """Classes and id as they show in the path, whether a word says to drop, whether it is the article."""
    style, drop, main = [], False, False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            drop = True
        elif name in ("class", "id"):
            style.append(f"{name[0]}={value}")
            drop |= says_drop(value)
        elif name == "role":
            drop |= value in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu")
            main |= value in ("main", "article")
        elif name == "itemprop":
            main |= value == "articlebody"
    return ";".join(style), drop, main


class Node:
    """A block element: its path's hash, its children (Nodes and texts) in order, whether a rule drops it, its region (2: article, 1: main)."""

    __slots__ = ("tag", "path", "sign", "kids", "dropped", "region")

    def __init__(self, tag: str, path: int, sign: int, dropped: bool, region: int):
        self.tag, self.path, self.sign, self.kids, self.dropped, self.region = tag, path, sign, [], dropped, region


def parse(page: str) -> Node:
    """The page's tree of block elements."""
    root = Node("", 0, 0, False, 0)
    # open elements: tag, the block element that holds their text, whether their text is dropped within it
    stack: list[tuple[str, Node, bool]] = [("", root, False)]
    parts: list[str] = []
    hashes: dict[tuple, tuple[int, int]] = {}

    def flush() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                stack[-1][1].kids.append(text)
            parts.clear()

    def push(tag: str, attrs: str) -> None:
        _, above, silent = stack[-1]
        style, drop, main = _style(attrs) if attrs.strip(" /") else ("", False, False)
        drop = tag in DROP_TAG or drop and tag not in ROOTS
        region = 2 if tag == "article" or main and tag != "main" else 1 if tag == "main" or main else 0
        if tag not in BLOCK and not region:
            stack.append((tag, above, silent or drop))
            return
        key = (above.path, tag, style)
        if (h := hashes.get(key)) is None:
            h = hashes[key] = xxhash.xxh64_intdigest(f"{above.path}/{tag}.{style}"), xxhash.xxh64_intdigest(f"{tag}.{style}")
        node = Node(tag, *h, above.dropped or silent or drop, max(above.region, region))
        above.kids.append(node)
        stack.append((tag, node, False))

    def pop_to(k: int) -> None:
        if any(e[0] in BLOCK for e in stack[k:]):
            flush()
        del stack[k:]

    def say(text: str) -> None:
        if not stack[-1][2]:
            parts.append(text)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in BLOCK:
            flush()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break  # an inline end tag does not close a block
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ENDS[tag]:
                    pop_to(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        push(tag, m[4] or "")
    if at < len(page):
        say(page[at:])
    flush()
    return root


def nodes(root: Node) -> list[Node]:
    """All elements, parents before their children."""
    out, left = [], [root]
    while left:
        n = left.pop()
        out.append(n)
        left += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_key(path: int, text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), path & 0xFFFFFFFFFFFFFFFF))


def style_key(n: Node) -> int:
    """Hash of an element's sequence of children, repeats as one."""
    signs, last = [], None
    for k in n.kids:
        sign = k.sign if isinstance(k, Node) else 1
        if sign != last:
            signs.append(sign)
        last = sign
    return _signed(xxhash.xxh64_intdigest(repr(signs), n.path))


def tree_rows(root: Node) -> tuple[int, set[tuple[int, int, bool]]]:
    """What makes a page a copy (hash of its longest text), and its (node, style or text, whether text) in the merged tree."""
    longest, rows = "", set()
    for n in nodes(root):
        if n.kids:
            rows.add((_signed(n.path), style_key(n), False))
        for k in n.kids:
            if isinstance(k, str):
                rows.add((_signed(n.path), text_key(n.path, k), True))
                if len(k) > len(longest):
                    longest = k
    return text_key(0, longest), rows


def host(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1))


def page_trees(pages: DataFrame, *, url_col: str, html_col: str) -> DataFrame:
    """host, n (pages) and tree (node, value, is_text) of each class of copies on a host."""

    def run(b):
        trees = [tree_rows(parse(page or "")) for page in b.column(1).to_pylist()]
        tree = [[{"node": n, "value": v, "is_text": t} for n, v, t in sorted(rows)] for _, rows in trees]
        yield batch(host=b.column(0), copy=pa.array([c for c, _ in trees], pa.int64()), tree=pa.array(tree, pa.list_(pa.struct([("node", pa.int64()), ("value", pa.int64()), ("is_text", pa.bool_())]))))

    rows = map_arrow(pages.select(host(url_col).alias("host"), F.col(html_col).cast("string")), run, "host string, copy long, tree array<struct<node:bigint,value:bigint,is_text:boolean>>")
    return rows.groupBy("host", "copy").agg(F.count("*").alias("n"), F.min("tree").alias("tree")).select("host", "n", "tree")


def hot_hosts(trees: DataFrame) -> DataFrame:
    """host and parts (2 or more) of the at most ``HOT`` hosts that one task should not hold."""
    sizes = trees.groupBy("host").agg(F.sum("n").alias("n"))
    share = max(HOST_PAGES, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // HOT))
    return sizes.where(F.col("n") > share).select("host", F.ceil(F.col("n") / share).cast("long").alias("parts"))


def _trusted(m) -> F.Column:
    return (m - 1) / m


def style_tree(trees: DataFrame, *, least: float) -> DataFrame:
    """host, key, own, rest of what pass 2 needs of the merged tree: an element's composite importance is own + rest x its children's mean; a text's is own."""
    sizes = trees.groupBy("host").agg(F.count("*").cast("double").alias("m"))
    counts = cut(trees.select("host", F.explode("tree").alias("x")).select("host", "x.*").groupBy("host", "node", "value", "is_text").agg(F.count("*").cast("double").alias("n")))
    # the fewest pages on which a text can be of low importance: (1 - log n / log m) shrunk is least or less
    few = F.pow(F.col("m"), 1 - (F.lit(least) - 1 / F.col("m")) * F.col("m") / (F.col("m") - 1)) * 0.999
    of_host = lambda df: df.join(sizes.where("m > 1"), "host").where(F.col("n") >= few)
    content = 1 - F.log("n") / F.log("m") * _trusted(F.col("m"))
    texts = of_host(counts.where("is_text and n > 1")).select("host", F.col("value").alias("key"), content.alias("own"), F.lit(0.0).alias("rest")).where(F.col("own") <= least)
    styles = counts.where("not is_text").groupBy("host", "node").agg(F.sum("n").alias("n"), F.count("*").alias("l"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("n") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0)
    shown = 1 - (1 - entropy) * _trusted(F.col("n"))
    g = F.pow(F.lit(GAMMA), F.col("l"))
    return texts.union(of_host(styles).select("host", F.col("node").alias("key"), ((1 - g) * shown).alias("own"), g.alias("rest")))


def importances(root: Node, known: dict[int, tuple[float, float]]) -> dict[int, float]:
    """Composite importance of each element (by id()), from the leaves up; what is not known has 1."""
    out: dict[int, float] = {}
    for n in reversed(nodes(root)):
        own, rest = known.get(_signed(n.path), (1.0, 0.0))
        if n.kids and rest:
            own += rest * sum(out[id(k)] if isinstance(k, Node) else known.get(text_key(n.path, k), (1.0, 0.0))[0] for k in n.kids) / len(n.kids)
        out[id(n)] = own if n.kids else 1.0
    return out


def main_text(page: str, known: dict[int, tuple[float, float]] | None = None, least: float = 0.15) -> str:
    root = parse(page)
    found = importances(root, known) if known else {}
    kept: list[list[str]] = [[], [], []]  # by region
    left: list[tuple[Node, object]] = [(root, None)]
    while left:
        n, k = left.pop()
        if isinstance(k, str):
            if not known or known.get(text_key(n.path, k), (1.0, 0.0))[0] > least:
                kept[n.region].append(k)
            continue
        if n.dropped or known and n.tag and n.tag not in ROOTS and found[id(n)] <= least:
            continue
        left += [(k, None) if isinstance(k, Node) else (n, k) for k in reversed(n.kids)]
    return " ".join(kept[2] or kept[1] or kept[0])


def packed(rows: DataFrame) -> DataFrame:
    """rows with their html compressed, which every page travels with to its host's list."""
    at = rows.columns.index("html")

    def run(b):
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        cols = list(b.columns)
        cols[at] = pa.array([None if x is None else press(x) for x in cols[at].cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return map_arrow(rows, run, ", ".join(f"`{name}` {'binary' if k == at else rows.schema[k].dataType.simpleString()}" for k, name in enumerate(rows.columns)))


def unpacked(page: bytes | None) -> str:
    import zstandard

    return zstandard.decompress(page).decode() if page else ""


def extract(pages: DataFrame, *, least: float = 0.15, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    trees = cut(page_trees(pages, url_col=url_col, html_col=html_col))
    hot = hot_hosts(trees)
    known = style_tree(trees, least=least).join(F.broadcast(hot), "host", "left")
    known = known.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "key", "own", "rest")
    known = known.groupBy("host", "part").agg(F.collect_list(F.struct("key", "own", "rest")).alias("known"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host(url_col).alias("host"))
    rows = packed(rows.withColumn("spread", F.xxhash64("page_id", "url", F.length("html"))))
    dealt = rows.join(F.broadcast(hot), "host", "left").withColumn("part", F.pmod("spread", F.coalesce("parts", F.lit(1))))
    rows = dealt.join(known, ["host", "part"], "left").select("page_id", "url", "html", "known")

    def run(b):
        texts, last, own = [], None, {}
        for k, page in enumerate(b.column(2).to_pylist()):
            page = unpacked(page)
            got = b.column(3)[k]
            # pages of one host follow each other with the same list
            if last is None or not got.equals(last):
                last, own = got, {x["key"]: (x["own"], x["rest"]) for x in got.as_py() or ()}
            texts.append(main_text(page, own, least))
        yield batch(page_id=b.column(0), url=b.column(1), text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")
