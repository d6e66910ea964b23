"""Operator 6 [native]: document fingerprints as a Merkle tree over clauses, paragraphs and sections.

DataFrame functions only. A text's paragraphs are its lines. The leaves are the clauses of a paragraph: words up to and including one
of seven or more characters with its space (a border made by content, so an insertion moves no other border). A section is a run of
paragraphs that ends after one whose hash starts with a hex digit of '0' or '1' (about every
eighth: again a border made by content). Node hashes: a clause's is the start of the md5 of its text, a
paragraph's the md5 of its clauses' hashes, a section's the md5 of its paragraphs' hashes, the root sha2-256
of the sections' hashes. The root is the fingerprint: equal texts have equal roots, and
differing branches are found by comparing the sections, then the paragraphs of those that
differ (``changes``). The likeness of two trees comes from their leaves: the
mean of the shares of each one's distinct leaves that the other has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one window group, about; ids are cut at quantiles, so gaps and clusters of ids do not matter.
GROUP = 512
#: Groups at most, so that what the driver holds and broadcasts is bounded; beyond it groups grow instead.
GROUPS = 32_768

MARK = "\u0001"


#: Hash of a clause without a character, which is no leaf to compare by.
BLANK = "d41d8cd98f00b204"


def leaves(text: Column) -> Column:
    """Clause hashes (16 hex digits of md5) of each line."""
    clause = lambda x: F.substring(F.md5(x.cast("binary")), 1, 16)
    return F.transform(F.split(text, "\n", -1), lambda line: F.transform(F.split(F.regexp_replace(line, "([^ ]{7} )", f"$1{MARK}"), MARK, -1), clause))


def paragraphs(tree: Column) -> Column:
    """Hash of each line from its clauses' hashes."""
    return F.transform(tree, lambda x: F.md5(F.array_join(x, "").cast("binary")))


def sections(hashes: Column) -> Column:
    """Section hashes of paragraph hashes: joined, cut after those that start with 0 or 1, hashed again."""
    marked = F.array_join(F.transform(hashes, lambda x: F.concat(x, F.when(F.substring(x, 1, 1).isin("0", "1"), F.lit("|")).otherwise(F.lit("")))), "")
    return F.transform(F.split(F.regexp_replace(marked, "\\|$", ""), "\\|", -1), lambda x: F.md5(x.cast("binary")))


def root(section_hashes: Column) -> Column:
    return F.sha2(F.array_join(section_hashes, "").cast("binary"), 256)


def fingerprint(text: Column) -> Column:
    return root(sections(paragraphs(leaves(text))))


def distinct_leaves(tree: Column) -> Column:
    return F.array_remove(F.array_distinct(F.flatten(tree)), BLANK)


def likeness(a: Column, b: Column) -> Column:
    """Mean of the shares of each array's distinct hashes that the other has; two empty ones are alike."""
    both, n, m = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise((both / n + both / m) / 2.0)


def changes(before: Column, after: Column) -> Column:
    """Where two trees differ: indexes of the sections and paragraphs of ``after`` that ``before`` lacks."""
    old, new = paragraphs(leaves(before)), paragraphs(leaves(after))

    def missing(had: Column, have: Column) -> Column:
        return F.filter(F.transform(have, lambda x, i: F.when(F.array_contains(had, x), F.lit(-1)).otherwise(i)), lambda i: i >= 0)

    return F.struct(missing(sections(old), sections(new)).alias("sections"), missing(old, new).alias("paragraphs"))


def _group(bounds: list[int], key: Column) -> Column:
    """How many bounds are <= key, by bisection over a literal array (a power of two less one)."""
    if not bounds:
        return F.lit(0)
    step = (len(bounds) + 1) // 2
    out = F.lit(0)
    array = F.array(*map(F.lit, bounds)) if len(bounds) < 64 else F.expr("array(" + ",".join(f"{b}L" for b in bounds) + ")")
    steps = []
    while step:
        steps.append(step)
        step //= 2
    return F.aggregate(F.array(*map(F.lit, steps)), out, lambda lo, s: F.when(F.get(array, lo + s - 1) <= key, lo + s).otherwise(lo))


def deal_in_order(df: DataFrame, group: int = GROUP) -> DataFrame:
    """df (doc_id, text) dealt so that a window over __g by (__last, __k, text) sees each row's successor by doc_id.

    Rows are grouped by ranges of ids, the ranges from quantiles. A copy of each range's first row
    (__last = 1) closes the range before it, and the very first row (__last = 2) closes the last one,
    so one shuffle of the rows and windows over small groups suffice. Null ids come first; rows with
    one id follow each other by text."""
    spark = df.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))
    ids = df.select("doc_id", key.alias("k"))
    n, size = ids.count(), 1
    while size < GROUPS and size * group < n:
        size *= 2
    bounds = []
    if size > 1:
        marks = F.percentile_approx("k", F.array(*[F.lit(k / size) for k in range(1, size)]), F.lit(max(10_000, 4 * size)))
        bounds = [int(x) for x in ids.agg(marks.alias("q")).first()["q"]]
    g = _group(bounds, key).cast("int")
    heads = [(r["g"], r["k"]) for r in ids.groupBy(g.alias("g")).agg(F.min("k").alias("k")).orderBy("g").collect()]  # GROUPS rows at most
    to = [(k, heads[i - 1][0], 2 if i == 0 else 1) for i, (_, k) in enumerate(heads)]
    rows = df.select("*", key.alias("__k"), g.alias("__g"), F.lit(0).alias("__last"))
    copies = df.select("*", key.alias("__k")).join(F.broadcast(spark.createDataFrame(to, "__k long, __g int, __last int")), "__k")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.unionByName(copies).repartition(parts, "__g")


def fingerprint_edits(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs.

    The edited text is the first n - floor(n/2) code points, then as many of the next document's as
    were taken away (or all it has). Defined cases: null text is ''; one document is its own next;
    null ids come first; repeated ids follow each other by text; an empty table gives an empty result."""
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = deal_in_order(base)
    w = Window.partitionBy("__g").orderBy("__last", "__k", "text")
    own = dealt.withColumn("tree", leaves(F.col("text"))).withColumn("next_text", F.lead("text").over(w)).withColumn("next_tree", F.lead("tree").over(w)).where("__last = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    own = own.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    own = own.withColumn("edited_tree", leaves(F.col("edited")))
    c, e, following = (distinct_leaves(F.col(x)) for x in ("tree", "edited_tree", "next_tree"))
    return own.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        root(sections(paragraphs(F.col("tree")))).alias("fingerprint"),
        root(sections(paragraphs(F.col("edited_tree")))).alias("edited_fingerprint"),
        likeness(c, e).alias("near_edited"),
        likeness(c, following).alias("near_next"),
        F.size("tree").alias("n_paragraphs"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS rn, count(*) OVER () AS n FROM d),
e AS (SELECT a.doc_id, a.text, b.text AS next_text, length(a.text)::BIGINT AS n_chars,
        substr(a.text, 1, length(a.text) - length(a.text) // 2) || substr(b.text, 1, length(a.text) // 2) AS edited
      FROM o a JOIN o b ON b.rn = a.rn % a.n + 1),
t AS (SELECT *, list_transform(string_split(text, chr(10)), lambda l: list_transform(string_split(regexp_replace(l, '([^ ]{7} )', '\1' || chr(1), 'g'), chr(1)), lambda x: substr(md5(x), 1, 16))) AS t1,
        list_transform(string_split(edited, chr(10)), lambda l: list_transform(string_split(regexp_replace(l, '([^ ]{7} )', '\1' || chr(1), 'g'), chr(1)), lambda x: substr(md5(x), 1, 16))) AS t2,
        list_transform(string_split(next_text, chr(10)), lambda l: list_transform(string_split(regexp_replace(l, '([^ ]{7} )', '\1' || chr(1), 'g'), chr(1)), lambda x: substr(md5(x), 1, 16))) AS t3 FROM e),
p AS (SELECT *, list_transform(t1, lambda x: md5(array_to_string(x, ''))) AS p1, list_transform(t2, lambda x: md5(array_to_string(x, ''))) AS p2 FROM t),
s AS (SELECT *,
        list_transform(string_split(regexp_replace(array_to_string(list_transform(p1, lambda x: x || CASE WHEN x[1] IN ('0', '1') THEN '|' ELSE '' END), ''), '\|$', ''), '|'), lambda x: md5(x)) AS s1,
        list_transform(string_split(regexp_replace(array_to_string(list_transform(p2, lambda x: x || CASE WHEN x[1] IN ('0', '1') THEN '|' ELSE '' END), ''), '\|$', ''), '|'), lambda x: md5(x)) AS s2,
        list_filter(list_distinct(flatten(t1)), lambda x: x <> 'd41d8cd98f00b204') AS c1, list_filter(list_distinct(flatten(t2)), lambda x: x <> 'd41d8cd98f00b204') AS c2, list_filter(list_distinct(flatten(t3)), lambda x: x <> 'd41d8cd98f00b204') AS c3
      FROM p)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
  sha256(array_to_string(s1, '')) AS fingerprint, sha256(array_to_string(s2, '')) AS edited_fingerprint,
  CASE WHEN len(c1) + len(c2) = 0 THEN 1.0 WHEN len(c1) * len(c2) = 0 THEN 0.0 ELSE (len(list_intersect(c1, c2))::DOUBLE / len(c1) + len(list_intersect(c1, c2))::DOUBLE / len(c2)) / 2.0 END::DOUBLE AS near_edited,
  CASE WHEN len(c1) + len(c3) = 0 THEN 1.0 WHEN len(c1) * len(c3) = 0 THEN 0.0 ELSE (len(list_intersect(c1, c3))::DOUBLE / len(c1) + len(list_intersect(c1, c3))::DOUBLE / len(c3)) / 2.0 END::DOUBLE AS near_next,
  len(p1)::INTEGER AS n_paragraphs
FROM s
"""
