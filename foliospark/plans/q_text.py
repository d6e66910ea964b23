"""Runs, lines, tokens, splits and shapes over the driver's tables; the oracle tells the same steps in SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lines as L
from ..operators import outlines as O
from ..operators import result as R
from ..operators import shapes as S
from ..session import spread
from .registry import query


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents_runs(spark, sf_dir):
    return L.word_runs(read(spark, sf_dir, "documents"))


def documents_pages(spark, sf_dir):
    return L.word_pages(read(spark, sf_dir, "documents"))


def part_runs(spark, sf_dir):
    return L.glyph_runs(read(spark, sf_dir, "part"), "p_partkey", "p_name")


def contact_pages(spark, sf_dir):
    """Pages whose words, put together, show a sign of a contact: a token is made of neighbouring words of one line, so others hold none."""
    return documents_pages(spark, sf_dir).where(T.may_hold_contact(F.replace("text", F.lit(" "), F.lit(""))))


WORD_RUNS = """
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents),
wd AS (SELECT doc_id, ln, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS w FROM ln),
runs AS (SELECT doc_id, CAST(ln // 50 + 1 AS INTEGER) AS page, CAST(ln % 50 * 100000 + w AS INTEGER) AS seq, text,
    CAST(72 + 6 * coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, ln ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS x,
    CAST(800.0 - 14 * (ln % 50) AS DOUBLE) AS y, 'F1' AS font, CAST(10 AS DOUBLE) AS size FROM wd)"""
GLYPH_RUNS = """
ch AS (SELECT p_partkey AS doc_id, unnest(string_split(p_name, '')) AS text, generate_subscripts(string_split(p_name, ''), 1) - 1 AS i FROM part),
runs AS (SELECT doc_id, 1 AS page, CAST(i AS INTEGER) AS seq, text, CAST(50.0 + 6 * i AS DOUBLE) AS x, CAST(700.0 AS DOUBLE) + CAST(i % 3 AS DOUBLE) * CAST(0.4 AS DOUBLE) AS y, 'F1' AS font, CAST(10 AS DOUBLE) AS size FROM ch)"""
LINES = """
b AS (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y DESC, seq)) > 2.0 THEN 1 ELSE 0 END AS nw, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC, seq) AS pos FROM runs WHERE text <> ''),
l AS (SELECT * EXCLUDE (nw), CAST(1 + sum(nw) OVER (PARTITION BY doc_id, page ORDER BY y DESC, seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS line_no FROM b),
m AS (SELECT *, max(size) OVER (PARTITION BY doc_id, page, line_no) AS mx FROM l),
o AS (SELECT * EXCLUDE (mx), row_number() OVER (PARTITION BY doc_id, page, line_no ORDER BY trunc(x / greatest(mx * 0.75, 1.0)), pos) AS ord, regexp_full_match(text, '[\\s\\x0B\\x{85}\\p{Z}]*') AS is_ws FROM m),
g AS (SELECT *, CASE WHEN NOT is_ws THEN x - last_value(CASE WHEN NOT is_ws THEN x END IGNORE NULLS) OVER (PARTITION BY doc_id, page, line_no ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS gap FROM o),
h AS (SELECT doc_id, page, line_no, list_sort(list(gap) FILTER (WHERE gap > 0)) AS gaps, arg_min(size, ord) FILTER (WHERE NOT is_ws) AS size1,
    CAST(sum(length(text)) FILTER (WHERE NOT is_ws) AS DOUBLE) / count(*) FILTER (WHERE NOT is_ws) AS avgc FROM g GROUP BY doc_id, page, line_no),
t AS (SELECT g.*, CASE WHEN coalesce(len(gaps), 0) < 3 THEN greatest(coalesce(size1, 8.0), 1.0) * 1.5 WHEN avgc >= 3 THEN 1.0
    ELSE greatest(least(gaps[least(CAST(floor(len(gaps) * 0.75) AS BIGINT), len(gaps) - 1) + 1], size1 * 3), 0.5) * 1.5 END AS threshold FROM g JOIN h USING (doc_id, page, line_no))"""
TOKENS = """
k AS (SELECT *, CASE WHEN lag(x) OVER w IS NULL OR lag(is_ws) OVER w OR x - lag(x) OVER w > threshold OR x - lag(x) OVER w < -1.0 THEN 1 ELSE 0 END AS brk FROM t WINDOW w AS (PARTITION BY doc_id, page, line_no ORDER BY ord)),
n AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page, line_no ORDER BY ord ROWS UNBOUNDED PRECEDING) AS tk FROM k),
q AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id, page, line_no ORDER BY tk) AS INTEGER) AS token_no FROM n WHERE NOT is_ws),
tokens AS (SELECT doc_id, page, line_no, token_no, arg_min(x, ord) AS x, string_agg(text, '' ORDER BY ord) AS text, greatest(arg_max(x, ord) - arg_min(x, ord), 0.0) AS width FROM q GROUP BY doc_id, page, line_no, token_no),
heads AS (SELECT doc_id, page, line_no, arg_min(y, ord) AS y, arg_min(x, ord) AS x FROM t GROUP BY doc_id, page, line_no)"""
MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
TAIL = r"[A-Za-z0-9\-._~:/?#\[\]@!$&''()*+,;=%]+"
#: Trailing punctuation, one kind after another.
TRIM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\.+$', ''), ',+$', ''), ';+$', ''), ':+$', ''), '\)+$', ''), '\]+$', '')"
CONTACT = f"""
c0 AS (SELECT *, nullif(regexp_extract(text, '{MAIL}'), '') AS mail, nullif({TRIM.format(f"regexp_extract(text, 'https?://{TAIL}')")}, '') AS url, nullif({TRIM.format(f"regexp_extract(text, 'www\\.{TAIL}')")}, '') AS www FROM tokens),
contacts AS (SELECT * EXCLUDE (mail, url, www), CASE WHEN mail IS NOT NULL THEN 'email' ELSE 'uri' END AS type, coalesce(mail, url, www) AS target FROM c0 WHERE coalesce(mail, url, www) IS NOT NULL)"""
BASE = f"WITH {WORD_RUNS},{LINES},{TOKENS}"
GLYPHS = f"WITH {GLYPH_RUNS},{LINES},{TOKENS}"


@query(f"WITH {WORD_RUNS} SELECT doc_id, page, seq, text, x, y, font, size FROM runs")
def runs_from_documents(spark, sf_dir):
    return documents_runs(spark, sf_dir)


@query(f"WITH {WORD_RUNS} SELECT doc_id, page, count(*) AS n_runs FROM runs WHERE text <> '' GROUP BY doc_id, page")
def drop_empty_runs(spark, sf_dir):
    return L.drop_empty(documents_runs(spark, sf_dir)).groupBy("doc_id", "page").agg(F.count("*").alias("n_runs"))


@query(f"WITH {WORD_RUNS} SELECT doc_id, page, text FROM (SELECT doc_id, page, regexp_replace(string_agg(text, ' ' ORDER BY seq), '^[\\s\\x0B\\x{{85}}\\p{{Z}}]+|[\\s\\x0B\\x{{85}}\\p{{Z}}]+$', '', 'g') AS text FROM runs WHERE text <> '' GROUP BY doc_id, page) WHERE text <> ''")
def page_text(spark, sf_dir):
    return L.page_text(documents_runs(spark, sf_dir))


@query(f"WITH {WORD_RUNS},{LINES} SELECT doc_id, page, seq, line_no, pos FROM l")
def bucket_lines(spark, sf_dir):
    return L.bucket_lines(L.drop_empty(documents_runs(spark, sf_dir))).select("doc_id", "page", "seq", "line_no", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {GLYPH_RUNS},{LINES} SELECT doc_id, seq, line_no, ord FROM o")
def x_order(spark, sf_dir):
    return L.order_in_line(L.bucket_lines(L.drop_empty(part_runs(spark, sf_dir)))).select("doc_id", "seq", "line_no", F.col("ord").cast("long").alias("ord"))


@query(f"WITH {WORD_RUNS},{LINES} SELECT DISTINCT doc_id, page, line_no, round(threshold, 6) AS threshold FROM t")
def split_threshold(spark, sf_dir):
    return L.thresholds(documents_pages(spark, sf_dir)).select("doc_id", "page", "line_no", F.round("threshold", 6).alias("threshold"))


@query(f"{BASE} SELECT doc_id, page, line_no, token_no, x, text, width FROM tokens")
def tokens(spark, sf_dir):
    return L.tokens_from_runs(documents_pages(spark, sf_dir))


@query(f"{GLYPHS} SELECT doc_id, line_no, token_no, round(x, 6) AS x, text, round(width, 6) AS width FROM tokens")
def glyph_tokens(spark, sf_dir):
    return L.tokens_from_runs(part_runs(spark, sf_dir)).select("doc_id", "line_no", "token_no", F.round("x", 6).alias("x"), "text", F.round("width", 6).alias("width"))


@query(f"{BASE} SELECT h.doc_id, h.page, h.line_no, h.y, h.x, count(k.token_no) AS n_tokens FROM heads h LEFT JOIN tokens k USING (doc_id, page, line_no) GROUP BY h.doc_id, h.page, h.line_no, h.y, h.x")
def lines(spark, sf_dir):
    return L.lines_from_runs(documents_pages(spark, sf_dir), tokens=False).select("doc_id", "page", "line_no", "y", "x", F.col("n_tokens").cast("long").alias("n_tokens"))


# words in this table hold no opening punctuation at their ends, so joining by spaces and taking them out before closing ones is the same
@query(rf"""{BASE} SELECT h.doc_id, h.page, h.line_no, coalesce(regexp_replace(regexp_replace(string_agg(k.text, ' ' ORDER BY k.token_no), ' ([,.;:!?)\]}}])', '\1', 'g'), '([¡¿(\["]) ', '\1', 'g'), '') AS text
FROM heads h LEFT JOIN tokens k USING (doc_id, page, line_no) GROUP BY h.doc_id, h.page, h.line_no""")
def line_text_render(spark, sf_dir):
    return L.lines_from_runs(documents_pages(spark, sf_dir), tokens=False).select("doc_id", "page", "line_no", "text")


@query(f"{BASE},{CONTACT} SELECT c.doc_id, page, line_no, token_no, type, target FROM contacts c")
def infer_shapes(spark, sf_dir):
    found = L.tokens_from_runs(contact_pages(spark, sf_dir)).where(T.may_hold_contact(F.col("text"))).withColumn("c", T.infer_contact(F.col("text"))).where("c is not null")
    return found.select("doc_id", "page", "line_no", "token_no", "c.type", "c.target")


@query(f"{BASE},{CONTACT} SELECT d.lang, d.source, count(DISTINCT c.doc_id) AS documents, count(*) AS contacts, count(DISTINCT (c.doc_id, c.page, c.line_no)) AS lines FROM contacts c JOIN documents d USING (doc_id) GROUP BY d.lang, d.source")
def documents_with_contacts(spark, sf_dir):
    """Which documents hold e-mail addresses or URLs, by language and source."""
    docs = read(spark, sf_dir, "documents")
    # only texts with a sign of a contact are laid out; lines of one page do not depend on other documents
    some = docs.where(F.col("text").contains("@") | F.col("text").contains("http") | F.col("text").contains("www."))
    found = L.tokens_from_runs(L.word_pages(some)).where(T.may_hold_contact(F.col("text")) & T.infer_contact(F.col("text")).isNotNull())
    per_doc = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("page", "line_no").alias("l"))
    return docs.select("doc_id", "lang", "source").join(per_doc, "doc_id").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("n").alias("contacts"), F.sum("l").alias("lines"))


@query(f"SELECT page_id, {TRIM.format(f'''regexp_extract(url, 'https?://{TAIL}')''')} AS target FROM pages WHERE regexp_extract(url, 'https?://{TAIL}') <> ''")
def infer_uri(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.infer_contact(F.col("url"))["target"].alias("target")).where("target is not null")


@query(f"SELECT page_id, {TRIM.format('''url || ').,' ''')} AS target FROM pages WHERE url IS NOT NULL")
def trim_trailing_punct(spark, sf_dir):
    return read(spark, sf_dir, "pages").where("url is not null").select("page_id", T.trim_trailing_punct(F.concat("url", F.lit(").,"))).alias("target"))


_COLON = r"'^(.+:)([^\s:].+|[^\s:\x00-\x7F])$'"
_URI = "(contains({0}, '://') OR contains({0}, '@') OR starts_with({0}, 'www.') OR starts_with({0}, 'http'))"


@query(rf"""WITH w AS (SELECT conv_id, turn, role, unnest(string_split(text, ' ')) AS w, CAST(generate_subscripts(string_split(text, ' '), 1) - 1 AS INTEGER) AS i FROM conversations), s AS (SELECT conv_id, turn, i, role || ':' || w AS t FROM w)
SELECT conv_id, turn, i, unnest(CASE WHEN NOT {_URI.format('t')} AND regexp_matches(t, {_COLON}) THEN [regexp_extract(t, {_COLON}, 1), regexp_extract(t, {_COLON}, 2)] ELSE [t] END) AS piece FROM s WHERE t IS NOT NULL""")
def split_colon(spark, sf_dir):
    """Every word of every turn behind its speaker's label."""
    words = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", " ")).alias("i", "w"))
    return words.select("conv_id", "turn", "i", F.concat("role", F.lit(":"), "w").alias("t")).where("t is not null").select("conv_id", "turn", "i", F.explode(T.split_label_colon(F.col("t"))).alias("piece"))


@query(r"""WITH s AS (SELECT p_partkey, replace(p_brand, '#', '') || 'x' AS t FROM part)
SELECT p_partkey, unnest(string_split(regexp_replace(regexp_replace(t, '([A-Za-zÀ-ÿ])(\d)', '\1|\2', 'g'), '(\d)([A-Za-zÀ-ÿ])', '\1|\2', 'g'), '|')) AS piece FROM s WHERE NOT regexp_matches(t, '^[A-Z]{3,5}\d{6}[A-Z0-9]{0,10}$')""")
def split_letter_digit(spark, sf_dir):
    t = F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("x"))
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(T.split_letter_digit(t)).alias("piece"))


@query(r"""WITH s AS (SELECT p_partkey, string_agg(upper(w[1]) || lower(w[2:]), '' ORDER BY i) AS t FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w, generate_subscripts(string_split(p_type, ' '), 1) AS i FROM part) GROUP BY p_partkey)
SELECT p_partkey, unnest(string_split(regexp_replace(t, '([a-zà-ÿ])([A-ZÀ-Ý][a-zà-ÿ])', '\1|\2', 'g'), '|')) AS piece FROM s""")
def split_camel(spark, sf_dir):
    t = F.regexp_replace(F.initcap(F.lower("p_type")), " ", "")
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(T.split_camel_case(t)).alias("piece"))


@query(r"""WITH s AS (SELECT p_partkey, p_name || ':' || p_brand AS t, CAST(p_size AS DOUBLE) AS width, 10.0 AS x FROM part),
a AS (SELECT p_partkey, x, width, t, regexp_extract(t, '^(.+:)([^\s:].+|[^\s:\x00-\x7F])$', 1) AS a1, regexp_extract(t, '^(.+:)([^\s:].+|[^\s:\x00-\x7F])$', 2) AS a2 FROM s),
p AS (SELECT p_partkey, x, width, length(t) AS n, CASE WHEN a1 <> '' THEN [a1, a2] ELSE [t] END AS ps FROM a)
SELECT p_partkey, unnest(ps) AS text, round(CAST(x + width * CASE generate_subscripts(ps, 1) WHEN 1 THEN 0 ELSE length(ps[1]) END / n AS DOUBLE), 6) AS x, round(CAST(width * length(unnest(ps)) / n AS DOUBLE), 6) AS width FROM p""")
def split_in_proportion(spark, sf_dir):
    t = read(spark, sf_dir, "part").select("p_partkey", F.lit(10.0).alias("x"), F.concat("p_name", F.lit(":"), "p_brand").alias("text"), F.col("p_size").cast("double").alias("width"))
    return T.split_with(t, T.split_label_colon(F.col("text"))).select("p_partkey", "text", F.round("x", 6).alias("x"), F.round("width", 6).alias("width"))


@query()
def dict_partition(spark, sf_dir):
    """Neighbouring words of all documents glued together and cut again by the words of the benchmark's items; beyond SQL, tested by enumeration."""
    listed = T.word_list(read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[^A-Za-zÀ-ÿ]+")).alias("word")))
    return T.split_glued_words(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), [r["word"] for r in listed.limit(T.MAX_WORDS + 1).collect()])  # raises above the bound


@query(f"""{BASE}, placed AS (SELECT k.*, h.y FROM tokens k JOIN heads h USING (doc_id, page, line_no)),
sh AS (SELECT doc_id, page, x - 3 AS x1, x + 40 AS x2, y - 1 AS y1, y + 1 AS y2, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no, token_no) AS INTEGER) AS shape_seq FROM placed WHERE text LIKE '%.'),
bands AS (SELECT *, unnest(generate_series(CAST(floor((y1 - 2) / 16) AS BIGINT), CAST(floor((y2 + 2) / 16) AS BIGINT))) AS band FROM sh),
first AS (SELECT p.doc_id, p.page, p.line_no, p.token_no, min(s.shape_seq) AS shape_seq FROM placed p JOIN bands s ON p.doc_id = s.doc_id AND p.page = s.page AND CAST(floor(p.y / 16) AS BIGINT) = s.band AND p.y BETWEEN s.y1 - 2 AND s.y2 + 2 AND p.x <= s.x2 AND p.x + p.width >= s.x1 GROUP BY ALL)
SELECT p.doc_id, p.page, p.line_no, p.token_no, f.shape_seq, CASE WHEN f.shape_seq IS NULL THEN 'text' ELSE 'link' END AS kind FROM placed p LEFT JOIN first f USING (doc_id, page, line_no, token_no)""")
def attach_shapes(spark, sf_dir):
    from pyspark.sql import Window

    placed = L.placed_tokens(documents_pages(spark, sf_dir))
    w = Window.partitionBy("doc_id").orderBy("page", "line_no", "token_no")
    some = placed.where("text like '%.'")  # a made-up link on each token that ends a sentence
    shapes = some.select("doc_id", "page", (F.col("x") - 3).alias("x1"), (F.col("x") + 40).alias("x2"), (F.col("y") - 1).alias("y1"), (F.col("y") + 1).alias("y2"), F.lit("uri").alias("type"), F.row_number().over(w).alias("shape_seq"))
    return S.attach_shapes(placed, shapes).select("doc_id", "page", "line_no", "token_no", "shape_seq", "kind")


@query("""WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents), pg AS (SELECT doc_id, CAST(ln // 50 + 1 AS INTEGER) AS page, count(*) FILTER (WHERE line LIKE '% %') AS n FROM ln GROUP BY ALL),
mx AS (SELECT doc_id, max(page) + 1 AS top FROM pg GROUP BY doc_id)
SELECT m.doc_id, CAST(r.page AS INTEGER) AS page, coalesce(p.n, 0) AS n_lines FROM mx m, LATERAL (SELECT unnest(generate_series(1, m.top)) AS page) r LEFT JOIN pg p ON p.doc_id = m.doc_id AND p.page = r.page""")
def pages_outer(spark, sf_dir):
    """Every page up to one past the last, with its number of lines, none where there is no line."""
    ln = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    pages = ln.groupBy("doc_id", (F.floor(F.col("ln") / 50) + 1).cast("int").alias("page")).agg(F.count(F.when(F.col("line").like("% %"), 1)).alias("n"))
    counts = pages.groupBy("doc_id").agg((F.max("page") + 1).alias("page_count"))
    return R.every_page(counts, pages).select("doc_id", "page", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("""WITH u AS (SELECT doc_id, 'lang' AS key, lang AS value, 1 AS rank FROM documents UNION ALL SELECT doc_id, 'source', source, 1 FROM documents UNION ALL SELECT doc_id, 'source', 'label', 0 FROM labels UNION ALL SELECT doc_id, 'quality', CAST(quality AS VARCHAR), 0 FROM labels)
SELECT doc_id, key, arg_min(value, rank) AS value FROM u GROUP BY doc_id, key""")
def meta_merge_priority(spark, sf_dir):
    """Keys of two origins, the second winning: a grouped minimum by rank."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    pair = lambda df, key, value: df.select("doc_id", F.lit(key).alias("key"), value.alias("value"))
    return R.merge_meta(pair(docs, "lang", F.col("lang")).union(pair(docs, "source", F.col("source"))), pair(labels, "source", F.lit("label")).union(pair(labels, "quality", F.col("quality").cast("string"))))


@query("""WITH u AS (SELECT doc_id, 1 AS page, 700.0 - row_number() OVER (PARTITION BY doc_id ORDER BY quality) AS y, 'text' AS kind FROM labels UNION ALL SELECT doc_id, 1, 699.5, 'image' FROM documents)
SELECT doc_id, kind, CAST(y AS DOUBLE) AS y, row_number() OVER (PARTITION BY doc_id ORDER BY page, y DESC, kind) AS place FROM u""")
def union_lines_images(spark, sf_dir):
    from pyspark.sql import Window

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    text = labels.select("doc_id", F.lit(1).alias("page"), (700.0 - F.row_number().over(Window.partitionBy("doc_id").orderBy("quality"))).alias("y"), F.lit("text").alias("kind"))
    image = docs.select("doc_id", F.lit(1).alias("page"), F.lit(699.5).alias("y"), F.lit("image").alias("kind"))
    return R.merge_lines(text, image, "kind").select("doc_id", "kind", "y", F.col("place").cast("long").alias("place"))


@query(f"""{BASE},{CONTACT}, inferred AS (SELECT c.doc_id, c.page, c.x AS x1, h.y AS y1, c.type, c.target, 'inferred' AS source FROM contacts c JOIN heads h USING (doc_id, page, line_no)),
given AS (SELECT page_id AS doc_id, 1 AS page, CAST(0 AS DOUBLE) AS x1, CAST(900 AS DOUBLE) AS y1, CASE WHEN contains(url, '@') AND NOT contains(url, '://') THEN 'email' ELSE 'uri' END AS type, regexp_replace(url, '^mailto:', '') AS target, 'annotation' AS source FROM pages WHERE url IS NOT NULL),
u AS (SELECT *, 0 AS o FROM given UNION ALL SELECT *, 1 FROM inferred)
SELECT doc_id, page, type, target, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, y1 DESC, o, x1, target) AS INTEGER) AS shape_seq FROM u""")
def union_shapes(spark, sf_dir):
    """Links that annotations give and those that tokens hold, numbered together (pages' addresses stand for annotations)."""
    placed = L.placed_tokens(contact_pages(spark, sf_dir))
    null = F.lit(None)
    ann = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.lit("link").alias("type"), F.lit(0.0).alias("x1"), F.lit(900.0).alias("y1"), F.lit(0.0).alias("x2"), F.lit(900.0).alias("y2"), "url", null.cast("int").alias("dest_page"), null.cast("string").alias("contents"))
    return S.union_shapes(S.shapes_from_annotations(ann), S.shapes_from_tokens(placed)).select("doc_id", "page", "type", "target", "source", "shape_seq")


@query("""WITH a AS (SELECT lower(w) AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) UNION ALL SELECT lower(w) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))
SELECT DISTINCT word FROM a WHERE word IS NOT NULL AND word NOT IN ('dela', 'pal')""")
def dict_except(spark, sf_dir):
    a = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    b = read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return T.word_list(a, b)


@query("""SELECT r_regionkey AS top, n_nationkey AS mid, c_custkey AS leaf, row_number() OVER (ORDER BY r_regionkey, n_nationkey NULLS FIRST, c_custkey NULLS FIRST) AS place, level, title FROM (
SELECT r_regionkey, NULL AS n_nationkey, NULL AS c_custkey, 0 AS level, r_name AS title FROM region UNION ALL SELECT n_regionkey, n_nationkey, NULL, 1, n_name FROM nation UNION ALL
SELECT n_regionkey, n_nationkey, c_custkey, 2, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def outline_preorder(spark, sf_dir):
    """Regions, nations and customers as a bookmark tree in pre-order: paths sort as the tree is walked."""
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    null = F.lit(None)
    rows = region.select(F.col("r_regionkey").alias("top"), null.cast("int").alias("mid"), null.cast("long").alias("leaf"), F.lit(0).alias("level"), F.col("r_name").alias("title"))
    rows = rows.union(nation.select("n_regionkey", "n_nationkey", null.cast("long"), F.lit(1), "n_name"))
    rows = rows.union(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "n_nationkey", "c_custkey", F.lit(2), "c_name"))
    return O.preorder(rows, ["top", "mid", "leaf"]).select("top", "mid", "leaf", "place", "level", "title")


@query("""SELECT o_orderkey, n.n_regionkey + 1 AS dest_page FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey LEFT JOIN nation n ON c_nationkey = n_nationkey""")
def named_dest_join(spark, sf_dir):
    """Names to destinations to page numbers: two left equi-joins."""
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    links = orders.select("o_orderkey", F.col("o_custkey").alias("dest"))
    names = customer.select(F.col("c_custkey").alias("name"), F.col("c_nationkey").alias("target"))
    pages = nation.select(F.col("n_nationkey").alias("target"), F.col("n_regionkey").alias("page_index"))
    return O.resolve_names(links, names, pages).select("o_orderkey", "dest_page")
