"""Layout arithmetic, charts, codes and structure flags over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..codes import qr
from ..functions import codes as C
from ..functions import layout as Y
from ..session import spread
from ..streaming import ingest
from .q_text import read
from .registry import query

_NICE = "CASE WHEN {0} <= 0 THEN 10 ELSE CAST(round((CASE WHEN {0} / m <= 1 THEN 1 WHEN {0} / m <= 1.5 THEN 1.5 WHEN {0} / m <= 2 THEN 2 WHEN {0} / m <= 3 THEN 3 WHEN {0} / m <= 5 THEN 5 WHEN {0} / m <= 7.5 THEN 7.5 ELSE 10 END) * m) AS BIGINT) END"


@query("""WITH c AS (SELECT p_size AS doc_id, 0 AS col, p_name AS text FROM part UNION ALL SELECT p_size, 1, p_type FROM part UNION ALL SELECT p_size, 2, p_brand FROM part)
SELECT doc_id, col, CAST(max(list_max(list_transform(string_split(text, ' '), lambda w: length(w)))) * 5.0 + 8.0 AS DOUBLE) AS width FROM c GROUP BY doc_id, col""")
def column_widths(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    cells = part.select(F.col("p_size").alias("doc_id"), F.posexplode(F.array("p_name", "p_type", "p_brand")).alias("col", "text"))
    return Y.column_widths(cells)


_FLEX = """WITH c AS (SELECT n_regionkey AS doc_id, n_nationkey AS col, CAST(length(n_name) * 6 AS DOUBLE) AS want, 40.0::DOUBLE AS lo, 90.0::DOUBLE AS hi FROM nation),
f AS (SELECT *, want / sum(want) OVER (PARTITION BY doc_id) * 400.0 AS f FROM c), g AS (SELECT *, least(greatest(f, lo), hi) AS c FROM f), h AS (SELECT *, c <> f AS fix FROM g),
k AS (SELECT *, 400.0 - sum(CASE WHEN fix THEN c ELSE 0 END) OVER (PARTITION BY doc_id) AS rest, sum(CASE WHEN fix THEN 0 ELSE want END) OVER (PARTITION BY doc_id) AS flex FROM h)
SELECT doc_id, col, round(CASE WHEN fix THEN c ELSE want / flex * rest END, 6) AS width FROM k"""


@query(_FLEX)
def flexible_widths(spark, sf_dir):
    cols = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("col"), (F.length("n_name") * 6.0).alias("want"), F.lit(40.0).alias("min_width"), F.lit(90.0).alias("max_width"))
    return Y.flexible_widths(cols, 400.0).select("doc_id", "col", F.round("width", 6).alias("width"))


@query("SELECT p_partkey, p_size AS doc_id, round(500.0 * p_size / sum(p_size) OVER (PARTITION BY p_brand), 6) AS width FROM part")
def weighted_split(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_brand").alias("doc_id"), F.col("p_size").cast("double").alias("weight"))
    return Y.weighted_split(part, 500.0).select("p_partkey", F.col("p_size").alias("doc_id"), F.round("width", 6).alias("width"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS row, CAST(max(list_max([1, l_linenumber, length(l_returnflag || l_linestatus)])) * 12 + 8 AS DOUBLE) AS height, l_linenumber % 2 = 0 AS zebra FROM lineitem GROUP BY l_orderkey, l_linenumber")
def row_heights(spark, sf_dir):
    n = F.greatest(F.lit(1), "l_linenumber", F.length(F.concat("l_returnflag", "l_linestatus")))
    return Y.row_heights(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row"), n.alias("n_lines")))


@query("""WITH RECURSIVE r AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS row, CAST(l_quantity AS DOUBLE) AS height, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS i FROM lineitem),
p AS (SELECT doc_id, row, i, 1 AS page, 10.0::DOUBLE + height AS used FROM r WHERE i = 1
UNION ALL SELECT r.doc_id, r.row, r.i, CASE WHEN p.used + r.height <= 80 OR p.used <= 10 THEN p.page ELSE p.page + 1 END, CASE WHEN p.used + r.height <= 80 OR p.used <= 10 THEN p.used + r.height ELSE 10 + r.height END FROM p JOIN r ON r.doc_id = p.doc_id AND r.i = p.i + 1)
SELECT doc_id, row, page FROM p""")
def paginate_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row"), F.col("l_quantity").alias("height"))
    return Y.paginate(rows, 80.0, 10.0)


# the oracle takes lines by the same greedy rule in its own dialect; tests hold the function against a loop over words
@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
w AS (SELECT doc_id, n, regexp_extract_all(s || chr(1), '([^\x01]{0,40}|[^ \x01]+)[ \x01]', 1) AS ls FROM l), f AS (SELECT doc_id, flatten(list(ls ORDER BY n)) AS ls FROM w GROUP BY doc_id)
SELECT doc_id, CAST(unnest(generate_series(1, len(ls))) AS INTEGER) AS line, unnest(ls) AS text FROM f""")
def wrap_text_greedy(spark, sf_dir):
    t = read(spark, sf_dir, "documents")
    return t.select("doc_id", F.posexplode(Y.wrap_text(F.col("text"), 40)).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("line"), "text")


@query(f"WITH v AS (SELECT o_orderkey, o_totalprice / 7 AS v, pow(10.0, floor(log10(o_totalprice / 7))) AS m FROM orders) SELECT o_orderkey, {_NICE.format('v')} AS top FROM v")
def nice_maximum(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", Y.nice_max(F.col("o_totalprice") / 7).alias("top"))


@query("SELECT o_orderkey, CASE WHEN n >= 1000000 THEN (n + 50000) // 1000000 || '.' || (n + 50000) // 100000 % 10 || 'M' WHEN n >= 10000 THEN (n + 50) // 1000 || '.' || (n + 50) // 100 % 10 || 'K' ELSE CAST(n AS VARCHAR) END AS label FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 40 + 1) + 1 AS n FROM orders)")
def format_numbers(spark, sf_dir):
    n = F.floor("o_totalprice").cast("long") * (F.col("o_orderkey") % 40 + 1) + 1
    return read(spark, sf_dir, "orders").select("o_orderkey", Y.format_integer(n).alias("label"))


@query(f"""WITH s AS (SELECT l_returnflag AS doc_id, l_linestatus AS k, sum(l_quantity) AS value FROM lineitem GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM s),
m AS (SELECT *, max(value) OVER (PARTITION BY doc_id) AS mx, 300.0 / count(*) OVER (PARTITION BY doc_id) AS slot FROM i), n AS (SELECT *, pow(10.0, floor(log10(mx))) AS m FROM m), t AS (SELECT *, {_NICE.format('mx')} AS top FROM n)
SELECT doc_id, CAST(i AS INTEGER) AS i, top, round(i * slot + slot * 0.1, 6) AS x, round(slot * 0.8, 6) AS w, round(value / top * 150.0, 6) AS h FROM t""")
def bar_geometry(spark, sf_dir):
    from pyspark.sql import Window

    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("doc_id"), "l_linestatus").agg(F.sum("l_quantity").alias("value"))
    s = s.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("l_linestatus")) - 1)
    return Y.bar_geometry(s, 300.0, 150.0).select("doc_id", "i", "top", *[F.round(c, 6).alias(c) for c in ("x", "w", "h")])


@query("""WITH s AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate) AS month, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL), r AS (SELECT p, month, value, least(0.0, min(value) OVER (PARTITION BY p)) AS low, max(value) OVER (PARTITION BY p) AS high,
row_number() OVER (PARTITION BY p ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY p) AS n FROM s)
SELECT p, i, round(300.0 * i / greatest(n - 1, 1), 6) AS x, round((value - low) / (high - low) * 150.0, 6) AS y FROM r""")
def line_geometry(spark, sf_dir):
    from pyspark.sql import Window

    s = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").cast("double").alias("value"))
    i = F.row_number().over(Window.partitionBy("p").orderBy("month")) - 1
    out = Y.line_geometry(s.select(F.col("p").alias("doc_id"), i.cast("long").alias("i"), "value"), 300.0, 150.0)
    return out.select(F.col("doc_id").alias("p"), "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH s AS (SELECT user_id AS doc_id, event_type AS k, sum(abs(value)) AS value FROM events GROUP BY ALL), f AS (SELECT *, value / greatest(sum(value) OVER (PARTITION BY doc_id), 1) AS fraction FROM s),
b AS (SELECT *, coalesce(sum(fraction) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT doc_id, k, round(fraction, 6) AS fraction, round(before * 2 * pi() - pi() / 2, 5) AS start_angle, round((before + fraction) * 2 * pi() - pi() / 2, 5) AS end_angle FROM b""")
def pie_slices(spark, sf_dir):
    s = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("i")).agg(F.sum(F.abs("value")).alias("value"))
    return Y.pie_slices(s).select("doc_id", F.col("i").alias("k"), F.round("fraction", 6).alias("fraction"), F.round("start_angle", 5).alias("start_angle"), F.round("end_angle", 5).alias("end_angle"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 12.0, 6) AS pica, round(l_quantity * 72.0, 6) AS inch, round(l_quantity * 72 / 2.54, 6) AS cm, round(l_quantity * 72 / 25.4, 6) AS mm, round(l_quantity * 72.0 / 96.0, 6) AS px FROM lineitem")
def units(spark, sf_dir):
    q = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(Y.to_points(q, u), 6).alias(u) for u in ("pica", "inch", "cm", "mm")], F.round(Y.to_points(q, "px", 96.0), 6).alias("px"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 400.0 WHEN 1 THEN p_size / 100.0 * 400.0 WHEN 2 THEN NULL ELSE CAST(p_size AS DOUBLE) END::DOUBLE AS width FROM part")
def dimensions(spark, sf_dir):
    d = F.when(F.col("p_size") % 4 == 0, F.lit("full")).when(F.col("p_size") % 4 == 1, F.concat(F.col("p_size").cast("string"), F.lit("%"))).when(F.col("p_size") % 4 == 2, F.lit("auto")).otherwise(F.col("p_size").cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", d.alias("d")).select("p_partkey", Y.resolve_dimension(F.col("d"), F.lit(400.0)).alias("width"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '7,7,7,7' WHEN 1 THEN '7,' || p_size || ',7,' || p_size WHEN 2 THEN '7,' || p_size || ',3,' || p_size ELSE '7,' || p_size || ',3,9' END AS sides FROM part")
def shorthand(spark, sf_dir):
    p = F.col("p_size")
    v = F.when(p % 4 == 0, F.array(F.lit(7))).when(p % 4 == 1, F.array(F.lit(7), p)).when(p % 4 == 2, F.array(F.lit(7), p, F.lit(3))).otherwise(F.array(F.lit(7), p, F.lit(3), F.lit(9)))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(Y.expand_shorthand(v).cast("array<string>"), ",").alias("sides"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'cell' WHEN p_size % 5 = 0 THEN 'row' ELSE 'table' END AS color, CASE WHEN p_size % 5 = 0 THEN '9' ELSE '5' END AS padding FROM part")
def option_merge(spark, sf_dir):
    p, none = F.col("p_size"), F.lit(None).cast("map<string,string>")
    table = F.create_map(F.lit("color"), F.lit("table"), F.lit("padding"), F.lit("5"))
    row = F.when(p % 5 == 0, F.create_map(F.lit("color"), F.lit("row"), F.lit("padding"), F.lit("9"))).otherwise(none)
    cell = F.when(p % 3 == 0, F.create_map(F.lit("color"), F.lit("cell"))).otherwise(none)
    m = Y.merge_options(table, row, cell)
    return read(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", F.col("m")["color"].alias("color"), F.col("m")["padding"].alias("padding"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) AS w, round(sqrt(l_discount * l_discount + l_quantity * l_quantity), 6) AS h, round(atan2(l_tax, l_quantity), 6) AS r FROM lineitem")
def ctm_decompose(spark, sf_dir):
    w, h, r = Y.ctm_decompose(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), F.col("l_quantity"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(w, 6).alias("w"), F.round(h, 6).alias("h"), F.round(r, 6).alias("r"))


@query("SELECT p_partkey, (p_partkey & 1) <> 0 AS read_only, (p_partkey & 2) <> 0 AS required, (p_partkey & 4) <> 0 AS no_export, (p_partkey & 4096) <> 0 AS multiline FROM part")
def form_flags(spark, sf_dir):
    f = Y.field_flags(F.col("p_partkey").cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", f.alias("f")).select("p_partkey", *[F.col("f")[n].alias(n) for n in ("read_only", "required", "no_export", "multiline")])


@query("""WITH c AS (SELECT p_partkey, unnest(string_split(p_brand, '')) AS c, generate_subscripts(string_split(p_brand, ''), 1) AS i FROM part)
SELECT p_partkey, CAST((104 + sum((ascii(c) - 32) * i)) % 103 AS INTEGER) AS checksum FROM c GROUP BY p_partkey""")
def code128_checksum(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", C.code128_b_checksum(F.col("p_brand")).cast("int").alias("checksum"))


@query("SELECT p_partkey, 11 * (length(p_brand) + 2) + 13 AS modules FROM part")
def code128_modules(spark, sf_dir):
    """Whole bar patterns: every value of set B is eleven modules wide."""
    return read(spark, sf_dir, "part").select("p_partkey", F.aggregate(C.code128_bars("p_brand"), F.lit(0), lambda a, b: a + b).cast("long").alias("modules"))


_CAPACITY = ", ".join(f"({v}, {qr.capacity(v, 'M')})" for v in range(1, qr.MAX_VERSION + 1))


@query(f"SELECT item_id, min(v) AS version FROM benchmark JOIN (VALUES {_CAPACITY}) t(v, size) ON octet_length(encode(text)) <= size GROUP BY item_id")
def qr_version_capacity(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", C.qr_version("text").alias("version")).where("version is not null")


@query(f"SELECT c_custkey, 17 + 4 * min(v) AS size, (17 + 4 * min(v)) * (17 + 4 * min(v)) AS modules FROM customer JOIN (VALUES {_CAPACITY}) t(v, size) ON octet_length(encode(c_name)) <= size GROUP BY c_custkey")
def qr_matrices(spark, sf_dir):
    """A symbol of each customer's whole name: the smallest version that holds it."""
    m = C.qr_modules(F.col("c_name"))
    return spread(read(spark, sf_dir, "customer").select("c_custkey", "c_name")).select("c_custkey", m.alias("m")).where("m is not null").select("c_custkey", F.size("m").alias("size"), F.size(F.flatten("m")).alias("modules"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return ingest.windowed_counts(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, g""")
def session_windows(spark, sf_dir):
    return ingest.sessions(read(spark, sf_dir, "events"))
