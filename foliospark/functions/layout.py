"""Layout arithmetic as columns: widths, heights, wrapping, pagination, chart geometry, units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINTS = {"point": 1.0, "pica": 12.0, "inch": 72.0, "cm": 72 / 2.54, "mm": 72 / 25.4}


def to_points(value: Column, unit: str, dpi: float = 72.0) -> Column:
    return value * (72.0 / dpi if unit == "px" else POINTS[unit])


def resolve_dimension(d: Column, full: Column) -> Column:
    """':full' or 'full' all of it, 'N%' a share, 'auto' null, else points."""
    return F.when(d.isin("full", ":full"), full).when(d.endswith("%"), F.regexp_replace(d, "%$", "").cast("double") / 100 * full).when(d == "auto", F.lit(None).cast("double")).otherwise(d.cast("double"))


def expand_shorthand(v: Column) -> Column:
    """1 to 4 values as (top, right, bottom, left)."""
    g = lambda i: F.get(v, F.lit(i))
    n = F.size(v)
    return F.when(n == 1, F.array(g(0), g(0), g(0), g(0))).when(n == 2, F.array(g(0), g(1), g(0), g(1))).when(n == 3, F.array(g(0), g(1), g(2), g(1))).otherwise(F.array(g(0), g(1), g(2), g(3)))


def merge_options(*maps: Column) -> Column:
    """Later maps win, key by key; null maps are empty."""
    empty = F.create_map().cast("map<string,string>")
    both = [F.coalesce(m, empty) for m in maps]
    return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b), both)


def nice_max(v: Column) -> Column:
    """v > 0 rounded up to 1, 1.5, 2, 3, 5, 7.5 or 10 times a power of ten, then to an integer; else 10."""
    mag = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    n = v / mag
    step = F.when(n <= 1, 1.0).when(n <= 1.5, 1.5).when(n <= 2, 2.0).when(n <= 3, 3.0).when(n <= 5, 5.0).when(n <= 7.5, 7.5).otherwise(10.0)
    return F.when(v <= 0, F.lit(10).cast("long")).otherwise(F.round(step * mag).cast("long"))


def format_integer(n: Column) -> Column:
    """A million or more as 'x.xM', ten thousand or more as 'x.xK', halves up; in whole numbers, so that no rounding of doubles shows."""

    def short(unit: int, mark: str) -> Column:
        tenths = F.floor((n + unit // 20) / (unit // 10)).cast("long")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(mark))

    return F.when(n >= 1_000_000, short(1_000_000, "M")).when(n >= 10_000, short(1_000, "K")).otherwise(n.cast("string"))


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def column_widths(cells: DataFrame, padding: float = 8.0, per_char: float = 5.0) -> DataFrame:
    """Per (doc_id, col): the widest cell's longest chunk and the padding."""
    longest = F.array_max(F.transform(F.split("text", " "), lambda w: F.length(w)))
    return cells.groupBy("doc_id", "col").agg((F.max(longest) * per_char + padding).alias("width"))


def flexible_widths(cols: DataFrame, total: float) -> DataFrame:
    """cols (doc_id, col, want, min_width, max_width): shares of the total by want, clamped; the clamped ones are
    then fixed and the rest shares what is left."""
    w = Window.partitionBy("doc_id")
    first = F.col("want") / F.sum("want").over(w) * total
    out = cols.withColumn("__f", first)
    out = out.withColumn("__c", F.least(F.greatest("__f", F.coalesce("min_width", "__f")), F.coalesce("max_width", F.greatest("__f", F.coalesce("min_width", "__f")))))
    out = out.withColumn("__fix", F.col("__c") != F.col("__f"))
    left = total - F.sum(F.when(F.col("__fix"), F.col("__c")).otherwise(0.0)).over(w)
    flex = F.sum(F.when(F.col("__fix"), 0.0).otherwise(F.col("want"))).over(w)
    return out.withColumn("width", F.when(F.col("__fix"), F.col("__c")).otherwise(F.col("want") / flex * left)).drop("__f", "__c", "__fix")


def weighted_split(weights: DataFrame, available: float) -> DataFrame:
    return weights.withColumn("width", F.lit(available) * F.col("weight") / F.sum("weight").over(Window.partitionBy("doc_id")))


def wrap_text(text: Column, max_chars: int) -> Column:
    """Greedy lines of words by single spaces; a longer word stands alone; line breaks stay.

    The longest run of whole words that fits is what a greedy expression takes, so each line is one linear match; U+FFFF, which is no character, marks the end."""
    pattern = f"([^\uffff]{{0,{max_chars}}}|[^ \uffff]+)[ \uffff]"
    return F.flatten(F.transform(F.split(text, "\n"), lambda line: F.regexp_extract_all(F.concat(line, F.lit("\uffff")), F.lit(pattern), F.lit(1))))


def row_heights(cells: DataFrame, line_height: float = 12.0, padding: float = 8.0) -> DataFrame:
    """Per (doc_id, row) of cells (doc_id, row, n_lines): the tallest cell and the padding; every other row is shaded."""
    out = cells.groupBy("doc_id", "row").agg((F.max("n_lines") * line_height + padding).alias("height"))
    return out.withColumn("zebra", F.col("row") % 2 == 0)


def line_geometry(values: DataFrame, width: float, height: float) -> DataFrame:
    """values (doc_id, i from 0, value): x and y of each point; the scale runs from 0 or the least value to the greatest."""
    w = Window.partitionBy("doc_id")
    low, high, n = F.least(F.lit(0.0), F.min("value").over(w)), F.max("value").over(w), F.count("*").over(w)
    out = values.withColumn("__low", low).withColumn("__high", high).withColumn("__n", n)
    span = F.when(F.col("__high") > F.col("__low"), F.col("__high") - F.col("__low")).otherwise(1.0)
    out = out.withColumn("x", width * F.col("i") / F.greatest(F.col("__n") - 1, F.lit(1))).withColumn("y", (F.col("value") - F.col("__low")) / span * height)
    return out.drop("__low", "__high", "__n")


def paginate(rows: DataFrame, page_height: float, header_height: float = 0.0) -> DataFrame:
    """rows (doc_id, row, height): page number by greedy filling, one fold per document over its heights only.
    A row taller than a page has one of its own."""
    start = F.struct(F.lit(1).alias("page"), F.lit(header_height).cast("double").alias("used"), F.array().cast("array<struct<row:int,page:int>>").alias("out"))

    def add(acc: Column, r: Column) -> Column:
        fits = (acc["used"] + r["height"] <= page_height) | (acc["used"] <= header_height)
        page = F.when(fits, acc["page"]).otherwise(acc["page"] + 1)
        used = F.when(fits, acc["used"] + r["height"]).otherwise(F.lit(header_height) + r["height"])
        return F.struct(page.alias("page"), used.alias("used"), F.concat(acc["out"], F.array(F.struct(r["row"].alias("row"), page.alias("page")))).alias("out"))

    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("row").cast("int").alias("row"), F.col("height").cast("double").alias("height")))).alias("h"))
    return listed.select("doc_id", F.explode(F.aggregate("h", start, add)["out"]).alias("o")).select("doc_id", "o.row", "o.page")


def pie_slices(values: DataFrame) -> DataFrame:
    """values (doc_id, i, value): fraction, start and end angle from the top, in radians."""
    w = Window.partitionBy("doc_id")
    total = F.greatest(F.sum("value").over(w), F.lit(1.0))
    frac = F.col("value") / total
    out = values.withColumn("fraction", frac)
    before = F.coalesce(F.sum("fraction").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return out.withColumn("start_angle", before * 2 * F.pi() - F.pi() / 2).withColumn("end_angle", (before + F.col("fraction")) * 2 * F.pi() - F.pi() / 2)


def bar_geometry(values: DataFrame, width: float, height: float, gap: float = 0.2) -> DataFrame:
    """values (doc_id, i from 0, value): x, w, h of each bar under a nice maximum."""
    w = Window.partitionBy("doc_id")
    out = values.withColumn("top", nice_max(F.max("value").over(w))).withColumn("__slot", F.lit(width) / F.count("*").over(w))
    return out.withColumn("x", F.col("i") * F.col("__slot") + F.col("__slot") * gap / 2).withColumn("w", F.col("__slot") * (1 - gap)).withColumn("h", F.col("value") / F.col("top") * height).drop("__slot")


def ctm_decompose(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """Width, height and rotation that a matrix gives the unit square."""
    return F.sqrt(a * a + b * b), F.sqrt(c * c + d * d), F.atan2(b, a)


#: Bits of form fields, counted from 1 (fixed values).
FLAGS = {"read_only": 1, "required": 2, "no_export": 3, "multiline": 13, "password": 14, "no_toggle_to_off": 15, "radio": 16, "pushbutton": 17, "combo": 18, "edit": 19, "sort": 20, "file_select": 21, "multi_select": 22, "do_not_spell_check": 23, "do_not_scroll": 24, "comb": 25, "rich_text": 26}


def field_flags(ff: Column) -> Column:
    """Names of the field flags to whether their bit is set."""
    return F.map_from_arrays(F.array(*map(F.lit, FLAGS)), F.array(*[ff.bitwiseAND(F.lit(1 << (b - 1))) != 0 for b in FLAGS.values()]))
