"""Near-copies for the corpus pipeline: operator 5 with other parameters, for texts whose sets of five-word shingles have Jaccard similarity ``least`` or more.

Operator 5's contract (three words, 2 of 64 bits) finds copies that are all but equal; edited copies differ by about ten of
64 bits at 0.8, more than any pigeonhole over 64 can carry. So fingerprints meet by min-hashes here, are compared
bit-sliced as in operator 5 within a wide radius, and exact sets decide:

1. Texts with equal shingle sets collapse to one class each. Its ``BANDS`` x ``ROWS`` min-hashes give a
   bucket per band: a pair of similarity s shares one with probability 1 - (1 - s**ROWS)**BANDS, 0.998 at 0.8.
2. Every class of a bucket is compared exactly with the bucket's leader, the class that shares buckets with most others (of many
   edited copies, the original); what agrees is a component.
3. Where components of a bucket still differ, its classes are compared by their SimHash fingerprints, bit-sliced, and exactly where at most ``RADIUS``
   bits differ (a pair at 0.8 differs by 9.7 of 64 on average, with a deviation of 2.9) and the sizes allow it; sets under ``FEW`` shingles,
   whose bits are coarse, in any case. Buckets above ``MEMBERS`` (or ``SHINGLES`` in all) are dealt into sub-blocks; each pair of these is a
   unit of work that holds its own sets and reports a spanning forest of its links, never the pairs.
4. Links are joined by ``graph.components``.

Defined cases: words are runs of other than ASCII white space, A-Z lowered; a text of fewer than five words is one
shingle; null texts and those without a word are one class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, codes_of, cut, map_arrow, mix64, pieces, span_hashes, words_of
from .graph import components
from .license_scan import shingles
from .simhash import majority, near_pairs

WIDTH, BANDS, ROWS, RADIUS, FEW = 5, 16, 5, 20, 24
#: Members and shingles of one sub-block, about; columns of one product of incidences.
MEMBERS, SHINGLES, COLUMNS = 384, 1_000_000, 2048
#: Rows that are broadcast at most (24 bytes each); beyond it the texts are shuffled.
BROADCAST = 500_000
_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_sets(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, by text and then by value, and where each text's begin, with the end."""
    codes, at = codes_of(texts)
    low = np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)
    start, end = words_of(low)
    words = span_hashes(low, start, end)
    doc = np.searchsorted(at, start, side="right") - 1
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    parts, of = [], []
    if len(words) >= width:
        s = shingles(words, width)
        same = np.flatnonzero(doc[width - 1 :] == doc[: len(s)])
        parts.append(s[same])
        of.append(doc[same])
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        with np.errstate(over="ignore"):
            h = np.zeros(len(few), np.uint64)
            for k in range(width - 1):
                some = n[few] > k
                h[some] = mix64(h[some] * np.uint64(0x9E3779B97F4A7C15) + words[first[few[some]] + k])
        parts.append(h)
        of.append(few)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    x, d = np.concatenate(parts), np.concatenate(of)
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    return x[new], np.searchsorted(d[new], np.arange(len(texts) + 1))


def set_hashes(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """One hash per set; 0 for an empty one."""
    out = np.zeros(len(edge) - 1, np.uint64)
    some = np.flatnonzero(np.diff(edge))
    if len(some):
        with np.errstate(over="ignore"):
            out[some] = np.add.reduceat(mix64(x ^ np.uint64(0x5851F42D4C957F2D)), edge[some]) | np.uint64(1)
    return out


def signatures(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """[sets, BANDS] bucket values of sets that are not empty."""
    bands = np.zeros((len(edge) - 1, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BANDS):
            for r in range(k * ROWS, (k + 1) * ROWS):
                low = np.minimum.reduceat((x ^ _XOR[r]) * _ODD[r], edge[:-1])
                bands[:, k] = mix64(bands[:, k] * np.uint64(0x9E3779B97F4A7C15) + low)
    return bands


def _marked(df: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), same (hash of the shingle set), bands, fp (SimHash of the set) and n (its size) of every row."""

    def run(b):
        for lo, hi, part in pieces(b.column(2)):
            x, edge = shingle_sets(part)
            same, some = set_hashes(x, edge), np.diff(edge) > 0
            got = signatures(x, np.append(edge[:-1][some], edge[-1])) if some.any() else np.zeros((0, BANDS), np.uint64)
            at = np.append(0, np.cumsum(some) * BANDS)
            fp = majority(mix64(x), np.diff(edge))
            yield batch(doc_id=b.column(0).slice(lo, hi - lo), t=b.column(1).slice(lo, hi - lo), same=pa.array(same.view(np.int64)), bands=pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(got.ravel().view(np.int64))), fp=pa.array(fp.view(np.int64)), n=pa.array(np.diff(edge), pa.int32()))

    return map_arrow(df, run, "doc_id long, t long, same long, bands array<long>, fp long, n int")


def _sets(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """same, s (the sorted shingle hashes) of the classes asked for (same, rep)."""
    asked = asked.select("same", F.col("rep.doc_id").alias("__id"), F.col("rep.t").alias("t"))
    if asked.count() <= BROADCAST:
        asked = F.broadcast(asked)
    texts = rows.join(asked, (rows["t"] == asked["t"]) & rows["doc_id"].eqNullSafe(asked["__id"])).select("same", "text").dropDuplicates(["same"])

    def sets(b):
        for lo, hi, part in pieces(b.column(1)):
            x, edge = shingle_sets(part)
            yield batch(same=b.column(0).slice(lo, hi - lo), s=pa.array([x[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary()))

    return cut(map_arrow(texts, sets, "same long, s binary"))


def _led(mine: DataFrame, classes: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """a, b: the classes and their buckets' leaders whose sets have Jaccard similarity ``least`` or more."""
    size = classes.select("same", "fp", "n")
    pairs = mine.where("same != lead").select(F.least("lead", "same").alias("a"), F.greatest("lead", "same").alias("b")).distinct()
    pairs = pairs.join(size.toDF("a", "fa", "na"), "a").join(size.toDF("b", "fb", "nb"), "b")
    few, far = F.least("na", "nb") < FEW, F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) > RADIUS
    pairs = pairs.where((few | ~far) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))).select("a", "b")

    def check(b):
        keep = []
        for k in range(b.num_rows):
            x, y = (np.frombuffer(b.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= least * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep))

    two = pairs.join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return cut(map_arrow(two, check, "a long, b long"))


def unit_links(k: int, side: np.ndarray | None, same: np.ndarray, comp: np.ndarray, fp: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between differing components of one unit. side: which of two sub-blocks; None: one alone.
    Pairs that meet in an earlier band are left to it."""
    if (comp == comp[0]).all():
        return []
    m = len(same)
    n = np.array([len(x) for x in sets], np.int32)
    blocks = -(-m // 64)
    lanes = np.zeros(blocks * 64, np.uint64)
    lanes[:m] = fp
    used = np.full(blocks, np.uint64(2**64 - 1))
    if m % 64:
        used[-1] = np.uint64((1 << m % 64) - 1)
    close = np.zeros((m, m), bool)
    for lo in range(0, m, 256):
        q = fp[lo : lo + 256]
        mask = near_pairs(q, lanes.reshape(blocks, 64), used, np.repeat(np.arange(len(q)), blocks), np.tile(np.arange(blocks), len(q)), RADIUS)
        close[lo : lo + 256] = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(q), blocks * 64)[:, :m]
    few = n < FEW
    close |= few | few[:, None]
    close &= (comp != comp[:, None]) & (np.minimum(n, n[:, None]) >= least * np.maximum(n, n[:, None]))
    close &= np.triu(np.ones((m, m), bool), 1) if side is None else (side[:, None] < side)
    for band in range(k):
        close &= bands[:, band] != bands[:, band][:, None]
    some = np.flatnonzero(close.any(0) | close.any(1))
    if not len(some):
        return []
    value, row = np.concatenate([sets[i] for i in some]), np.repeat(np.arange(len(some)), n[some])
    _, col, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count[col] > 1
    new = np.cumsum(count > 1) - 1
    row, col = row[shared], new[col[shared]]
    both = np.zeros((len(some), len(some)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        i, j = np.searchsorted(col, (lo, lo + COLUMNS))
        part = np.zeros((len(some), COLUMNS), np.float32)
        part[row[i:j], col[i:j] - lo] = 1
        both += part @ part.T
    size = n[some]
    agree = close[np.ix_(some, some)] & (both >= least * (size + size[:, None] - both))
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(agree), strict=True):
        p, q = root(int(comp[some[i]])), root(int(comp[some[j]]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(same[some[i]]), int(same[some[j]])))
    return out


def _others(met: DataFrame, label: DataFrame, classes: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """a, b: links between differing components of one bucket."""
    placed = classes.select("same", F.col("n").alias("size")).join(label, "same", "left").select("same", F.coalesce("component", "same").alias("comp"), "size")
    both = met.select("k", "v", "same").join(placed, "same")
    # buckets of one component need no further look
    open_ = both.groupBy("k", "v").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.ceil(F.greatest(F.sum("size") / SHINGLES, F.count("*") / MEMBERS)).cast("long").alias("subs")).where("x != y").select("k", "v", "subs")
    both = both.join(open_, ["k", "v"]).withColumn("sub", F.pmod(F.xxhash64("same"), F.col("subs")))
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
    units = both.select("k", "v", F.least("sub", "other").alias("lo"), F.greatest("sub", "other").alias("hi"), (F.col("sub") > F.col("other")).cast("int").alias("side"), "same", "comp")
    members = units.join(classes.select("same", "fp", "bands"), "same").join(found, "same").select("k", "v", "lo", "hi", "side", "same", "comp", "fp", "bands", "s")
    members = members.repartition("k", "v", "lo", "hi").sortWithinPartitions("k", "v", "lo", "hi", "side", "same")

    def run(batches):
        held, rows = None, []

        def done():
            side, same, comp, fp = (np.array([r[c] for r in rows], np.int64) for c in range(4))
            got = unit_links(held[0], None if held[2] == held[3] else side, same, comp, fp.view(np.uint64), np.array([r[4] for r in rows], np.int64), [np.frombuffer(r[5], np.uint64) for r in rows], least)
            return batch(a=pa.array([min(g) for g in got], pa.int64()), b=pa.array([max(g) for g in got], pa.int64()))

        for b in batches:
            for *unit, side, same, comp, fp, bands, s in zip(*(b.column(c).to_pylist() for c in range(10)), strict=True):
                if unit != held:
                    if rows:
                        yield done()
                    held, rows = unit, []
                rows.append((side, same, comp, fp, bands, s))
        if rows:
            yield done()

    return cut(members.mapInArrow(run, "a long, b long"))


def near_copies(df: DataFrame, *, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t (xxhash64 of the text) and component of every row; rows of one component are near-copies, by links of ``least`` or more."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text"))
    marked = cut(_marked(rows))
    classes = cut(marked.groupBy("same").agg(F.min(F.struct("doc_id", "t")).alias("rep"), F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.first("n").alias("n")).where("n > 0"))
    keyed = classes.select("same", F.posexplode("bands").alias("k", "v"))
    met = cut(keyed.join(keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1"), ["k", "v"]))
    # the leader shares buckets with most others; structs compare field by field
    rank = met.groupBy("same").agg(F.sum("n").alias("met"))
    lead = met.join(rank, "same").groupBy("k", "v").agg(F.max(F.struct("met", "same")).alias("lead")).select("k", "v", F.col("lead.same").alias("lead"))
    found = _sets(rows, classes.join(rank.select("same"), "same", "left_semi"))
    links = _led(met.join(lead, ["k", "v"]), classes, found, least)
    label = components(links).toDF("same", "component")
    label = components(links.union(_others(met, label, classes, found, least))).toDF("same", "component")
    return marked.select("doc_id", "t", "same").join(label, "same", "left").select("doc_id", "t", F.coalesce("component", "same").alias("component"))
