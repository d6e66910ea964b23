"""Operator 5: SimHash near-duplicates by bit-sliced comparison.

1. A map stage turns each text into a 64-bit SimHash of its word shingles (XXH64).
2. Equal fingerprints collapse to one row each (combined before the shuffle).
3. Pigeonhole: two fingerprints within radius r, cut into r + 2 blocks of bits, agree on two
   whole blocks at least; every pair of blocks is a table, its value a bucket. Buckets of one
   fingerprint are dropped; a bucket above ``BLOCK`` is dealt by hash into sub-blocks, and each
   pair of sub-blocks is a unit of work of at most about 2 x BLOCK fingerprints.
4. In a unit, fingerprints stand in lanes of 64, their bits as planes (word p holds bit p of 64
   fingerprints). A query runs down the planes: XOR with its own bit, then a carry-save counter
   that saturates above the radius; every few planes the lanes that are all beyond the radius are
   abandoned. Many (query, lane) pairs run at once.
5. A unit reports a spanning forest of its links, not the pairs; ``graph.components`` joins them.

No cap drops a comparison: sub-blocks make a hot bucket many tasks, not fewer comparisons.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, map_arrow, pieces
from .graph import components

BLOCK = 512
PLANES_AT_ONCE = 8


def simhash_texts(texts: list[str], width: int, seed: int) -> np.ndarray:
    """uint64 fingerprint of each text."""
    hashes, n = [], []
    h = xxhash.xxh64_intdigest
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if len(w) <= width:
            own = [h(b" ".join(w), seed)] if w else []
        else:
            buf = b" ".join(w)
            end = list(itertools.accumulate(map(len, w), lambda a, b: a + b + 1))
            own = [h(buf[a:b], seed) for a, b in zip([0, *(x + 1 for x in end[: len(w) - width])], end[width - 1 :], strict=True)]
        n.append(len(own))
        hashes += own
    return majority(np.array(hashes, np.uint64), np.array(n, np.int64))


def majority(raw: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For runs of n[i] hashes, the bits set in over half of each run; 0 for an empty one."""
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    at = np.cumsum(n) - n
    for p in range(64):
        ones = np.add.reduceat((raw >> np.uint64(p)) & np.uint64(1), at[some])
        out[some] |= (2 * ones.astype(np.int64) > n[some]).astype(np.uint64) << np.uint64(p)
    return out


def fingerprints(df: DataFrame, *, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every text; null or no word: 0."""

    def run(b):
        for lo, hi, part in pieces(b.column(1)):
            yield batch(doc_id=b.column(0).slice(lo, hi - lo), fp=pa.array(simhash_texts(part, width, seed).view(np.int64)))

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


def near_pairs(queries: np.ndarray, lanes: np.ndarray, valid: np.ndarray, query_of: np.ndarray, lane_of: np.ndarray, radius: int) -> np.ndarray:
    """For each job, the mask of lane places within the radius: query_of[i] against block lane_of[i].

    lanes: [blocks, 64] fingerprints; valid: [blocks] masks of the places in use."""
    bits = np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), 64, 8), axis=2, bitorder="little").transpose(0, 2, 1)
    planes = np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits), axis=2, bitorder="little")).view(np.uint64).reshape(len(lanes), 64)
    bound = radius.bit_length()
    job = np.arange(len(query_of))
    out = np.zeros(len(query_of), np.uint64)
    q, lane = queries[query_of], lane_of
    live = valid[lane].copy()
    count = [np.zeros(len(job), np.uint64) for _ in range(bound)]
    for p in range(64):
        add = planes[lane, p] ^ (np.uint64(0) - ((q >> np.uint64(p)) & np.uint64(1)))
        for k in range(bound):  # carry-save: add one bit to the vertical counters
            carry = count[k] & add
            count[k] = count[k] ^ add
            add = carry
        over = add  # past 2**bound - 1
        if radius != (1 << bound) - 1:
            above = np.zeros_like(over)
            equal = ~above
            for k in reversed(range(bound)):
                if not radius >> k & 1:
                    above = above | (equal & count[k])
                    equal = equal & ~count[k]
                else:
                    equal = equal & count[k]
            over = over | above
        live = live & ~over
        if p % PLANES_AT_ONCE == PLANES_AT_ONCE - 1 and p < 63:
            keep = np.flatnonzero(live)
            if len(keep) < 0.7 * len(live):
                job, q, lane, live = job[keep], q[keep], lane[keep], live[keep]
                count = [c[keep] for c in count]
            if not len(job):
                return out
    out[job] = live
    return out


def unit_links(units: list[tuple[np.ndarray, np.ndarray | None]], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in each unit: within a, or between a and b where b is given."""
    out: list[tuple[int, int]] = []
    queries, lanes, valid, query_of, lane_of, unit_of = [], [], [], [], [], []
    n_q = n_l = jobs = 0

    def flush():
        nonlocal queries, lanes, valid, query_of, lane_of, unit_of, n_q, n_l, jobs
        if n_q:
            out.extend(_forest(np.concatenate(queries), np.concatenate(lanes), np.concatenate(valid), np.concatenate(query_of), np.concatenate(lane_of), radius))
        queries, lanes, valid, query_of, lane_of, unit_of = [], [], [], [], [], []
        n_q = n_l = jobs = 0

    for a, b in units:
        to = a if b is None else b
        blocks = -(-len(to) // 64)
        pad = np.zeros(blocks * 64, np.uint64)
        pad[: len(to)] = to
        used = np.full(blocks, np.uint64(2**64 - 1))
        if len(to) % 64:
            used[-1] = np.uint64((1 << len(to) % 64) - 1)
        queries.append(a)
        lanes.append(pad.reshape(blocks, 64))
        valid.append(used)
        query_of.append(np.repeat(np.arange(n_q, n_q + len(a)), blocks))
        lane_of.append(np.tile(np.arange(n_l, n_l + blocks), len(a)))
        n_q, n_l, jobs = n_q + len(a), n_l + blocks, jobs + len(a) * blocks
        if jobs > 100_000:
            flush()
    flush()
    return out


def _forest(queries, lanes, valid, query_of, lane_of, radius):
    masks = near_pairs(queries, lanes, valid, query_of, lane_of, radius)
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    some = np.flatnonzero(masks)
    found = []
    # 4096 jobs at a time: their pairs are unpacked, never those of a whole bucket
    for k in range(0, len(some), 4096):
        j = some[k : k + 4096]
        bits = np.unpackbits(masks[j].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r, c = np.nonzero(bits)
        x, y = queries[query_of[j[r]]], lanes[lane_of[j[r]], c]
        ok = x != y
        for u, v in zip(x[ok].view(np.int64).tolist(), y[ok].view(np.int64).tolist(), strict=True):
            p, q = root(u), root(v)
            if p != q:
                parent[max(p, q)] = min(p, q)
                found.append((u, v))
    return found


def block_tables(radius: int, bits: int = 64) -> list[tuple[list[tuple[int, int]], int]]:
    """Pairs of the radius + 2 blocks of bits, as (shift, width) lists."""
    n = radius + 2
    edge = [bits * k // n for k in range(n + 1)]
    cuts = [(edge[k], edge[k + 1] - edge[k]) for k in range(n)]
    return [[a, b] for a, b in itertools.combinations(cuts, 2)]


def fingerprint_links(fps: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect all distinct fp (a long column) within ``radius`` bits of each other, transitively."""
    if radius < 1:
        raise ValueError("a radius of 0 is equality")

    def value(cuts):
        out = F.lit(0).cast("long")
        for at, width in cuts:
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(F.col("fp"), at).bitwiseAND(F.lit((1 << width) - 1)))
        return out

    tables = [F.struct(F.lit(k).alias("t"), value(c).alias("v")) for k, c in enumerate(block_tables(radius))]
    keyed = fps.select("fp", F.explode(F.array(*tables)).alias("k")).select("fp", "k.t", "k.v")
    n = keyed.groupBy("t", "v").agg(F.count("*").alias("n")).where("n > 1")
    sub = F.pmod(F.xxhash64("fp"), F.col("subs"))
    mine = keyed.join(n, ["t", "v"]).withColumn("subs", F.ceil(F.col("n") / block).cast("long")).withColumn("sub", F.when(F.col("subs") == 1, F.lit(0).cast("long")).otherwise(sub))
    blocks = mine.groupBy("t", "v", "sub").agg(F.first("subs").alias("subs"), F.collect_list("fp").alias("fps"))
    alone = blocks.where("subs = 1").select(F.col("fps").alias("x"), F.lit(None).cast("array<long>").alias("y"))
    # a pair of sub-blocks meets under (lower, upper); a block meets itself under (sub, sub)
    hot = blocks.where("subs > 1").select("t", "v", "sub", "fps", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("other"))
    hot = hot.select("t", "v", F.least("sub", "other").alias("lo"), F.greatest("sub", "other").alias("hi"), "fps")
    hot = hot.groupBy("t", "v", "lo", "hi").agg(F.collect_list("fps").alias("two")).select(F.element_at("two", 1).alias("x"), F.when(F.size("two") > 1, F.element_at("two", 2)).alias("y"), F.col("lo") == F.col("hi"))
    hot = hot.toDF("x", "y", "own").where("own or y is not null").select("x", "y")

    def run(b):
        xs, ys = b.column(0), b.column(1)
        units = [(np.array(x, np.int64).view(np.uint64), None if y is None else np.array(y, np.int64).view(np.uint64)) for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True)]
        got = unit_links(units, radius)
        yield batch(a=pa.array([g[0] for g in got], pa.int64()), b=pa.array([g[1] for g in got], pa.int64()))

    return map_arrow(alone.union(hot), run, "a long, b long")


def near_duplicates(df: DataFrame, *, radius: int = 2, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), component_size (documents).

    Defined cases: null and empty texts have fingerprint 0 and link to each other; rows that repeat
    an id stay rows and share the component; rows without an id stay too and have their component's smallest
    id, or none if no row of it has one; an empty table gives an empty result."""
    marked = cut(fingerprints(df, width=width, seed=seed, id_col=id_col, text_col=text_col))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    comp = components(fingerprint_links(classes.select("fp"), radius)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    placed = classes.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    label = placed.join(whole, "root").select("fp", "component_id", "component_size")
    return marked.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


