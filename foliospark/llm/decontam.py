"""Operator 10: benchmark decontamination by CGK embedding and bit-sampling LSH.

Characters are the alphabet: texts and items are read as their words (lower case, letters and digits) with one space
between. A CGK random walk maps a stretch of characters to a sequence in which few edits show as few differing
places: at step j it emits the current character and moves on if a random bit of (j, character) says so.
Each of ``REPEATS`` walks samples ``SAMPLED`` places of its sequence as a hash key, from the first quarter, half, three quarters or
all of the steps. A window of an item's size whose key equals the item's in one walk is a candidate. At 0.8
similarity two walks agree in about 0.35 of their places (0.13 for unrelated texts), so a pair meets with probability
1 - (1 - 0.35**SAMPLED)**REPEATS, 0.99 with the constants below. Candidates are verified by exact edit distance (bit-parallel, the item against the
best-fitting stretch of the neighbourhood) and kept at ``least`` similarity or more.

Windows are embedded where they can matter. An item's seeds are its stretches of ``2 * REACH + 1`` characters round
the spaces between its words (round every third character, by hash, in scripts without spaces). A window goes on if
``SEEDS`` of its seeds (or a tenth of the item's) are the item's, at about the places that they have there. One changed letter in each word still leaves a third of the
seeds, and a window is counted for each item by itself, so what stands beside it never keeps it out. Items with few words have a third
of their stretches of five characters as seeds, by hash; very short ones have all and need one. This is a matter of probability too: recall by edit rate, against brute force, is in the README and in the tests.

Scale: map only over the documents. Items travel with the tasks in slices of at most ``SLICE_CHARS``
characters; a larger benchmark takes one pass per slice, so what is sent stays bounded and nothing is dropped. Seeds that over a
fiftieth of the items have are left out where an item has ``ENOUGH`` rarer ones, so hits per character do not grow with the slice.

Defined cases: null and empty texts and items match nothing; equal items each report; repeated rows each
report; a text may match an item at several places, each a row; other columns are ignored; empty
tables give an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, codes_of, mix64, pieces
from .license_scan import fold

REPEATS, SAMPLED, SLACK = 40, 2, 24
#: Characters on each side of a seed's middle; seeds that a window needs; seeds that make an item one of many words.
REACH, SEEDS, ENOUGH = 3, 3, 16
#: Share of an item's seeds that a window needs, where that is more.
SHARE = 0.1
SHORT = 5
RATIO = 1.2
SLICE_CHARS = 16_000_000
#: Characters of one piece: candidates of a piece are embedded together.
PIECE_CHARS = 600_000
MASK = (1 << 22) - 1
NO_SPACES = 0x2E80
SYMBOLS = 64


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts as read (each ' word word ', with a 0 after it), each one's place in its own text, and where each text begins, with the end."""
    codes, at = codes_of(texts)
    low, start, end = fold(codes)
    doc = np.searchsorted(at, start, side="right") - 1
    size = end - start + 1  # a word and the space before it
    n = np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64)
    edge = np.append(0, np.cumsum(np.where(n > 0, n + 2, 1)))
    words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(words) - words
    before = np.cumsum(size) - size
    to = before - before[np.minimum(first[doc], max(0, len(size) - 1))] + edge[doc] if len(size) else before
    pick = np.arange(int(size.sum())) - np.repeat(before, size)
    z, place = np.zeros(int(edge[-1]), np.uint32), np.zeros(int(edge[-1]), np.int64)
    here = np.repeat(to, size) + pick
    source = np.repeat(start, size) + pick - 1
    z[here] = np.where(pick == 0, 32, low[source])
    place[here] = np.maximum(source, 0) - np.repeat(at[doc], size)
    some = np.flatnonzero(n)
    z[edge[some] + n[some]] = 32
    place[edge[some] + n[some]] = place[edge[some] + n[some] - 1]
    return z, place, edge


def seed_hashes(z: np.ndarray, p: np.ndarray, back: int, on: int) -> np.ndarray:
    """Hash of the characters from p - back to p + on."""
    h = np.full(len(p), np.uint64(back * 64 + on))
    row = len(p) > 0 and int(p[-1]) - int(p[0]) == len(p) - 1
    with np.errstate(over="ignore"):
        for d in range(-back, on + 1):
            h = h * np.uint64(0x9E3779B97F4A7C15) + (z[p[0] + d : p[-1] + d + 1] if row else z[p + d])
    return mix64(h)


def middles(z: np.ndarray) -> np.ndarray:
    """Places round which seeds lie."""
    dense = z >= NO_SPACES
    with np.errstate(over="ignore"):
        third = mix64(z.astype(np.uint64)) % np.uint64(3) == 0 if dense.any() else dense
    p = np.flatnonzero((z == 32) | (dense & third))
    return p[(p >= REACH) & (p < len(z) - REACH)]


def distances(pattern: str, text: str) -> list[int]:
    """For each end in the text the least edit distance of the pattern to a stretch that ends there."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        out.append(score)
    return out


def matches(pattern: str, text: str, limit: int) -> list[tuple[int, int, int]]:
    """(distance, start, end) of stretches within the limit, closest first, none overlapping another."""
    m, score = len(pattern), distances(pattern, text)
    out: list[tuple[int, int, int]] = []
    for d, e in sorted((d, e + 1) for e, d in enumerate(score) if d <= limit):
        if any(e > a and e - (m - d) < b for _, a, b in out):
            continue
        back = distances(pattern[::-1], text[max(0, e - m - d) : e][::-1])
        s = e - 1 - back.index(d) if d in back else e
        if all(e <= a or s >= b for _, a, b in out):
            out.append((d, s, e))
    return out


class Items:
    """Items, their seeds, classes and keys, from (id, text) rows."""

    def __init__(self, rows: list[tuple[int, str]], seed: int = 1):
        z, _, edge = normal([t or "" for _, t in rows])
        some = np.flatnonzero(np.diff(edge) > 2)
        self.ids = [rows[i][0] for i in some]
        self.codes = [z[edge[i] + 1 : edge[i + 1] - 2] for i in some]
        self.texts = [c.tobytes().decode("utf-32-le", "surrogatepass") for c in self.codes]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.need = np.full(len(self.ids), SEEDS)
        key, item, at, every = [], [], [], []
        for i, c in enumerate(self.codes):
            p = middles(c)
            if len(p) >= ENOUGH:
                h = seed_hashes(c, p, REACH, REACH)
                key.append(h)
                at.append(p)
            else:
                c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
                q = min(SHORT, len(c))
                p = np.arange(len(c) - q + 1)
                h = seed_hashes(c, p, 0, q - 1)
                third = h % np.uint64(3) == 0
                every.append((q, bool(third.sum() >= ENOUGH)))
                if third.sum() >= ENOUGH:
                    p, h = p[third], h[third]
                    self.need[i] = max(SEEDS, round(2 * SHARE * len(p)))  # shorter seeds meet by chance more often
                else:
                    self.need[i] = 1
                key.append(h)
                at.append(p - 1)
            item.append(np.full(len(p), i))
        self.every = sorted({(q, all(t for n, t in every if n == q)) for q, _ in every})  # lengths, and whether a third of their seeds is enough
        key, item, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (key, item, at))
        key = key.astype(np.uint64)
        if len(key):
            # in how many items a seed stands; the common ones go where enough are left
            _, back, n = np.unique(np.unique(np.stack([key, item.astype(np.uint64)], 1), axis=0)[:, 0], return_inverse=True, return_counts=True)
            values = np.unique(key)
            spread = n[np.searchsorted(values, key)]
            order = np.lexsort((spread, item))
            rank = np.arange(len(key)) - np.searchsorted(item[order], item[order])
            keep = np.zeros(len(key), bool)
            keep[order] = rank < ENOUGH
            keep |= spread <= max(8, len(self.ids) // 50)
            key, item, at = key[keep], item[keep], at[keep]
            own = np.bincount(item, minlength=len(self.ids))
            self.need = np.where(self.need > 1, np.maximum(self.need, np.round(own * SHARE).astype(np.int64)), 1)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.at = key[order], item[order], at[order]
        self.bitmap = np.zeros(MASK + 1, bool)
        self.bitmap[(self.key & np.uint64(MASK)).astype(np.int64)] = True
        self.band = np.maximum(12, self.size // 8)
        self.classes, self.class_of = [], np.zeros(len(self.ids), np.int64)
        left = sorted(range(len(self.ids)), key=lambda i: (self.size[i], i))
        while left:
            short = int(self.size[left[0]])
            own = [i for i in left if self.size[i] <= short * RATIO]
            left = left[len(own) :]
            self.class_of[own] = len(self.classes)
            self.classes.append(_Class(self, own, short, int(self.size[own[-1]]), seed))

    def hits(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, where the item would begin, which seed) of every seed found in z."""
        found = []
        if len(self.key):
            p = middles(z)
            found.append((p, seed_hashes(z, p, REACH, REACH)))
            for q, third in self.every:
                p = np.arange(max(0, len(z) - q + 1))
                h = seed_hashes(z, p, 0, q - 1)
                some = np.flatnonzero(h % np.uint64(3) == 0) if third else p
                found.append((p[some], h[some]))
        items, begins, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for p, h in found:
            some = np.flatnonzero(self.bitmap[(h & np.uint64(MASK)).astype(np.int64)])
            lo, hi = np.searchsorted(self.key, h[some]), np.searchsorted(self.key, h[some], side="right")
            n = hi - lo
            k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            items.append(self.item[k])
            begins.append(np.repeat(p[some], n) - self.at[k])
            seeds.append(self.key[k])
        return np.concatenate(items), np.concatenate(begins), np.concatenate(seeds)


def _symbols(codes: np.ndarray) -> np.ndarray:
    """Characters as one of ``SYMBOLS`` - 1, and 0 for the end, which no walk leaves."""
    with np.errstate(over="ignore"):
        return np.where(codes == 0, 0, 1 + (mix64(codes.astype(np.uint64)) % np.uint64(SYMBOLS - 1)).astype(np.int64))


class _Class:
    def __init__(self, items: Items, own: list[int], short: int, long: int, seed: int):
        self.width = long
        rng = np.random.default_rng([seed, short])
        steps = max(2 * short, 4 * SAMPLED)
        self.places = [sorted(rng.choice(max(SAMPLED, steps * (1 + r % 4) // 4), SAMPLED, replace=False).tolist()) for r in range(REPEATS)]
        self.moves = rng.integers(0, 2, (REPEATS, steps, SYMBOLS), dtype=np.int64)
        self.moves[:, :, 0] = 0
        x = np.zeros((len(own), long + 1), np.uint32)
        for r, i in enumerate(own):
            x[r, : items.size[i]] = items.codes[i]
        self.row = {i: r for r, i in enumerate(own)}
        self.own = self.keys(x)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """[walks, rows] keys of rows of characters (zero after each one's last)."""
        symbol, width = _symbols(x).ravel(), x.shape[1]
        flat = x.ravel()
        base = np.arange(len(x), dtype=np.int64) * width
        key = np.zeros((REPEATS, len(x)), np.uint64)
        order = sorted(range(REPEATS), key=lambda r: -self.places[r][-1])  # walks end at their last place
        at = np.broadcast_to(base, (REPEATS, len(x))).copy()
        live = REPEATS
        sampled: dict[int, list[int]] = {}
        for k, r in enumerate(order):
            for j in self.places[r]:
                sampled.setdefault(j, []).append(k)
        with np.errstate(over="ignore"):
            for j in range(self.places[order[0]][-1] + 1):
                while self.places[order[live - 1]][-1] < j:
                    live -= 1
                now = at[:live]
                if k := sampled.get(j):
                    r = [order[x] for x in k]
                    key[r] = mix64(key[r] * np.uint64(0x9E3779B97F4A7C15) + flat[now[k]] + np.uint64(1))
                now += self.moves[order[:live], j][np.arange(live)[:, None], symbol[now]]
        return key


def candidates(items: Items, z: np.ndarray, edge: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """(text, item): places in z where the item may begin."""
    item, begin, seed = items.hits(z)
    # seeds of one copy begin at about one place: bands of an eighth of the item, each twice, by halves; a seed counts once
    band = items.band[item]
    rows = []
    for half in (0, 1):
        where = (begin + half * (band // 2)) // band
        with np.errstate(over="ignore"):
            group = mix64(item.astype(np.uint64) * np.uint64(2) + np.uint64(half)) ^ mix64(where.astype(np.uint64))
        # counters by hash first: most hits are alone, and only the rest are sorted
        size = np.uint64((1 << max(10, (2 * len(group)).bit_length())) - 1)
        slot = (group & size).astype(np.int64)
        some = np.flatnonzero(np.bincount(slot)[slot] >= items.need[item]) if len(slot) else slot
        order = some[np.lexsort((seed[some], group[some]))]
        g, x = group[order], seed[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
        head = np.ones(len(g), bool)
        head[1:] = g[1:] != g[:-1]
        n = np.add.reduceat(new.astype(np.int64), np.flatnonzero(head)) if len(g) else new.astype(np.int64)
        enough = n[np.cumsum(head) - 1] >= items.need[item[order]]
        rows.append(order[enough])
    keep = np.unique(np.concatenate(rows))
    item, begin = item[keep], begin[keep]
    doc = np.clip(np.searchsorted(edge, np.maximum(begin + items.size[item] // 2, 0), side="right") - 1, 0, len(edge) - 2)
    begin = np.maximum(begin, edge[doc] + 1)
    if not len(item):
        return {}
    found = np.unique(np.stack([item, begin, doc], 1), axis=0)
    out: dict[tuple[int, int], list[int]] = {}
    for k, c in enumerate(items.classes):
        mine = found[items.class_of[found[:, 0]] == k]
        for lo in range(0, len(mine), 1000):
            i, b, d = mine[lo : lo + 1000].T
            at = b[:, None] + np.arange(c.width)
            x = np.zeros((len(i), c.width + 1), np.uint32)
            stop = np.minimum(edge[d + 1], b + items.size[i])
            x[:, :-1] = np.where(at < stop[:, None], z[np.minimum(at, len(z) - 1)], 0)
            ok = (c.keys(x) == c.own[:, [c.row[j] for j in i.tolist()]]).any(axis=0)
            for j, place, text in zip(i[ok].tolist(), b[ok].tolist(), d[ok].tolist(), strict=True):
                out.setdefault((text, j), []).append(place)
    return out


def scan_texts(items: Items, texts: list[str], least: float) -> list[tuple[int, int, int, float, int, int]]:
    """(text, item id, distance, similarity, start, end in characters)."""
    if not items.ids:
        return []
    z, place, edge = normal(texts)
    out = []
    for (d, i), places in sorted(candidates(items, z, edge).items()):
        places.sort()
        n, pattern = int(items.size[i]), items.texts[i]
        limit = int((1 - least) * n + 1e-9)
        reach, k = n // 4 + SLACK, 0
        while k < len(places):
            lo = hi = places[k]
            while k < len(places) and places[k] - hi <= n:
                hi = places[k]
                k += 1
            a, b = max(int(edge[d]) + 1, lo - reach), min(int(edge[d + 1]) - 2, hi + n + reach)
            text = z[a:b].tobytes().decode("utf-32-le", "surrogatepass")
            for dist, s, e in matches(pattern, text, limit):
                # whole words, with no more letters beside than the limit: "kilo" does not stand in "kilometre"
                x, y = s, e
                while s > 0 and text[s - 1] != " " and text[s] != " " and ord(text[s - 1]) < NO_SPACES:
                    s -= 1
                while e < len(text) and text[e] != " " and text[e - 1] != " " and ord(text[e]) < NO_SPACES:
                    e += 1
                if x - s + e - y > limit:
                    continue
                s += text[s] == " "
                out.append((d, items.ids[i], dist, 1 - dist / n, int(place[a + s]), int(place[a + e - 1 - (text[e - 1] == " ")]) + 1))
    return out


@functools.lru_cache(maxsize=2)
def _built(key: int, given: tuple) -> Items:
    return Items(list(given))


def items_of(given: list[tuple[int, str]]) -> Items:
    """The items, built once in a worker."""
    return _built(xxhash.xxh64_intdigest(repr(given).encode("utf-8", "surrogatepass")), tuple(given))


def find(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row per leak: doc_id, item_id, distance, similarity, start_char, end_char."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("i is not null and t is not null")
    slices = max(1, -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // slice_chars))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for k in range(slices):
        mine = items if slices == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k)
        out = _pass(rows, sorted((r["i"], r["t"]) for r in mine.collect()), least) if out is None else out.union(_pass(rows, sorted((r["i"], r["t"]) for r in mine.collect()), least))
    return out


def _pass(rows: DataFrame, given: list[tuple[int, str]], least: float) -> DataFrame:
    def run(batches):
        items = items_of(given)
        for b in batches:
            for lo, _, part in pieces(b.column(1), PIECE_CHARS):
                got = scan_texts(items, part, least)
                if got:
                    c = list(zip(*got, strict=True))
                    yield batch(doc_id=b.column(0).take(pa.array([lo + d for d in c[0]])), item_id=pa.array(c[1], pa.int64()), distance=pa.array(c[2], pa.int32()), similarity=pa.array(c[3], pa.float64()), start_char=pa.array(c[4], pa.int32()), end_char=pa.array(c[5], pa.int32()))

    return rows.mapInArrow(run, "doc_id long, item_id long, distance int, similarity double, start_char int, end_char int")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.8, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, in which no item stands (map only; several slices take several passes)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    slices = max(1, -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // SLICE_CHARS))
    at = docs.columns.index(text_col)
    for k in range(slices):
        given = sorted((r["i"], r["t"]) for r in (items if slices == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k)).collect())

        def run(batches, given=given):
            own = items_of(given)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for lo, _, part in pieces(b.column(at), PIECE_CHARS):
                    for row in scan_texts(own, part, least):
                        clean[lo + row[0]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
