"""Operator 8: near-duplicate passages by compact windows.

Tokens are shingles of ``SHINGLE`` words (lower case, letters and digits). Under a hash function a
text's tokens form a Cartesian tree; a node c whose subtree spans at least ``min_words`` words is a compact
window (l, c, r): every stretch that begins in [l, c] and ends in [c, r] has the min-hash of c, so one row
stands for all of them. About 2 n / min_words nodes of n qualify; they are found by sparse tables in numpy.

1. One min-hash is only one shared shingle, so windows meet by more. Of each window go out, for either side of c,
   * for ``FUNCTIONS`` pairs of hash functions: (min-hash of c, the other function's min-hash over the near side), which
     similar stretches share, with the min-hashes of four runs of shingles on each side, a byte each, and
   * for the first function: the exact words at c and on the near side (half a passage), with the words beyond, a byte each.
     An exact repeat of min_words words or more shares at least one of the two sides.
   Groups of exact words are split into every stretch of min_words words that holds the key: whoever shares a stretch has the
   passage, so a link to the first (lowest doc_id) loses none. Groups of min-hashes link to their first and, so that one who
   shares only the near side hides nobody, to the first of each split by four runs round c, all of them or three.
   A task links its own windows so and sends on those that are first in any split: what it keeps back has a
   link in every split, and its partner goes on in its place. Links of one pair that lie on one diagonal and meet travel as one.
2. Links of one pair of documents are interval-joined: overlapping windows on about one diagonal are one candidate.
3. Candidates take their stretches of text from both documents in one native join, which AQE may split for a hot
   partner; the two of a pair then meet, and are verified exactly: maximal stretches of shared shingles with Jaccard similarity ``least`` or more and
   ``min_words`` words or more.

What is certain: an exact repeat of min_words words or more is found whatever else the documents around it hold, but for
bytes that are equal by chance (one in 255 for an earlier document with all but one word of a stretch, and that to the power of the words it lacks).
Repeats with edits meet with a probability (measured in the README).

A row is a passage of doc_id that repeats one of the earlier document partner_id. The first occurrence
thus has no row of its own, and cutting all reported passages keeps one copy of each.

Defined cases: null and empty texts and those under min_words words have no passage; rows with one
doc_id count as one document (no links among them); repeats within one document are not reported; null ids are
left out; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_CHARS, batch, codes_of, cut, mix64, pieces, span_hashes
from .license_scan import fold, shingles

SHINGLE, FUNCTIONS = 5, 2
#: Rows of one key that are linked at once; of more, only those that lead a group are kept.
HELD = 50_000
#: Runs of shingles on each side of a window's anchor, whose min-hashes split groups of min-hashes.
RUNS = 4
#: Ids that are broadcast at most (eight bytes each); beyond it all texts are shuffled.
BROADCAST = 1_000_000
#: Shared shingles at each end of a stretch that tell where the partner's begins and ends.
ENDS = 24
#: Characters added on both sides of a candidate before it is verified.
MARGIN = 120
_PLACE = 24


def _seed(f: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (f + 1)) & 0xFFFFFFFFFFFFFFFF)


def compact_windows(value: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r (inclusive) of the Cartesian tree's nodes that span at least ``least`` places. value: uint64, 0 ends a text; equal values: the left one is smaller."""
    n = len(value)
    if n < least:
        z = np.zeros(0, np.int64)
        return z, z, z
    bits = max(_PLACE, n.bit_length())
    place = np.uint64(bits)
    v = ((value >> place) << place) | np.arange(n, dtype=np.uint64)
    end = value == 0
    v[end] = 0
    table, width = [v], 1
    while width < n:
        a = table[-1]
        b = a.copy()
        np.minimum(a[: n - width], a[width:], out=b[: n - width])
        b[max(0, n - 2 * width + 1) :] = 0  # past the end stands an end
        table.append(b)
        width *= 2
    level = least.bit_length() - 1
    rest = least - (1 << level)
    m = np.minimum(table[level][: n - least + 1], table[level][rest : n - least + 1 + rest])
    c = np.unique((m[m != 0] & np.uint64((1 << bits) - 1)).astype(np.int64))
    x = v[c]
    right, left = c + 1, c.copy()
    for k in range(len(table) - 1, -1, -1):
        go = (right + (1 << k) <= n) & (table[k][np.minimum(right, n - 1)] > x)
        right += go.astype(np.int64) << k
        back = left - (1 << k)
        go = (back >= 0) & (table[k][np.maximum(back, 0)] > x)
        left = np.where(go, back, left)
    return left, c, right - 1


def tokens_of(texts: list[str]):
    """Word starts and ends (in characters of the piece), text of each word, word hashes, shingle hash at each word (0: none begins), and text starts."""
    codes, at = codes_of(texts)
    low, start, end = fold(codes)
    words = span_hashes(low, start, end)
    doc = np.searchsorted(at, start, side="right") - 1
    token = np.zeros(len(words), np.uint64)
    if len(words) >= SHINGLE:
        s = shingles(words, SHINGLE) | np.uint64(1)
        same = doc[SHINGLE - 1 :] == doc[: len(s)]
        token[: len(s)] = np.where(same, s, 0)
    return start, end, doc, words, token, at


def sides(min_words: int) -> tuple[int, int]:
    """Words of the near side, and of what a stretch of ``min_words`` words has beyond it, without the anchor's own shingle."""
    near = (min_words - SHINGLE + 1) // 2
    return near, min_words - SHINGLE - near


def width(min_words: int) -> int:
    """Bytes that tell what lies around a window."""
    return max(2 * sides(min_words)[1], 2 * RUNS)


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of n places; 0 where it leaves a text or the array."""
    m, width = h, 1
    while 2 * width <= n:
        m = np.append(np.minimum(m[:-width], m[width:]), np.zeros(width, np.uint64)) if len(m) > width else np.zeros_like(m)
        width *= 2
    rest = n - width
    return np.append(np.minimum(m[: len(m) - rest], m[rest:]), np.zeros(rest, np.uint64)) if 0 < rest < len(m) else m if not rest else np.zeros_like(m)


def windows_of(texts: list[str], min_words: int):
    """key, text, l, c, r (characters) and bytes around of all compact windows' sides. The key's last three bits are its kind. Around: a byte for
    each word beyond the near side and on the other side, from c outwards, of exact words; for each run of shingles on the left and on the right of min-hashes;
    0 where the text ends. Of equal ones in one text, one for each ``min_words`` of the way, so that every repeat has its own."""
    start, end, doc, words, token, at = tokens_of(texts)
    none = np.zeros(0, np.int64)
    wide = width(min_words)
    if len(words) < min_words:
        return none.astype(np.uint64), none, none, none, none, np.zeros((0, wide), np.uint8)
    near, beyond = sides(min_words)
    some, run = max(1, (min_words - SHINGLE) * 4 // 9), max(1, (min_words - SHINGLE + 1) // RUNS)
    first, last = np.searchsorted(doc, doc), np.searchsorted(doc, doc, side="right")
    word_byte = (words % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    out = []

    def hashed(f):
        with np.errstate(over="ignore"):
            h = mix64(token ^ _seed(f))
        return np.where(token == 0, np.uint64(0), h | np.uint64(1 << _PLACE))

    def add(kind, key, some, l, c, r, around):
        k = np.flatnonzero(some)
        key = (mix64(key[k] + np.uint64(kind)) & ~np.uint64(7)) | np.uint64(kind)
        d = doc[c[k]]
        out.append((key, d, start[l[k]] - at[d], start[c[k]] - at[d], end[r[k] + SHINGLE - 1] - at[d], around[k], c[k]))

    def bytes_at(values, c, where):
        """values at the places where, as far as they are in the text of c; 0 elsewhere."""
        inside = (where >= first[c][:, None]) & (where < last[c][:, None])
        return np.where(inside, values[np.clip(where, 0, len(values) - 1)], np.uint8(0))

    for f in range(FUNCTIONS):
        h, other = hashed(f), hashed(f + FUNCTIONS)
        l, c, r = compact_windows(h, min_words - SHINGLE + 1)
        low = _least(other, some)
        right, left = low[c], np.where(c >= some - 1, low[np.maximum(c - some + 1, 0)], np.uint64(0))
        runs = _least(other, run)
        run_byte = np.where(runs == 0, 0, mix64(runs) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
        k = run * np.arange(RUNS)
        around = np.zeros((len(c), wide), np.uint8)
        around[:, :RUNS] = bytes_at(run_byte, c, c[:, None] - run - k)
        around[:, RUNS : 2 * RUNS] = bytes_at(run_byte, c, c[:, None] + 1 + k)
        with np.errstate(over="ignore"):
            for side, sig in enumerate((left, right)):
                add(2 * f + side, h[c] ^ mix64(sig), sig != 0, l, c, r, around)
        if f == 0:
            k = np.arange(beyond)
            for side in (0, 1):
                i, j = (c - near, c + SHINGLE) if side == 0 else (c, c + SHINGLE + near)
                ok = (i >= first[c]) & (j <= last[c])
                key = span_hashes(words, np.where(ok, i, 0), np.where(ok, j, 0))
                around = np.zeros((len(c), wide), np.uint8)
                around[:, :beyond] = bytes_at(word_byte, c, i[:, None] - 1 - k)
                around[:, beyond : 2 * beyond] = bytes_at(word_byte, c, j[:, None] + k)
                add(2 * FUNCTIONS + side, key, ok, l, c, r, around)
    key, d, l, c, r, around, token_at = (np.concatenate(z) for z in zip(*out, strict=True))
    same = key.copy()
    for k in range(0, wide, 8):
        with np.errstate(over="ignore"):
            same = mix64(same + _longs(around[:, k : k + 8]))
    order = np.lexsort((c, d, same))
    key, d, l, c, r, around, token_at, same = (z[order] for z in (key, d, l, c, r, around, token_at, same))
    one = np.ones(len(key), bool)
    one[1:] = (same[1:] != same[:-1]) | (d[1:] != d[:-1])
    if len(key):
        far = (token_at - token_at[np.flatnonzero(one)][np.cumsum(one) - 1]) // (min_words - SHINGLE + 1)
        one[1:] |= far[1:] != far[:-1]
    return key[one], d[one], l[one], c[one], r[one], around[one]


def _longs(b: np.ndarray) -> np.ndarray:
    """Up to eight bytes of each row as one number."""
    v = np.zeros(len(b), np.uint64)
    for k in range(b.shape[1]):
        v |= b[:, k].astype(np.uint64) << np.uint64(8 * k)
    return v


def _leaders(group: np.ndarray) -> np.ndarray:
    """For each row the first row of its group."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    head = np.ones(len(g), bool)
    head[1:] = g[1:] != g[:-1]
    lead = np.empty(len(g), np.int64)
    lead[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    return lead


def link(key: np.ndarray, doc: np.ndarray, around: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, their partners, which rows others may still need) of rows sorted by key and doc."""
    n = max(1, len(key))
    exact = (key & np.uint64(7)) >= 2 * FUNCTIONS
    lead = _leaders(key)
    # who is alone, or the first in any split, may be the partner of rows to come
    needed = np.bincount(lead, minlength=len(key))[lead] == 1
    more = ~needed
    links = [np.zeros(0, np.int64)]

    def meet(rows, split):
        to = rows[_leaders(split)]
        other = doc[rows] != doc[to]
        links.append(rows[other] * np.int64(n) + to[other])
        # further places of the first document need partners of their own
        needed[rows[~other]] = True

    with np.errstate(over="ignore"):
        e = np.flatnonzero(more & exact)
        if len(e):
            beyond = sides(min_words)[1]
            left, right = around[e, :beyond], around[e, beyond : 2 * beyond]
            has_left, has_right = np.count_nonzero(left, axis=1), np.count_nonzero(right, axis=1)
            outer = [mix64(key[e])]
            for k in range(beyond):
                outer.append(mix64(outer[-1] + right[:, k]))
            inner = np.zeros(len(e), np.uint64)
            for own in range(beyond + 1):
                inside = np.flatnonzero((has_left >= own) & (has_right >= beyond - own))
                meet(e[inside], mix64(outer[beyond - own][inside] ^ inner[inside]))
                if own < beyond:
                    inner = mix64(inner + left[:, own] + np.uint64(1 << 32))
        e = np.flatnonzero(more & ~exact)
        if len(e):
            meet(e, key[e])
            for own in range(RUNS + 1):
                runs = np.concatenate([around[e, :own], around[e, RUNS : 2 * RUNS - own]], axis=1)
                for out in range(-1, RUNS):
                    kept = np.delete(runs, out, axis=1) if out >= 0 else runs
                    inside = np.flatnonzero(kept.all(axis=1))
                    meet(e[inside], mix64(key[e][inside] ^ mix64(_longs(kept[inside]) + np.uint64((own * 8 + out + 1) << 40))))
    both = np.unique(np.concatenate(links))
    return both // n, both % n, needed


#: Bits for the characters from a window's anchor to either end; a window that reaches further has its ends in columns of their own.
_REACH = 16


def _packed(l: np.ndarray, c: np.ndarray, r: np.ndarray) -> dict[str, pa.Array]:
    """A window's place as one long, which a shuffle compresses better than three columns: place, and l and r where they do not fit."""
    wide = np.maximum(c - l, r - c) >> _REACH > 0
    place = (c << 2 * _REACH) | np.where(wide, 0, ((c - l) << _REACH) | (r - c))
    return {"place": pa.array(place, pa.int64()), "l": pa.array(l, pa.int32(), mask=~wide), "r": pa.array(r, pa.int32(), mask=~wide)}


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = b.column("place").to_numpy(zero_copy_only=False)
    c, low = place >> 2 * _REACH, (1 << _REACH) - 1
    out = []
    for name, near in (("l", c - (place >> _REACH & low)), ("r", c + (place & low))):
        given = b.column(name)
        out.append(near if given.null_count == len(given) else np.where(pc.is_valid(given).to_numpy(zero_copy_only=False), pc.fill_null(given, 0).to_numpy(zero_copy_only=False), near))
    return out[0], c, out[1]


def _binary(around: np.ndarray, size: np.ndarray) -> pa.Array:
    """The first ``size`` bytes of each row."""
    to = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=to[1:])
    data = around[np.arange(around.shape[1]) < size[:, None]]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(to.tobytes()), pa.py_buffer(data.tobytes())])


def _around(b: pa.Array, wide: int) -> np.ndarray:
    """What ``_binary`` packed, with zeros up to ``wide``."""
    to = np.frombuffer(b.buffers()[1], np.int32, len(b) + 1, 4 * b.offset)
    size = np.diff(to)
    around = np.zeros((len(b), wide), np.uint8)
    if len(b) and to[-1] > to[0]:
        around[np.arange(wide) < size[:, None]] = np.frombuffer(b.buffers()[2], np.uint8, int(to[-1] - to[0]), int(to[0]))
    return around


def merged(d: np.ndarray, p: np.ndarray, own: list[np.ndarray], other: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """d, p, start, end, partner's start of links (own and other: l, c, r), one for those of a pair that ``stretches`` joins on one diagonal anyway:
    the windows of one passage all give the same candidate, whatever their kind."""
    (l, c, r), (pl, pc, pr) = own, other
    start, end, off = c - np.minimum(c - l, pc - pl), c + np.minimum(r - c, pr - pc), pc - c
    order = np.lexsort((start, off, p, d))
    d, p, start, end, off = (z[order] for z in (d, p, start, end, off))
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1]) | (off[1:] != off[:-1])
    # the furthest end so far in each run of one pair and diagonal
    run = np.cumsum(new) << 32
    far = np.maximum.accumulate(run | end) - run
    new[1:] |= start[1:] > far[:-1] + MARGIN
    head = np.flatnonzero(new)
    return d[head], p[head], start[head], far[np.append(head[1:], len(d)) - 1] if len(d) else end, start[head] + off[head]


def _linked(key, ids, place, i, j, min_words) -> pa.RecordBatch:
    """Links i -> j, merged; their key only spreads them, and the anchor is the start. Without j: rows for their groups."""
    if j is None:
        own, d, at, p, to = key[i], ids[i], [z[i] for z in place[:3]], pa.nulls(len(i), pa.int64()), [pa.nulls(len(i), pa.int32())] * 3
        around = _binary(place[3][i], np.where((own & np.uint64(7)) >= 2 * FUNCTIONS, 2 * sides(min_words)[1], 2 * RUNS))
    else:
        d, p, start, end, other = merged(ids[i], ids[j], [z[i] for z in place[:3]], [z[j] for z in place[:3]])
        with np.errstate(over="ignore"):
            own = mix64(mix64(d.astype(np.uint64)) + start.astype(np.uint64)) & ~np.uint64(7)
        at, p, to = [start, start, end], pa.array(p), [pa.array(z, pa.int32()) for z in (other, other, other + end - start)]
        around = pa.nulls(len(d), pa.binary())
    return batch(key=pa.array(own.view(np.int64)), doc_id=pa.array(d), **_packed(*at), around=around, p=p, pl=to[0], pc=to[1], pr=to[2])


def passage_links(df: DataFrame, min_words: int) -> DataFrame:
    """Per link, of whatever kind: doc_id, l, c, r and the partner's p, pl, pc, pr; doc_id > p."""

    def run(batches):
        for b in batches:
            ids_all = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, part in pieces(b.column(1)):
                key, d, *place = windows_of(part, min_words)
                if not len(key):
                    continue
                ids = ids_all[lo:hi][d]
                order = np.lexsort((place[1], ids, key))
                key, ids, place = key[order], ids[order], [z[order] for z in place]
                i, j, needed = link(key, ids, place[3], min_words)
                yield _linked(key, ids, place, np.flatnonzero(needed), None, min_words)
                if len(i):
                    yield _linked(key, ids, place, i, j, min_words)

    schema = "key long, doc_id long, place long, l int, r int, around binary, p long, pl int, pc int, pr int"
    rows = df.mapInArrow(run, schema).repartition("key").sortWithinPartitions("key", "doc_id", "place")

    def meet(batches):
        held, kept = None, 0
        for b in batches:
            given = pc.is_valid(b.column(6))
            yield _links_only(b.filter(given))
            b = b.filter(pc.invert(given))
            if not b.num_rows:
                continue
            now = [*(b.column(k).to_numpy(zero_copy_only=False) for k in ("key", "doc_id")), *_unpacked(b), _around(b.column("around"), width(min_words))]
            held = now if held is None else [np.concatenate(z) for z in zip(held, now, strict=True)]
            # the last key may go on in the next batch
            to = int(np.searchsorted(held[0], held[0][-1]))
            if to:
                yield from done([z[:to] for z in held])[0]
                held, kept = [z[to:] for z in held], 0
            # twice as many as were kept, so that a key whose rows are all needed takes time in proportion
            if len(held[0]) > max(HELD, 2 * kept):
                out, needed = done(held)
                yield from out
                held = [z[needed] for z in held]
                kept = len(held[0])
        if held is not None and len(held[0]):
            yield from done(held)[0]

    def done(z):
        key, ids, place = z[0].view(np.uint64), z[1], z[2:]
        i, j, needed = link(key, ids, place[3], min_words)
        return [_links_only(_linked(key, ids, place, i, j, min_words))], needed

    def _links_only(b):
        l, c, r = (pa.array(z, pa.int32()) for z in _unpacked(b))
        return pa.RecordBatch.from_arrays([b.column(1), l, c, r, *(b.column(k) for k in (6, 7, 8, 9))], names=["doc_id", "l", "c", "r", "p", "pl", "pc", "pr"])

    return rows.mapInArrow(meet, "doc_id long, l int, c int, r int, p long, pl int, pc int, pr int").where("doc_id > p")


def stretches(pair: np.ndarray, own: list[np.ndarray], other: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """pair, start, end, partner start, partner end where links (own and other: l, c, r) of one pair overlap or nearly do, on about one diagonal."""
    none = np.zeros(len(pair), np.int64)
    pair, _, start, end, at = merged(pair, none, own, other)
    if not len(pair):
        return pair, start, end, at, at
    off = at - start
    # passages of one pair can lie on several diagonals; merged leaves them in order
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (off[1:] - off[:-1] > MARGIN)
    group, head = np.cumsum(new) - 1, np.flatnonzero(new)
    low, high = np.minimum.reduceat(off, head), np.maximum.reduceat(off, head)
    order = np.lexsort((start, group))
    pair, start, end, group = (z[order] for z in (pair, start, end, group))
    run = (group + 1) << 32
    far = np.maximum.accumulate(run | end) - run
    new[1:] = (group[1:] != group[:-1]) | (start[1:] > far[:-1] + MARGIN)
    head = np.flatnonzero(new)
    a, b, g = start[head], far[np.append(head[1:], len(far)) - 1], group[head]
    return pair[head], np.maximum(0, a - MARGIN), b + MARGIN, np.maximum(0, a + low[g] - MARGIN), b + high[g] + MARGIN


def verify(a: str, b: str, min_words: int, least: float) -> list[tuple[int, int, int, int, int, float]]:
    """(start, end, partner start, partner end, words, similarity) of the passages that a and b share; characters, in a's order."""
    return next(verify_all([(a, b)], min_words, least))


def verify_all(pairs: list[tuple[str, str]], min_words: int, least: float) -> Iterator[list[tuple[int, int, int, int, int, float]]]:
    """``verify`` of each pair, with one pass over all their texts; of a pair of equal texts only one is read."""
    texts, at_text = [], []
    for a, b in pairs:
        at_text.append((len(texts), len(texts) + (a != b)))
        texts += [a] if a == b else [a, b]
    start, end, doc, _, token, at = tokens_of(texts)
    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    # numbers for shingles, 0 for none: what one pair asks of sets is then looked up, not sorted
    number = np.unique(np.append(token, np.uint64(0)), return_inverse=True)[1][:-1]
    notes = np.zeros((3, int(number.max(initial=0)) + 1), np.int64), np.zeros(int(number.max(initial=0)) + 1, bool)
    for i, j in at_text:
        p, q = slice(edge[i], edge[i + 1]), slice(edge[j], edge[j + 1])
        yield _shared(number[p], start[p] - at[i], end[p] - at[i], number[q], start[q] - at[j], end[q] - at[j], min_words, least, notes)


def _middle(u: np.ndarray) -> int:
    """The median, towards zero."""
    if u[0] == u[-1] and (u == u[0]).all():
        return int(u[0])
    k = len(u) // 2
    if len(u) % 2:
        return int(np.partition(u, k)[k])
    u = np.partition(u, (k - 1, k))
    return int((int(u[k - 1]) + int(u[k])) / 2)


def _distinct(x: np.ndarray, seen: np.ndarray) -> tuple[int, np.ndarray]:
    """How many different numbers, and one place of each."""
    at = np.arange(len(x))
    seen[x] = at
    once = seen[x] == at
    return int(np.count_nonzero(once)), once


def _shared(x, start, end, y, y_start, y_end, min_words: int, least: float, notes) -> list[tuple[int, int, int, int, int, float]]:
    """x and y: numbers of shingles. notes: room for three integers and a flag, unset, for each number."""
    (first, last, seen), flag = notes
    y_at = np.flatnonzero(y)
    if not len(y_at) or not x.any():
        return []
    # of repeated numbers the last one written stays
    first[y[y_at[::-1]]] = y_at[::-1]
    last[y[y_at]] = y_at
    flag[y[y_at]] = True
    hit = np.flatnonzero(flag[x])
    flag[y[y_at]] = False
    out = []

    # the whole candidate first; what is not alike as a whole is split at its widest gap
    left = [hit]
    while left:
        h = left.pop()
        if not len(h) or h[-1] - h[0] + SHINGLE < min_words:
            continue
        own = x[h[0] : h[-1] + 1]
        flag[own] = True
        n_own = _distinct(own, seen)[0]
        lo, hi = first[x[h]] - (h - h[0]), last[x[h]] + (h[-1] - h)
        best = None
        # the diagonal of the whole, or that of each end where words stand between them on one side only
        for u, v in ((lo, hi), (lo[:ENDS], hi[-ENDS:])):
            p, q = max(0, _middle(u)), min(len(y) - 1, _middle(v))
            # the partner's stretch: from the first to the last of its shingles near the diagonal that are shared
            shared = np.flatnonzero(flag[y[p : q + 1]])
            if len(shared):
                p, q = p + int(shared[0]), p + int(shared[-1])
                other = y[p : q + 1]
                n_other, once = _distinct(other, seen)
                both = int(np.count_nonzero(flag[other] & once))
                j = both / (n_own + n_other - both)
                if best is None or j > best[0]:
                    best = j, p, q
            if best and best[0] >= least:
                break
        flag[own] = False
        if best and best[0] >= least:
            j, p, q = best
            out.append((int(start[h[0]]), int(end[h[-1] + SHINGLE - 1]), int(y_start[p]), int(y_end[q + SHINGLE - 1]), int(h[-1] - h[0] + SHINGLE), float(j)))
            continue
        gap = np.diff(h)
        if len(gap) and gap.max() > 1:
            w = int(gap.argmax())
            left += [h[w + 1 :], h[: w + 1]]
    return out


def small(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in copies of few at a time: about ``PIECE_CHARS`` bytes of a column of texts, or as many bytes of a column of lists."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.binary_length(b.column(column)) if pa.types.is_string(b.schema[column].type) else pc.multiply(pc.list_value_length(b.column(column)), 40)
        ends, lo = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE_CHARS, side="right")))
            yield b.take(pa.array(np.arange(lo, hi)))
            lo = hi


def passages(df: DataFrame, *, min_words: int = 50, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated passage: doc_id, start_char, end_char, partner_id, partner_start, partner_end, n_words, similarity."""
    if min_words <= SHINGLE:
        raise ValueError(f"passages have more than {SHINGLE} words")
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    links = passage_links(base, min_words)
    paired = links.groupBy("doc_id", "p").agg(F.collect_list(F.struct("l", "c", "r", "pl", "pc", "pr")).alias("links"))

    def join(batches):
        for b in small(batches, 2):
            lists = b.column(2)
            pair = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            l, c, r, pl, at, pr = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.values.flatten())
            k, s, e, ps, pe = stretches(pair, [l, c, r], [pl, at, pr])
            if len(k):
                yield batch(doc_id=b.column(0).take(pa.array(k)), p=b.column(1).take(pa.array(k)), **{name: pa.array(z, pa.int32()) for name, z in zip(("s", "e", "ps", "pe"), (s, e, ps, pe), strict=True)})

    found = cut(paired.mapInArrow(join, "doc_id long, p long, s int, e int, ps int, pe int"))
    # texts that no candidate needs stay where they are, as long as the list of the others is small
    ids = found.select(F.explode(F.array("doc_id", "p")).alias("doc_id")).distinct()
    if ids.count() <= BROADCAST:
        base = base.join(F.broadcast(ids), "doc_id", "left_semi")
    key = ["doc_id", "p", "s", "e", "ps", "pe"]
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("doc_id").alias("at"), F.col("s").alias("x"), F.col("e").alias("y")), F.struct(F.lit(1).alias("side"), F.col("p").alias("at"), F.col("ps").alias("x"), F.col("pe").alias("y")))
    asked = found.select(*key, F.explode(sides).alias("q")).select(*key, "q.*")
    # one pass over the texts serves both sides; only the stretches travel on
    parts = asked.join(base.withColumnRenamed("doc_id", "at"), "at").select(*key, "side", F.substring(F.col("text"), F.col("x") + 1, F.col("y") - F.col("x")).alias("part"))
    both = parts.repartition(*key).sortWithinPartitions(*key, "side", "part")

    def check(batches):
        def verified():
            held, mine, partner, due, size = None, [], [], [], 0
            for b in small(batches, 7):
                for *k, side, part in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                    if k != held:
                        for x in mine:
                            for y in partner:
                                due.append((held, x, y))
                                size += len(x) + len(y)
                                if size > PIECE_CHARS:
                                    yield from rows_of(due)
                                    due, size = [], 0
                        held, mine, partner = k, [], []
                    to = partner if side else mine
                    if not to or to[-1] != part:
                        to.append(part)
            yield from rows_of(due + [(held, x, y) for x in mine for y in partner])

        def rows_of(due):
            for (k, _, _), found in zip(due, verify_all([(x, y) for _, x, y in due], min_words, least), strict=True):
                for v in found:
                    yield k[0], k[2] + v[0], k[2] + v[1], k[1], k[4] + v[2], k[4] + v[3], v[4], v[5]

        rows = verified()
        while c := list(zip(*itertools.islice(rows, 10_000), strict=True)):
            yield batch(doc_id=pa.array(c[0], pa.int64()), start_char=pa.array(c[1], pa.int32()), end_char=pa.array(c[2], pa.int32()), partner_id=pa.array(c[3], pa.int64()), partner_start=pa.array(c[4], pa.int32()), partner_end=pa.array(c[5], pa.int32()), n_words=pa.array(c[6], pa.int32()), similarity=pa.array(c[7], pa.float64()))

    out = both.mapInArrow(check, "doc_id long, start_char int, end_char int, partner_id long, partner_start int, partner_end int, n_words int, similarity double")
    return out.distinct()


def cut_passages(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """docs, with their columns, without the passages; a document of which no word is left goes. Spans of one document are bounded by its own windows."""
    spans = found.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("start_char", "end_char")).alias("__spans"))
    rows = docs.join(spans, docs[id_col].cast("long") == F.col("__id"), "left").drop("__id")
    names = docs.columns
    t = names.index(text_col)
    n = names.index(count_col) if count_col in names else None

    def run(batches):
        for b in batches:
            cols = [b.column(k) for k in range(len(names))]
            keep, given = np.ones(b.num_rows, bool), pc.is_valid(b.column(len(names)))
            # only texts that lose something become Python strings
            at = np.flatnonzero(given.to_numpy(zero_copy_only=False))
            changed: list[str] = []
            for i in at.tolist():
                text, out, end = cols[t][i].as_py(), [], 0
                for s, e in sorted((x["start_char"], x["end_char"]) for x in b.column(len(names))[i].as_py()):
                    if s > end:
                        out.append(text[end:s])
                    end = max(end, e)
                changed.append("".join([*out, text[end:]]))
                keep[i] = any(ch.isalnum() for ch in changed[-1])
            if changed:
                cols[t] = pc.replace_with_mask(cols[t], given, pa.array(changed, cols[t].type))
                if n is not None:
                    cols[n] = pc.replace_with_mask(cols[n], given, pa.array([len(x) for x in changed], cols[n].type))
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    return rows.mapInArrow(run, docs.schema)
