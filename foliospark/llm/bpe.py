"""Merge-type segmentation over a SentencePiece BPE model, for many words at once.

The agenda of a word holds its adjacent symbol pairs whose concatenation is a piece, best
score first and leftmost first among equals. No piece has U+2581 after another character
(checked on load), so no merge crosses the border between a character and a following
U+2581: text falls apart into words there, and the agendas of all words advance together in
numpy, one pop each per round. Very long words run the same agenda on a heap.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np

from .common import mix64

SPACE = "▁"
NONE = np.int32(2**31 - 1)
UNKNOWN, DEAD = -1, -2
BUCKETS = (4, 8, 16, 32, 63)
#: Words of one numpy pass.
CHUNK = 50_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if not b[i - 1] & 128:
            return out, i


class Pieces:
    """Vocabulary, merge table and byte pieces of a .model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.full(256, UNKNOWN, np.int32)
        ids = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[p] = i
        if n >= 1 << 15 or (self.byte_id < 0).any():
            raise ValueError("a BPE model with byte fallback and fewer than 32,768 pieces is needed")
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece has U+2581 after another character: words are not independent")
        self.ids = ids
        # equal scores share a rank, and the leftmost of them goes first
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in ids.values()}, reverse=True))}
        self.rank = np.full(n, NONE, np.int32)
        self.by_rank = np.full(len(order), UNKNOWN, np.int32)
        shared = np.zeros(len(order), np.int64)
        for p, i in ids.items():
            self.rank[i] = k = order[sp.get_score(i)]
            self.by_rank[k] = i
            shared[k] += len(p) > 1
        self.by_rank[shared > 1] = UNKNOWN
        self.char = np.full(0x110000, UNKNOWN, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[32] = self.char[ord(SPACE)]
        # lossless text keeps a literal U+2581 apart from a space, by byte pieces
        self.char_lossless = self.char.copy()
        self.char_lossless[ord(SPACE)] = UNKNOWN
        self.merge = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    self.merge[ids[p[:k]], ids[p[k:]]] = i
        size = 1 << max(10, (4 * len(self.merge)).bit_length())
        self.bits = np.uint32(32 - (size.bit_length() - 1))
        self.key, self.val, self.made = np.full(size + 64, 0xFFFFFFFF, np.uint32), np.full(size + 64, NONE, np.int32), np.full(size + 64, UNKNOWN, np.int32)
        for (a, b), i in self.merge.items():
            k = a << 16 | b
            h = ((k * 2654435761) & 0xFFFFFFFF) >> int(self.bits)
            while self.key[h] != 0xFFFFFFFF:
                h += 1
            self.key[h], self.val[h], self.made[h] = k, self.rank[i], i
        self.text = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_id):
            self.text[i] = bytes([b])
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i):
                self.text[i] = b""
        self.text_at = np.zeros(n + 1, np.int64)
        np.cumsum([len(t) for t in self.text], out=self.text_at[1:])
        self.text_all = np.frombuffer(b"".join(self.text), np.uint8)

    def pair(self, a: np.ndarray, b: np.ndarray, piece: bool = False) -> np.ndarray:
        """Rank of the piece that a and b make, or NONE; with ``piece`` its id."""
        val = self.made if piece else self.val
        key = (a.astype(np.uint32) << np.uint32(16)) | (b.astype(np.uint32) & np.uint32(0xFFFF))
        with np.errstate(over="ignore"):
            h = ((key * np.uint32(2654435761)) >> self.bits).astype(np.int64)
        got = self.key[h]
        out = np.where(got == key, val[h], NONE)
        wait = np.flatnonzero((got != key) & (got != 0xFFFFFFFF))
        while len(wait):
            h[wait] += 1
            got = self.key[h[wait]]
            hit = got == key[wait]
            out[wait[hit]] = val[h[wait[hit]]]
            wait = wait[~hit & (got != 0xFFFFFFFF)]
        out[(a < 0) | (b < 0)] = NONE
        return out


@functools.lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    return Pieces(path)


def skips(base: np.ndarray, left: np.ndarray, mid: np.ndarray, end: np.ndarray, below: np.uint64) -> np.ndarray:
    """Whether the keyed hash of a candidate merge (its text's key, its three borders) is under the dropout."""
    with np.errstate(over="ignore"):
        k = base + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mid.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + end.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    return mix64(mix64(k)) < below


def threshold(dropout: float) -> np.uint64 | None:
    """None: no merge is dropped."""
    if not 0 <= dropout <= 1:
        raise ValueError("dropout lies between 0 and 1")
    return None if dropout <= 0 else np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))


def words(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the words in texts codes[first[i]:last[i]] (which lie one after the other), as U+2581* other*."""
    space = (codes == 32) | (codes == 0x2581)
    begin = np.zeros(len(codes), bool)
    begin[1:] = space[1:] & ~space[:-1]
    begin[first[first < last]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(codes))
    return start, end


def agenda_heap(p: Pieces, sym: list[int], base: int, left: int, below) -> list[int]:
    """The agenda of one word on a heap; sym as changed: DEAD where a symbol was merged into one before it."""
    n = len(sym)
    ids, nxt, prv, size = list(sym), list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    heap = []

    def add(i: int, j: int) -> None:
        if i >= 0 and j < n and (m := p.merge.get((ids[i], ids[j]))) is not None:
            heapq.heappush(heap, (int(p.rank[m]), i, j, size[i], size[j]))

    for i in range(n - 1):
        add(i, i + 1)
    while heap:
        rank, i, j, a, b = heapq.heappop(heap)
        if ids[i] == DEAD or ids[j] == DEAD or size[i] != a or size[j] != b:
            continue
        if below is not None and skips(np.array([base], np.uint64), *(np.array([left + x]) for x in (i, j, j + b)), below)[0]:
            continue
        ids[i], ids[j] = p.merge[ids[i], ids[j]], DEAD
        size[i] += b
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        add(prv[i], i)
        add(i, nxt[i])
    return ids


def merge_all(p: Pieces, sym: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.ndarray, left: np.ndarray, dropout: float) -> np.ndarray:
    """sym after all agendas: a piece, UNKNOWN or DEAD (merged into an earlier symbol) at each place.

    base: each word's hash key; left: each word's place in its text."""
    out, below, n = sym.copy(), threshold(dropout), end - start
    low = 1
    for high in BUCKETS:
        pick = np.flatnonzero((n > low) & (n <= high))
        low = high
        for k in range(0, len(pick), CHUNK):
            _bucket(p, out, start, n, base, left, below, pick[k : k + CHUNK], high)
    for w in np.flatnonzero(n > low):
        out[start[w] : end[w]] = agenda_heap(p, sym[start[w] : end[w]].tolist(), int(base[w]), int(left[w]), below)
    return out


def _bucket(p, out, start, n, base, left, below, pick, width):
    at, size = start[pick], n[pick]
    col = np.arange(width)[:, None]
    inside = col < size
    ids = np.where(inside, out[np.minimum(at + col, len(out) - 1)], UNKNOWN)
    score = np.full((width, len(pick)), NONE, np.int32)
    for j in range(width - 1):
        r = p.pair(ids[j], ids[j + 1])
        score[j] = np.where(r == NONE, NONE, r * 64 + j)
    nxt = np.broadcast_to((col + 1).astype(np.int8), ids.shape).copy()
    prv = np.broadcast_to((col - 1).astype(np.int8), ids.shape).copy()
    base, left = base[pick], left[pick].astype(np.int64)

    def save(which):
        for j in range(width):
            w = which[size[which] > j]
            out[at[w] + j] = ids[j, w]

    while True:
        best = score.min(axis=0)
        act = np.flatnonzero(best != NONE)
        if len(act) < 0.7 * len(best):
            save(np.flatnonzero(best == NONE))
            if not len(act):
                return
            ids, score, nxt, prv = ids[:, act], score[:, act], nxt[:, act], prv[:, act]
            at, size, base, left, best = at[act], size[act], base[act], left[act], best[act]
            act = np.arange(len(act))
        b = best[act]
        j = b & 63
        k = nxt[j, act].astype(np.int64)
        m = nxt[k, act].astype(np.int64)
        if below is not None:
            drop = skips(base[act], left[act] + j, left[act] + k, left[act] + m, below)
            score[j[drop], act[drop]] = NONE
            keep = ~drop
            act, b, j, k, m = act[keep], b[keep], j[keep], k[keep], m[keep]
            if not len(act):
                continue
        new = p.by_rank[b >> 6]
        if (same := new == UNKNOWN).any():
            new[same] = p.pair(ids[j[same], act[same]], ids[k[same], act[same]], piece=True)
        ids[j, act] = new
        ids[k, act] = DEAD
        score[k, act] = NONE
        nxt[j, act] = m
        has = m < size[act]
        mm = np.where(has, m, 0)
        prv[mm[has], act[has]] = j[has]
        r = p.pair(new, np.where(has, ids[mm, act], UNKNOWN))
        score[j, act] = np.where(r == NONE, NONE, r * 64 + j)
        i = prv[j, act].astype(np.int64)
        has = i >= 0
        ii = i[has]
        r = p.pair(ids[ii, act[has]], new[has])
        score[ii, act[has]] = np.where(r == NONE, NONE, r * 64 + ii)


def utf8_size(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


def tokens(p: Pieces, codes: np.ndarray, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids, unknown characters as byte pieces, and each token's place among the codes."""
    live = np.flatnonzero(merged != DEAD)
    ids, n = merged[live], np.ones(len(live), np.int64)
    unknown = np.flatnonzero(ids == UNKNOWN)
    if not len(unknown):
        return ids, live
    n[unknown] = utf8_size(codes[live[unknown]])
    at = np.cumsum(n) - n
    out = np.repeat(ids, n)
    raw = np.frombuffer(codes[live[unknown]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    out[out == UNKNOWN] = p.byte_id[raw]
    return out, np.repeat(live, n)
