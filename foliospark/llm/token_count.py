"""Operator 7: token counts with a whole-token shortcut.

Offline, every vocabulary string that can be a whole pre-token (U+2581* then other
characters) is segmented; those that end as one token are proven. A pre-token equal to a
proven string counts one without any merging. Of the rest, each distinct pre-token of a
piece of text is merged once (the agenda of ``bpe``) and its count is used for all copies.
Pre-tokens never merge across their borders, so the sum is the library's count.

Map only: no shuffle. Defined cases: null or empty text counts 0 tokens and 0 bytes, a
literal U+2581 counts as the library counts it (as a space), special strings are ordinary
text, repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import batch, map_arrow, pieces, span_hashes

PIECE_CHARS = 500_000


@functools.lru_cache(maxsize=4)
def proven(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (sorted) of the proven strings, their lengths, their characters (padded)."""
    p = bpe.load(path)
    texts = [t for t in p.ids if len(t) > 1]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    whole = np.zeros(len(texts), bool)
    merged = bpe.merge_all(p, p.char[codes], start, end, np.zeros(len(texts), np.uint64), start * 0, 0.0)
    one = np.add.reduceat((merged != bpe.DEAD).astype(np.int64), start) == 1
    whole[one & (merged[start] == np.array([p.ids[t] for t in texts]))] = True
    keep = np.flatnonzero(whole)
    h = span_hashes(codes, start, end)[keep]
    order = keep[np.argsort(h)]
    size = (end - start)[order]
    chars = np.zeros((len(order), int(size.max())), np.uint32)
    for j in range(chars.shape[1]):
        has = size > j
        chars[has, j] = codes[start[order[has]] + j]
    return np.sort(h), size, chars


def count_texts(p: bpe.Pieces, known, texts: list[str]) -> np.ndarray:
    body = [" " + t if t else "" for t in texts]
    codes = np.frombuffer("".join(body).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    last = np.cumsum(np.array([len(b) for b in body], np.int64))
    out = np.zeros(len(texts), np.int64)
    if not len(codes):
        return out
    codes[codes == 32] = 0x2581
    start, end = bpe.words(codes, last - np.array([len(b) for b in body]), last)
    h = span_hashes(codes, start, end)
    n = np.ones(len(start), np.int64)
    hashes, size, chars = known
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    hit = (hashes[at] == h) & (size[at] == end - start)
    for j in range(chars.shape[1]):  # the hash only nominates
        look = np.flatnonzero(hit & (size[at] > j))
        hit[look[chars[at[look], j] != codes[start[look] + j]]] = False
    rest = np.flatnonzero(~hit)
    if len(rest):
        _, first, back = np.unique(h[rest], return_index=True, return_inverse=True)
        one = rest[first]
        # copies must equal the word that is merged for them; a hash that two words share is merged for each
        same = (end - start)[one][back] == (end - start)[rest]
        for j in range(int((end - start)[rest].max())):
            look = np.flatnonzero(same & ((end - start)[rest] > j))
            if not len(look):
                break
            same[look[codes[start[rest[look]] + j] != codes[start[one[back[look]]] + j]]] = False
        odd = rest[~same]
        n[rest] = _merged(p, codes, start[one], end[one])[back]
        if len(odd):
            n[odd] = _merged(p, codes, start[odd], end[odd])
    doc = np.searchsorted(last, start, side="right")
    np.add.at(out, doc, n)
    return out


def _merged(p: bpe.Pieces, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tokens of each word, by merging."""
    size = end - start
    to = np.cumsum(size)
    own = codes[np.arange(to[-1]) + np.repeat(start - (to - size), size)]
    merged = bpe.merge_all(p, p.char[own], to - size, to, np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64), 0.0)
    each = np.where(merged == bpe.DEAD, 0, np.where(merged == bpe.UNKNOWN, bpe.utf8_size(own), 1))
    return np.add.reduceat(each, to - size)


def token_counts(df: DataFrame, *, model: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text."""
    path = model or bpe.default_model()

    # proven once, here; two megabytes at most for 32,768 strings
    proof = df.sparkSession.sparkContext.broadcast(proven(path))

    def run(b):
        p, known = bpe.load(path), proof.value
        for lo, hi, part in pieces(b.column(1), PIECE_CHARS):
            n = count_texts(p, known, part)
            yield batch(doc_id=b.column(0).slice(lo, hi - lo), n_bytes=pa.array([len(t.encode("utf-8", "surrogatepass")) for t in part], pa.int64()), n_tokens=pa.array(n, pa.int64()), over_limit=pa.array(n > limit))

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
