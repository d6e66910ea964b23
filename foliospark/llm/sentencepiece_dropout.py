"""Operator 1: SentencePiece encoding and decoding with seeded merge-dropout.

Every candidate merge that an agenda pops is skipped if the keyed hash of (seed, document,
the borders of its two symbols) falls under the dropout; a skipped candidate stays out
unless a neighbour's merge makes a new pair. The same seed and document give the same
tokens on any partitioning, another seed gives another segmentation, and every one decodes
to the text. Dropout 0 gives the library's own tokens. One deviation: a literal U+2581 in
the text is kept apart from a space, as byte pieces, since the library's decoding would
turn it into a space.

Map only: no shuffle, and a worker holds one piece of text at a time.

Defined cases: a null or empty text has no tokens and decodes to ''. A null id is hashed as
-1. Repeated rows with one id and text get the same tokens. Other columns are ignored, so
clashing names do not matter; an empty table gives an empty result. Texts are processed
whole at any length (a single word above 63 characters runs its agenda on a heap).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import batch, map_arrow, mix64, pieces

PIECE_CHARS = 500_000


def encode_texts(p: bpe.Pieces, texts: list[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """All token ids, and where each text's tokens start (and the last end). keys: each text's hash key (uint64)."""
    body = [" " + t if t else "" for t in texts]
    codes = np.frombuffer("".join(body).encode("utf-32-le", "surrogatepass"), np.uint32)
    last = np.cumsum(np.array([len(b) for b in body], np.int64))
    first = last - np.array([len(b) for b in body], np.int64)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    sym = p.char_lossless[codes]
    start, end = bpe.words(codes, first, last)
    doc = np.searchsorted(last, start, side="right")
    merged = bpe.merge_all(p, sym, start, end, keys[doc], start - first[doc], dropout)
    ids, place = bpe.tokens(p, codes, merged)
    at = np.zeros(len(texts) + 1, np.int64)
    at[1:] = np.searchsorted(place, last, side="left")
    return ids, at


def decode_ids(p: bpe.Pieces, ids: np.ndarray, at: np.ndarray) -> list[str]:
    """The texts of token runs ids[at[i]:at[i + 1]]; the first space of each is the encoder's own."""
    n = p.text_at[ids + 1] - p.text_at[ids]
    end = np.cumsum(n)
    pick = np.arange(end[-1] if len(end) else 0, dtype=np.int64)
    raw = p.text_all[pick + np.repeat(p.text_at[ids] - (end - n), n)].tobytes()
    cut = np.append(0, end)[at]
    return [raw[a:b].decode("utf-8", "replace")[1:] if b > a else "" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def text_keys(seed: int, ids: pa.Array) -> np.ndarray:
    """Each document's hash key."""
    x = ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64)
    return mix64(mix64(x + np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(xxhash.xxh64_intdigest(str(seed).encode(), 0)))


def encode(df: DataFrame, *, model: str | None = None, dropout: float = 0.1, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: id, n_chars, n_tokens, the tokens' xxh64, lossless (decoding gave the text back), and the ids themselves if ``keep_ids``."""
    path = model or bpe.default_model()
    bpe.threshold(dropout)

    def run(b):
        p = bpe.load(path)
        keys = text_keys(seed, b.column(0))
        for lo, hi, part in pieces(b.column(1), PIECE_CHARS):
            ids, at = encode_texts(p, part, keys[lo:hi], dropout)
            back = decode_ids(p, ids, at)
            cols = {
                "doc_id": b.column(0).slice(lo, hi - lo).cast(pa.int64()),
                "n_chars": pa.array([len(t) for t in part], pa.int64()),
                "n_tokens": pa.array(np.diff(at), pa.int64()),
                "ids_xxh64": pa.array([xxhash.xxh64_hexdigest(ids[x:y].tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)], pa.string()),
                "lossless": pa.array([x == y for x, y in zip(part, back, strict=True)], pa.bool_()),
            }
            if keep_ids:
                cols["token_ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield batch(**cols)

    schema = "doc_id long, n_chars long, n_tokens long, ids_xxh64 string, lossless boolean" + ", token_ids array<int>" * keep_ids
    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)


def decode(df: DataFrame, *, model: str | None = None, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and text of each row of token ids; null or no ids: ''."""
    path = model or bpe.default_model()

    def run(b):
        p = bpe.load(path)
        col = b.column(1)
        at = np.zeros(len(col) + 1, np.int64)
        rows = [x or [] for x in col.to_pylist()]
        np.cumsum([len(x) for x in rows], out=at[1:])
        ids = np.array([y for x in rows for y in x], np.int64)
        yield batch(doc_id=b.column(0), text=pa.array(decode_ids(p, ids, at), pa.string()))

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), run, "doc_id long, text string")
