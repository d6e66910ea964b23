"""Shared helpers of the training-data operators.

Batches are cut into pieces of bounded text (``pieces``) before any numpy work, so a
Python worker's memory follows one piece and not the size of an Arrow batch or partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one numpy pass handles; a single longer text is one piece.
PIECE_CHARS = 300_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pieces(texts: pa.Array | list[str | None], limit: int = PIECE_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) of consecutive runs of about ``limit`` characters; nulls become ''. Of an Arrow column one run at a time becomes Python strings."""
    if isinstance(texts, pa.Array):
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(texts):
            had = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, had + limit, side="right")))
            yield lo, hi, [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
            lo = hi
        return
    lo, held, out = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if out and held + len(t) > limit:
            yield lo, i, out
            lo, held, out = i, 0, []
        out.append(t)
        held += len(t)
    if out:
        yield lo, len(texts), out


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


def batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], names=list(cols))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64, wrapping."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_P = 0x9E3779B97F4A7C15 | 1
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i mod 2**64 for i < n."""
    if len(_POW[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for k, p in enumerate((_P, pow(_P, -1, 1 << 64))):
                a = np.full(size, np.uint64(p))
                a[0] = 1
                _POW[k] = np.multiply.accumulate(a)
    return _POW[0][:n], _POW[1][:n]


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for each span, from one running sum."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
        return mix64((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(0x10000, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def codes_of(texts: list[str], sep: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by ``sep``; where each text starts, and the end."""
    codes = np.frombuffer(sep.join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return codes, at


def words_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of other than ASCII white space."""
    space = np.ones(len(codes) + 2, bool)
    space[1:-1] = _SPACE[np.minimum(codes, 0xFFFF)]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        import tempfile

        where = tempfile.mkdtemp(prefix="foliospark-")
    return where


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


def held_out(col: str = "doc_id"):
    """The contract's fold: crc32 of the id as text, remainder 1 of 3."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1
