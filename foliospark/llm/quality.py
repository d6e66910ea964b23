"""Operator 4: quality by compression with zstandard dictionaries.

Two dictionaries are trained, one on blocks of text labelled good, one on bad. A text's blocks
are compressed with each; d = (good size - bad size) / (good size + bad size) is the normalised
difference, over all blocks of the whole text and for its worst block. Text that repeats itself is
tiny under both dictionaries, so the logarithm of its size under neither over the raw size joins, again
for the text and its worst block (under neither, since a text that a dictionary holds is tiny under that). A logistic curve of these four, fitted on labelled rows that no dictionary
saw, gives the probability (Platt's smoothed targets).

Fitting reads a bounded sample: at most ``per_class`` labelled rows of each class, those with the
smallest hashes of their ids (two thirds for the dictionaries, of each at most ``slice_chars`` characters
from a place its hash picks; one third, whole, for the curve). Scoring reads every whole text; its
dictionaries (2 x ``dict_bytes``) are the only thing sent to the executors.

Defined cases: null and empty texts have four zeros; repeated rows score alike; labels that are null or
neither 0 nor 1 are left out, a row labelled both ways counts for both; without rows of both classes
every score is the share of good rows seen (0.5 if there are none); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, held_out, map_arrow, pieces

BLOCK_BYTES = 1024
FEATURES = 4
LEVEL = 3


class Model:
    def __init__(self, good: bytes, bad: bytes, weights: list[float], shift: float):
        self.good, self.bad, self.weights, self.shift = good, bad, weights, shift
        self._packers = None

    def __getstate__(self):
        return self.good, self.bad, self.weights, self.shift

    def __setstate__(self, s):
        self.__init__(*s)

    def features(self, text: str) -> list[float]:
        """d, the worst block's d, log of the size ratio, the worst block's; blocks under 64 bytes join the one before."""
        raw = text.encode("utf-8", "surrogatepass")
        if not raw or not self.good or not self.bad:
            return [0.0] * FEATURES
        if self._packers is None:
            self._packers = [_packer(d) for d in (self.good, self.bad, b"")]
        g, b, plain = self._packers
        x = y = z = k = 0
        worst, least, n = -1.0, 0.0, len(raw)
        while k < n:
            to = n if n - k < BLOCK_BYTES + 64 else k + BLOCK_BYTES
            block = raw[k:to]
            i, j, own = len(g(block)), len(b(block)), len(plain(block))
            worst, least = max(worst, (i - j) / (i + j)), min(least, math.log(own / (to - k + 20)))
            x, y, z, k = x + i, y + j, z + own, to
        return [(x - y) / (x + y), worst, math.log(z / (n + 20)), least]

    def score(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-(f @ np.array(self.weights) + self.shift), -500, 500)))


def _packer(data: bytes):
    import zstandard

    if not data:
        return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False).compress
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress


def _dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary; where training finds too little, the text itself as a raw one."""
    import zstandard

    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    blocks = [r[k : k + BLOCK_BYTES] for r in raw for k in range(0, len(r), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:size]


def logistic(f: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[list[float], float]:
    """weights, shift of P(y = 1), targets smoothed by the class sizes, by damped Newton steps with a small ridge."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, spread = f.mean(0), np.where(f.std(0) > 1e-12, f.std(0), 1.0)
    x = np.column_stack([(f - mean) / spread, np.ones(len(f))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.05] * f.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(-(x @ w), -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (t - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (w[:-1] / spread).tolist(), float(w[-1] - (w[:-1] * mean / spread).sum())


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 2000, slice_chars: int = 4096, dict_bytes: int = 112_640, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", training=None) -> Model:
    """The model, from labelled rows for which ``training`` (a condition on the id; default: all) holds."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if training is not None:
        rows = rows.where(training)
    rows = rows.withColumn("h", F.xxhash64("doc_id"))
    picked = rows.where("y = 0").distinct().orderBy("h").limit(per_class).union(rows.where("y = 1").distinct().orderBy("h").limit(per_class))
    # at most 2 x per_class rows of three numbers
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(picked), "doc_id")
    start = F.pmod(F.shiftright("h", 8), F.greatest(F.length("text") - slice_chars, F.lit(0)) + 1).cast("int") + 1
    sliced = found.where("pmod(h, 3) <> 0").select("y", F.substring(F.col("text"), start, F.lit(slice_chars)).alias("text"), "h").orderBy("h").limit(2 * per_class).collect()
    model = Model(b"", b"", [0.0] * FEATURES, 0.0)
    seen = {y: [r["text"] for r in sliced if r["y"] == y and r["text"]] for y in (0, 1)}
    if not seen[0] or not seen[1]:
        n = rows.groupBy("y").count().collect()
        n = {r["y"]: r["count"] for r in n}
        share = n.get(1, 0) / max(1, sum(n.values())) if n else 0.5
        model.shift = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return model
    model.good, model.bad = _dictionary(seen[1], dict_bytes), _dictionary(seen[0], dict_bytes)

    def run(b):
        f = pa.array([model.features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
        yield batch(y=b.column(0), f=f)

    held = sorted((r["y"], *r["f"]) for r in map_arrow(found.where("pmod(h, 3) = 0").select("y", "text"), run, "y int, f array<double>").collect())
    y, f = np.array([r[0] for r in held]), np.array([r[1:] for r in held])
    model.weights, model.shift = logistic(f, y) if len(set(y.tolist())) == 2 else ([-60.0, 0.0, 0.0, 0.0], 0.0)
    return model


def _features(model: Model, texts: pa.Array) -> np.ndarray:
    return np.array([model.features(t) for _, _, part in pieces(texts) for t in part], np.float64)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out (the contract's fold), score in [0, 1], predicted, difference (d) of every text."""

    def run(b):
        f = _features(model, b.column(1))
        s = model.score(f)
        yield batch(doc_id=b.column(0), held_out=b.column(2), score=pa.array(s), predicted=pa.array((s >= 0.5).astype(np.int32)), difference=pa.array(f[:, 0]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int, difference double")


def keep_good(docs: DataFrame, model: Model, *, below: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, whose score is not under ``below``."""
    text_at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(model.score(_features(model, b.column(text_at))) >= below))

    return docs.mapInArrow(run, docs.schema)
