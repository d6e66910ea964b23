"""Operator 3: language identification of mixed-language text.

Per word, script ranges narrow the candidate languages; the rest score by character trigrams
(one per letter, with its neighbours, hashed into ``BINS``). A Viterbi pass over a text's words,
with a penalty for each switch of language, labels spans. The pass runs over many texts at once:
runs of ``SEGMENT`` words become (max, +) matrices, which are chained per text, and all segments are
then traced back together; so a long text costs few steps.

Fitting counts trigrams over a bounded sample: at most about ``per_lang`` texts of each language,
by the hash of their ids. Counts are summed in the executors; the driver holds BINS numbers per
language. Prediction reads every whole text, map only.

Defined cases: null text or one without a letter: 'und', score 0; ties go to the first language in
alphabetical order; without a training row every text is 'und'; repeated rows predict alike; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, codes_of, held_out, map_arrow, pieces, words_of

BINS = 1 << 16
SEGMENT = 32
#: First code points of script ranges and their scripts; what lies between is of the range before it.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"),
    (0x2C80, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
)
NAMES = sorted({n for _, n in SCRIPTS})


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: lower case (where that is one character), whether it is a letter, its script."""
    lower, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in range(0x20000):
        s = chr(c)
        if s.isalpha():
            letter[c] = True
            if len(low := s.lower()) == 1:
                lower[c] = ord(low)
    letter[0x20000:0x323B0] = True
    script = np.zeros(0x110000, np.int8)
    for k, (at, name) in enumerate(SCRIPTS):
        script[at : SCRIPTS[k + 1][0] if k + 1 < len(SCRIPTS) else 0x110000] = NAMES.index(name)
    return lower, letter, script


def bins_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bin of each place, and whether a letter stands there."""
    lower, letter, _ = tables()
    is_letter = letter[codes]
    low = np.where(is_letter, lower[codes], np.uint32(32))
    a, b = np.full(len(low) + 2, 32, np.uint32), None
    a[1:-1] = low
    with np.errstate(over="ignore"):
        b = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)
        b ^= b >> np.uint32(15)
        b *= np.uint32(0x2C1B3C6D)
    return (b >> np.uint32(16)).astype(np.int64), is_letter


class Model:
    def __init__(self, langs: list[str], logp: np.ndarray, scripts: np.ndarray, penalty: float):
        """logp: [BINS, langs]; scripts: [scripts, langs], whether the language is written so."""
        self.langs, self.logp, self.scripts, self.penalty = langs, logp, scripts, penalty


def word_scores(m: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end, letters, [words, langs] scores of the words that have a letter."""
    bins, is_letter = bins_of(codes)
    start, end = words_of(codes)
    run = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(is_letter, out=run[1:])
    letters = run[end] - run[start]
    some = letters > 0
    start, end, letters = start[some], end[some], letters[some]
    if not len(start):
        return start, end, letters, np.zeros((0, len(m.langs)), np.float32)
    at = np.flatnonzero(is_letter)
    first = run[start]
    scores = np.add.reduceat(m.logp[bins[at]], first, axis=0)
    # letters outside these words do not exist: every letter is in one
    script = np.maximum.reduceat(tables()[2][codes[at]], first)
    allowed = m.scripts[script]
    scores = np.where(allowed | ~allowed.any(1, keepdims=True), scores, scores - 1e4)
    return start, end, letters, scores.astype(np.float32)


def viterbi(scores: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Best state of each row; rows belong to consecutive texts of count[i] rows (each at least 1)."""
    n, k = scores.shape
    if k == 1 or not n:
        return np.zeros(n, np.int64)
    seg = -(-count // SEGMENT)
    first_seg = np.cumsum(seg) - seg
    first_row = np.cumsum(count) - count
    text = np.repeat(np.arange(len(count)), count)
    inside = np.arange(n) - first_row[text]
    g, t = first_seg[text] + inside // SEGMENT, inside % SEGMENT
    s = np.zeros((SEGMENT, int(seg.sum()), k), np.float32)
    s[t, g] = scores
    # best score into each state from each state, over a segment
    a = np.full((s.shape[1], k, k), -1e9, np.float32)
    a[:, np.arange(k), np.arange(k)] = 0
    for row in s:
        a = np.maximum(a, a.max(2, keepdims=True) - penalty) + row[:, None, :]
    order = np.argsort(-seg, kind="stable")
    enter = np.zeros((s.shape[1], k), np.float32)
    v = np.zeros((len(count), k), np.float32)
    longest = seg[order]
    for r in range(int(longest[0])):
        on = order[: np.searchsorted(-longest, -r, side="left")]
        at = first_seg[on] + r
        enter[at] = v[on]
        out = (v[on][:, :, None] + a[at]).max(1)
        v[on] = out - out.max(1, keepdims=True)
    back = np.zeros(s.shape, np.int8)
    w = enter
    for r, row in enumerate(s):
        top = w.argmax(1)
        best = w.max(1, keepdims=True) - penalty
        stay = w >= best
        back[r] = np.where(stay, np.arange(k), top[:, None])
        w = np.where(stay, w, best) + row
    path = np.zeros(s.shape, np.int8)
    cur = np.broadcast_to(np.arange(k, dtype=np.int8), w.shape).copy()
    for r in range(SEGMENT - 1, -1, -1):
        path[r] = cur
        cur = np.take_along_axis(back[r], cur.astype(np.int64), 1)
    state = np.zeros(s.shape[1], np.int64)
    e = v.argmax(1)
    for r in range(int(longest[0]) - 1, -1, -1):
        on = order[: np.searchsorted(-longest, -r, side="left")]
        at = first_seg[on] + r
        state[at] = e[on]
        e[on] = cur[at, e[on]]
    return path[t, g, state[g]].astype(np.int64)


def label_texts(m: Model, texts: list[str]):
    """Per text: index of the language or -1, score; and the spans as (text, start, end, language) arrays."""
    codes, at = codes_of(texts)
    lang, score = np.full(len(texts), -1, np.int64), np.zeros(len(texts))
    none = np.zeros(0, np.int64)
    if not m.langs:
        return lang, score, (none, none, none, none)
    start, end, letters, scores = word_scores(m, codes)
    text = np.searchsorted(at, start, side="right") - 1
    have, count = np.unique(text, return_counts=True)
    if not len(have):
        return lang, score, (none, none, none, none)
    state = viterbi(scores, count, m.penalty)
    share = np.zeros((len(texts), len(m.langs)))
    np.add.at(share, (text, state), letters)
    lang[have] = share[have].argmax(1)
    score[have] = share[have].max(1) / share[have].sum(1)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (state[1:] != state[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(text)) - 1
    return lang, score, (text[lo], start[lo] - at[text[lo]], end[hi] - at[text[lo]], state[lo])


def fit(df: DataFrame, *, per_lang: int = 3000, penalty: float = 12.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", training=None) -> Model:
    """The model, from rows with a language for which ``training`` (a condition; default: all) holds."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    if training is not None:
        rows = rows.where(training)
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(size)
    if not langs:
        return Model([], np.zeros((BINS, 0), np.float32), np.zeros((len(NAMES), 0), bool), penalty)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_lang / size[k])))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")

    def run(b):
        names = b.column(0).to_pylist()
        for lang in sorted(set(names)):
            c, s = np.zeros(BINS, np.int64), np.zeros(len(NAMES), np.int64)
            for _, _, part in pieces([t for k, t in zip(names, b.column(1).to_pylist(), strict=True) if k == lang]):
                codes, _ = codes_of(part)
                bins, is_letter = bins_of(codes)
                c += np.bincount(bins[is_letter], minlength=BINS)
                s += np.bincount(tables()[2][codes[is_letter]], minlength=len(NAMES))
            some = np.flatnonzero(c)
            key = np.concatenate([some, BINS + np.flatnonzero(s)])
            yield batch(lang=pa.array([lang] * len(key)), bin=pa.array(key), n=pa.array(np.concatenate([c[some], s[s > 0]])))

    counts = np.zeros((BINS + len(NAMES), len(langs)))
    for r in map_arrow(sample, run, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["bin"], langs.index(r["lang"])] = r["n"]
    grams, scripts = counts[:BINS] + 0.5, counts[BINS:]
    logp = np.log(grams / grams.sum(0))
    return Model(langs, (logp - logp.max(1, keepdims=True)).astype(np.float32), scripts >= np.maximum(1, 0.001 * scripts.sum(0)), penalty)


def identify(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """doc_id, held_out (the contract's fold), lang_pred, score (share of letters so labelled), n_spans, and the spans as (start, end, lang) in characters."""

    def run(b):
        for lo, hi, part in pieces(b.column(1)):
            lang, score, (text, start, end, state) = label_texts(model, part)
            n = np.bincount(text, minlength=len(part))
            cols = {"doc_id": b.column(0).slice(lo, hi - lo), "held_out": b.column(2).slice(lo, hi - lo), "lang_pred": pa.array(["und" if k < 0 else model.langs[k] for k in lang], pa.string()), "score": pa.array(score), "n_spans": pa.array(n, pa.int32())}
            if spans:
                cols["spans"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array([model.langs[k] for k in state], pa.string())], ["start", "end", "lang"]))
            yield batch(**cols)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, n_spans int" + ", spans array<struct<start: int, end: int, lang: string>>" * spans)
