"""Operator 3: spans, and a held-out part of invented languages."""

import itertools
import random

import numpy as np
from foliospark.llm import langid

from .fixtures import awkward, documents, empty

SYLLABLES = {"aa": "ba be bi bo bu".split(), "bb": "zka zke zko zki".split(), "ru": "да не мо ле".split()}


def text(lang, seed, n=40):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def rows(spark):
    data = [(k * 10 + j, text(lang, k), lang) for k in range(30) for j, lang in enumerate(SYLLABLES)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string")


def test_held_out_and_spans(spark):
    df = rows(spark)
    model = langid.fit(df.where("doc_id < 200"))
    got = langid.identify(df.where("doc_id >= 200"), model).collect()
    want = {r.doc_id: r.lang for r in df.collect()}
    assert all(r.lang_pred == want[r.doc_id] and r.score == 1.0 for r in got)
    mixed = text("aa", 99, 30) + " " + text("bb", 99, 30) + " " + text("ru", 99, 30)
    r = langid.identify(documents(spark, [mixed]), model).first()
    assert [s.lang for s in r.spans] == ["aa", "bb", "ru"]
    assert mixed[r.spans[1].start : r.spans[1].end] == text("bb", 99, 30)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 7):
        s = rng.normal(size=(n, 3)).astype(np.float32) * 3
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p)))
        assert tuple(langid.viterbi(s, np.array([n]), 2.0)) == best
    s = rng.normal(size=(500, 4)).astype(np.float32)  # many segments, several texts at once
    count = np.array([3, 300, 1, 196])
    got, at = langid.viterbi(s, count, 1.5), 0
    for c in count:
        assert list(got[at : at + c]) == _plain(s[at : at + c], 1.5)
        at += c


def _plain(s, penalty):
    v, back = s[0].astype(np.float64), []
    for row in s[1:]:
        go = v[None, :] - penalty * (1 - np.eye(len(v)))
        back.append(go.argmax(1))
        v = go.max(1) + row
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_awkward_rows(spark):
    model = langid.fit(rows(spark))
    df, all_rows = awkward(spark)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert len(got) == len({i for i, _ in all_rows})
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1, 2, 3))
    assert langid.identify(empty(spark), model).count() == 0
    assert langid.identify(df, langid.fit(empty(spark))).where("lang_pred <> 'und'").count() == 0
