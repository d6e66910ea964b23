"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import random

import corpus_pipeline
from foliospark.llm import near_copies

from .fixtures import awkward, documents, empty, prose


def edited(text, seed, n):
    r = random.Random(seed)
    w = text.split()
    for k in r.sample(range(len(w)), n):
        w[k] = f"edit{r.randrange(999)}"
    return " ".join(w)


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(texts, least=0.8):
    s, root = [sets(t) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if len(s[i] & s[j]) >= least * len(s[i] | s[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(k) for k in range(len(s))]


def test_edited_copies_go(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MEMBERS", 4)  # hot buckets, in pairs of sub-blocks
    monkeypatch.setattr(near_copies, "COLUMNS", 64)
    texts = [prose(k, 130) for k in range(25)]
    texts += [edited(texts[k], 100 + k, 2) for k in range(25)]
    texts += [edited(texts[0], 200 + k, 1 + k % 4) for k in range(40)]  # many of one document, some far apart
    texts += [edited(texts[3], 300 + k, 12) for k in range(5)] + ["few words", "FEW  words", "few other", "", None, " "]
    want = brute(texts)
    assert sum(x != k for k, x in enumerate(want)) > 40 and len(set(want[50:90])) < 40
    got = {r.doc_id: r.component for r in near_copies.near_copies(documents(spark, texts)).collect()}
    groups = lambda of: {frozenset(k for k in range(len(texts)) if of[k] == c) for c in set(of)}
    assert groups([got[k] for k in range(len(texts))]) == groups(want)
    left = corpus_pipeline.one_of_each(spark, documents(spark, texts), "")
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want))


def test_no_links_and_awkward_rows(spark):
    texts = [prose(k, 60) for k in range(5)]
    assert corpus_pipeline.one_of_each(spark, documents(spark, texts), "").count() == 5
    assert corpus_pipeline.one_of_each(spark, empty(spark), "").count() == 0
    df, _ = awkward(spark)
    kept = corpus_pipeline.one_of_each(spark, df, "")
    assert kept.columns == df.columns
    assert {1, 4, 5, 6, 7, 8} <= {r.doc_id for r in kept.collect()} <= {1, 4, 5, 6, 7, 8, None}
