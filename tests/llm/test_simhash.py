"""Operator 5 against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from foliospark.llm import graph, simhash

from .fixtures import awkward, documents, empty, prose


def brute_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << p for p in range(64) if h and 2 * sum(x >> p & 1 for x in h) > len(h))


def brute_components(fps):
    """{doc: smallest reachable doc}"""
    root = {d: d for d in fps}
    ids = sorted(fps)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(fps[a] ^ fps[b]).count("1") <= 2 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_documents_against_all_pairs(spark):
    r = random.Random(3)
    texts = [prose(k, 60) for k in range(30)]
    for k in range(40):  # near copies in chains
        w = r.choice(texts).split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += texts[:10] + [None, "", "One", "ONE", "one two", "É é x y"]
    got = {x.doc_id: x for x in simhash.near_duplicates(documents(spark, texts)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: x.fingerprint for i, x in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: x.component_id for i, x in got.items()} == brute_components(fps)


@pytest.mark.parametrize("block", [4, 512])
def test_links_of_hot_buckets(spark, block):
    rng = np.random.default_rng(block)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = set()
    for b in base:
        for _ in range(60):
            x = int(b)
            for p in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(p)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block)
    got = {r.node: r.component for r in graph.components(links).collect()}
    want = brute_components(dict(zip(signed, fps, strict=True)))
    assert {x: got.get(x, x) for x in signed} == want


def test_awkward_rows(spark):
    df, rows = awkward(spark)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert {r.component_id for r in got if r.doc_id in (8, 9)} == {8}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 300)]
    star = [(1000, x) for x in range(1001, 1200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).collect()}
    assert all(got[x] == 100 for x in range(100, 301))
    assert all(got[x] == 1000 for x in range(1000, 1200))
    assert 5 not in got
