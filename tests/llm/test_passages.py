"""Operator 8: planted passages, and compact windows against their definition."""

import random

import numpy as np
import pyarrow as pa
import pytest
from foliospark.llm import substring

from .fixtures import awkward, documents, empty, prose


def edit(text, seed, every):
    r = random.Random(seed)
    w = text.split()
    for k in range(r.randrange(every), len(w), every):
        w[k] = f"edit{r.randrange(99)}"
    return " ".join(w)


def test_windows_are_the_trees_nodes():
    rng = np.random.default_rng(0)
    for n in (1, 5, 40, 200):
        v = rng.integers(1, 2**62, n, dtype=np.uint64) << np.uint64(1)
        v[rng.integers(0, n, max(1, n // 30))] = 0
        got = set(zip(*(x.tolist() for x in substring.compact_windows(v, 6)), strict=True))
        key = [(int(x) >> substring._PLACE << substring._PLACE) | i for i, x in enumerate(v)]
        want = set()
        for c in range(n):
            if v[c] == 0:
                continue
            lo = hi = c
            while lo > 0 and v[lo - 1] != 0 and key[lo - 1] > key[c]:
                lo -= 1
            while hi < n - 1 and v[hi + 1] != 0 and key[hi + 1] > key[c]:
                hi += 1
            if hi - lo + 1 >= 6:
                want.add((lo, c, hi))
        assert got == want


@pytest.fixture(scope="module")
def planted(spark):
    """Forty documents of own words; passages of 60 words in several, some edited; one in all of a dozen."""
    own = [prose(1000 + k, 150) for k in range(40)]
    p, q, hot = prose(1, 60), prose(2, 75), prose(3, 64)
    texts = list(own)
    texts[3] += " " + p
    texts[9] = p + " " + texts[9]
    texts[12] = texts[12] + " " + q
    texts[20] = texts[20][:400] + " " + edit(q, 5, 40) + " " + texts[20][400:]
    for k in range(25, 37):
        texts[k] = texts[k][:300] + " " + hot + " " + texts[k][300:]
    return documents(spark, texts), texts, p, q, hot


def test_planted_passages(planted):
    docs, texts, p, q, hot = planted
    got = substring.passages(docs).collect()
    assert {r.doc_id for r in got} == {9, 20, *range(26, 37)}
    for r in got:
        assert r.doc_id > r.partner_id and r.similarity >= 0.8 and r.n_words >= 50
        a, b = texts[r.doc_id][r.start_char : r.end_char], texts[r.partner_id][r.partner_start : r.partner_end]
        if r.doc_id != 20:
            assert a == b
    nine = next(r for r in got if r.doc_id == 9)
    assert texts[9][nine.start_char : nine.end_char] == p and nine.partner_id == 3


def test_cutting_keeps_the_first_and_all_else(planted):
    docs, texts, p, q, hot = planted
    got = {r.doc_id: r for r in substring.cut_passages(docs, substring.passages(docs)).collect()}
    assert got[3].text == texts[3] and got[12].text == texts[12] and got[25].text == texts[25]
    assert p not in got[9].text and all(hot not in got[k].text for k in range(26, 37))
    assert all(got[k].text == texts[k] and got[k].n_chars == len(texts[k]) for k in (0, 1, 2, 4, 38))
    assert got[9].text.strip() == texts[9][len(p) :].strip()


def test_copies_of_a_document(spark):
    t = prose(8, 120)
    got = substring.passages(documents(spark, [t, t, t, prose(9, 120)])).collect()
    assert {r.doc_id for r in got} == {1, 2}
    assert all((r.start_char, r.end_char) == (0, len(t)) for r in got)
    kept = substring.cut_passages(documents(spark, [t, t, t]), substring.passages(documents(spark, [t, t, t])))
    assert [r.doc_id for r in kept.collect()] == [0]


def test_awkward_rows(spark):
    df, rows = awkward(spark)
    found = substring.passages(df)
    assert found.count() == 0
    assert substring.cut_passages(df, found).count() >= 5
    assert substring.passages(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        substring.passages(df, min_words=5)


def test_every_place_of_a_passage_that_a_document_repeats(spark):
    p = prose(31, 60)
    texts = [prose(32, 90) + " " + p, " ".join([prose(33, 70), p, prose(34, 70), p, prose(35, 70), p]), "same " * 300, "x y z " + "same " * 400]
    got = substring.passages(documents(spark, texts))
    places = sorted((r.start_char, r.end_char) for r in got.where("doc_id = 1").collect())
    assert [texts[1][a:b] for a, b in places] == [p, p, p]
    left = {r.doc_id: r.text for r in substring.cut_passages(documents(spark, texts), got).collect()}
    assert p in left[0] and p not in left[1] and left[2] == texts[2]
    assert left[3].count("same") < 50


def test_earlier_documents_with_less_hide_no_partner(spark):
    texts, want, edited = [], set(), set()

    def among(seed, parts):
        texts.extend(" ".join([prose(seed + 10 + k, 40), *part, prose(seed + 50 + k, 40)]) for k, part in enumerate(parts))
        return len(texts) - 1, len(texts) - 2

    for s in range(20):
        p = prose(9000 + 1000 * s, 50).split()
        want.add(among(9000 + 1000 * s, [p[1:], p[:49], p, p]))
        p = prose(9500 + 1000 * s, 60).split()
        q = [*p[:30], "changed", *p[31:]]
        edited.add(among(9500 + 1000 * s, [p[:45], p[:45], p, q]))
    got = {(r.doc_id, r.partner_id) for r in substring.passages(documents(spark, texts).coalesce(1)).collect()}
    assert want <= got
    assert len(edited & got) >= 18


def test_a_row_with_a_partner_of_its_own_task_stays_for_others():
    """One with words that its partner has not, and others have, is sent on; a copy is not."""
    p = prose(77, 140)
    w = p.split()
    a, b = " ".join(w[:100]), p
    key, doc, _, c, _, around = substring.windows_of([a, b, b], 50)
    order = np.lexsort((c, doc, key))
    key, doc, around = key[order], doc[order], around[order]
    i, j, needed = substring.link(key, doc, around, 50)
    assert not needed[doc == 2].any()
    met = np.zeros(len(key), bool)
    met[i[(doc[i] == 1) & (doc[j] == 0)]] = True
    assert (needed & met).any()


def test_bytes_around_travel():
    around = np.arange(5 * 44, dtype=np.uint8).reshape(5, 44)
    size = np.array([44, 8, 0, 8, 44])
    got = substring._around(substring._binary(around, size).slice(1), 44)
    assert [list(x) for x in got] == [[*x[:n], *[0] * (44 - n)] for x, n in zip(around.tolist()[1:], size[1:], strict=True)]


def test_batches_go_in_small_parts():
    texts = ["x" * 200_000, None, "y" * 250_000, "", "z" * 900_000, "w"]
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["k", "part"])
    parts = list(substring.small([b, b.slice(0, 0)], 1))
    assert [v for x in parts for v in x.column(1).to_pylist()] == texts
    assert all(x.num_rows == 1 or x.nbytes < substring.PIECE_CHARS + 200 for x in parts) and len(parts) > 2
    lists = pa.RecordBatch.from_arrays([pa.array([[1] * 5000, [], None, [2] * 9000, [3]])], names=["links"])
    parts = list(substring.small([lists], 0))
    assert [v for x in parts for v in x.column(0).to_pylist()] == [[1] * 5000, [], None, [2] * 9000, [3]] and len(parts) > 1


def test_links_of_a_passage_travel_as_one(spark):
    """The windows of one long passage gave a link each, on tables with a very common passage six times as many as on others."""
    p = prose(3, 600)
    texts = [prose(4, 80) + " " + p, prose(5, 90) + " " + p + " " + prose(6, 80), p]
    links = substring.passage_links(documents(spark, texts).coalesce(1).select("doc_id", "text"), 50).collect()
    # one from the task, one from the group
    assert {(r.doc_id, r.p) for r in links} == {(1, 0), (2, 0)} and len(links) <= 4


def test_merged_links_give_the_same_candidates():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        pair, c, off = rng.integers(0, 5, n), 1000 + rng.integers(0, 3000, n), rng.choice([0, 7, 130, 900, -50], n)
        a, b = rng.integers(1, 200, n), rng.integers(1, 200, n)
        own, other = [c - a, c, c + b], [c + off - a, c + off, c + off + b]
        got = set(zip(*(z.tolist() for z in substring.stretches(pair, own, other)), strict=True))
        want = set()
        for k in set(pair.tolist()):
            for d in chained(set(off[pair == k].tolist())):
                at = {i for x, y, z, o in zip(pair, c - a, c + b, off, strict=True) if x == k and o in d for i in range(int(y), int(z) + 1)}
                for s, e in spans(sorted(at)):
                    want.add((k, max(0, s - substring.MARGIN), e + substring.MARGIN, max(0, s + min(d) - substring.MARGIN), e + max(d) + substring.MARGIN))
        assert got == want


def chained(values):
    """Sets of values whose neighbours are within the margin."""
    out = []
    for v in sorted(values):
        if out and v - max(out[-1]) <= substring.MARGIN:
            out[-1].add(v)
        else:
            out.append({v})
    return out


def spans(places):
    """First and last of the runs of places with no gap above the margin."""
    cuts = [k for k in range(1, len(places)) if places[k] - places[k - 1] > substring.MARGIN]
    return [(places[i], places[j - 1]) for i, j in zip([0, *cuts], [*cuts, len(places)], strict=True)]


def test_pairs_verified_together_do_not_touch_each_other():
    """Shingles are numbered once for all pairs of a pass; similarity is that of their sets."""
    t = [prose(k, 120) for k in range(4)]
    pairs = [(t[0], edit(t[0], 1, 60)), (t[1], t[0]), (t[0], t[0]), (t[2] + " " + t[2], t[2]), (t[3], t[1] + " " + t[3]), ("", t[0]), (t[0], edit(t[0], 1, 60))]
    together = list(substring.verify_all(pairs, 50, 0.8))
    assert together == [substring.verify(a, b, 50, 0.8) for a, b in pairs]
    assert together[1] == together[5] == [] and together[2][0][5] == 1.0
    for (a, b), found in zip(pairs, together, strict=True):
        for s, e, ps, pe, n, j in found:
            x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a[s:e].split(), b[ps:pe].split()))
            assert n == len(a[s:e].split()) and j == pytest.approx(len(x & y) / len(x | y))
