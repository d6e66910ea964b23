"""Operators 9 and 10: planted texts, and edit distance against the plain recurrence."""

import random

from foliospark.llm import decontam, license_scan

from .fixtures import awkward, documents, empty, prose


def test_licences_with_spans(spark):
    full = license_scan.TEMPLATES["Apache-2.0-header"]
    some = full.replace("required by applicable law", "needed by law").replace("License.", "Licence .")
    short = "Released under the MIT License."
    texts = [prose(1, 50) + " " + full + " " + prose(2, 50), prose(3, 30) + "\n" + some, short, prose(4, 40), None, "", f"{prose(5, 300)} {short} {prose(6, 300)}"]
    got = sorted((r.doc_id, r.license, r.coverage, r.start_char, r.end_char) for r in license_scan.scan(documents(spark, texts)).collect())
    assert [(d, n) for d, n, *_ in got] == [(0, "Apache-2.0-header"), (1, "Apache-2.0-header"), (2, "MIT"), (6, "MIT")]
    assert texts[0][got[0][3] : got[0][4]].startswith("Licensed under") and texts[0][got[0][3] : got[0][4]].endswith("under the License")
    assert got[0][2] == 1.0 and 0.8 <= got[1][2] < 1.0
    assert texts[6][got[3][3] : got[3][4]] == "Released under the MIT License"


def test_alignment_against_plain_lcs():
    r = random.Random(1)
    for _ in range(60):
        a = [r.randrange(6) for _ in range(r.randrange(1, 12))]
        b = [r.randrange(6) for _ in range(r.randrange(1, 12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert license_scan.align(a, b, 0, band=12)[0] == table[-1][-1]


def fit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_distance_against_plain_recurrence():
    r = random.Random(2)
    for _ in range(200):
        p = "".join(r.choice("abc") for _ in range(r.randrange(1, 9)))
        t = "".join(r.choice("abc") for _ in range(r.randrange(0, 14)))
        assert min([len(p), *decontam.distances(p, t)]) == fit_distance(p, t)


def test_leaks_exact_and_edited(spark):
    items = [(k, prose(500 + k, 18 + k)) for k in range(12)] + [(90, None), (91, ""), (None, "no id"), (92, "short"), (93, items0 := prose(500, 18))]
    r = random.Random(4)

    def edited(t):
        w = t.split()
        for k in r.sample(range(len(w)), max(1, len(w) // 12)):
            w[k] = w[k][:-1] + "q"
        del w[r.randrange(len(w))]
        return " ".join(w)

    texts, want = [], set()
    for k in range(12):
        texts.append(prose(800 + k, 60) + " " + (items[k][1] if k % 2 else edited(items[k][1]).upper()) + " " + prose(900 + k, 60))
        want.add((k, k))
    texts += [prose(700 + k, 100) for k in range(20)] + [None, ""]
    want.add((0, 93))
    assert items0 == items[0][1]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontam.find(documents(spark, texts), bench).collect()}
    assert set(got) == want
    assert all(x.similarity >= 0.8 for x in got.values())
    assert all(x.distance == 0 for (d, i), x in got.items() if d % 2)
    clean = decontam.drop_leaks(documents(spark, texts), bench)
    assert sorted(x.doc_id for x in clean.collect()) == list(range(12, 34))
    sliced = {(x.doc_id, x.item_id) for x in decontam.find(documents(spark, texts), bench, slice_chars=400).collect()}
    assert sliced == want


def test_awkward_rows(spark):
    df, rows = awkward(spark)
    bench = spark.createDataFrame([(1, prose(5, 25)), (1, prose(5, 25)), (2, "same same same")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.find(df, bench).collect()}
    assert got == {(7, 1), (8, 2), (9, 2)}
    assert decontam.find(empty(spark), bench).count() == 0
    assert decontam.find(df, bench.limit(0)).count() == 0
    assert decontam.drop_leaks(df, bench.limit(0)).count() == len(rows)
    assert license_scan.scan(df).count() == 0
    assert license_scan.scan(empty(spark)).count() == 0


def spoiled(text, r, how):
    """Letters changed: a share of all characters replaced, put in or left out, or one letter in each word of four or more."""
    if how == "typo":
        return " ".join(w[:k] + r.choice("abcdefghij") + w[k + 1 :] if len(w) > 3 and (k := r.randrange(len(w))) >= 0 else w for w in text.split())
    out = []
    for c in text:
        x = r.random()
        out.append(c if x >= how else r.choice("etaoin") if x < how / 2 else c + r.choice("etaoin") if x < 0.75 * how else "")
    return "".join(out)


def natural(seed, n):
    """Prose with words of one to nine letters."""
    r = random.Random(seed)
    words = random.Random(0)
    known = ["".join(words.choice("aeioubcdfglmnprst") for _ in range(words.choice([1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9]))) for _ in range(900)]
    return " ".join(r.choice(known) for _ in range(n))


def test_recall_against_brute_force():
    r = random.Random(8)
    bench = [(k, natural(2000 + k, 35 + k % 20)) for k in range(60)]
    items = decontam.Items(bench)
    for how in (0.05, 0.1, 0.15, 0.18, "typo"):
        texts = [f"{natural(3000 + k, 50)} {spoiled(t, r, how)} {natural(4000 + k, 50)}" for k, t in bench]
        due = {k for k, t in bench if decontam.matches(t, texts[k], int(0.2 * len(t) + 1e-9))}
        got = {(d, i): dist for d, i, dist, *_ in sorted(decontam.scan_texts(items, texts, 0.8), key=lambda x: -x[2])}
        assert len(due) > 30 and sum((k, k) in got for k in due) >= 0.95 * len(due), how
        # what is reported is the least distance of any stretch
        assert all(got[k, k] == fit_distance(t, " ".join(texts[k].split())) for k, t in bench[:6] if (k, k) in got)
        assert all(d == i for d, i in got)


def test_short_items_and_other_scripts():
    rows = [(1, "kilo"), (2, "ab"), (3, "two words"), (4, "学习语言模型需要大量干净的训练数据而且评测集不能混入其中否则结果不可信"), (5, "x y z")]
    items = decontam.Items(rows)
    cjk = rows[3][1]
    texts = ["a kilo of", "kilometre", "ab", "cab", "some two words here", "前文" + cjk[:10] + "的" + cjk[11:] + "后文", "x y z", "nothing"]
    assert {(d, i) for d, i, *_ in decontam.scan_texts(items, texts, 0.8)} >= {(0, 1), (2, 2), (4, 3), (5, 4), (6, 5)}
    assert not {d for d, *_ in decontam.scan_texts(items, texts, 0.8)} & {1, 3, 7}


def test_many_copies_in_one_text():
    t = natural(1, 20)
    got = decontam.scan_texts(decontam.Items([(7, t)]), [" ".join([t] * 50)], 0.8)
    assert len(got) == 50 and all(x[2] == 0 for x in got)
