"""Operators 1 and 7: round trips, and the library's own tokens."""

import numpy as np
import pytest
import sentencepiece
from foliospark.llm import bpe, sentencepiece_dropout, token_count

from .fixtures import awkward, documents, empty, prose


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=bpe.default_model())


def test_counts_are_the_librarys(spark, library):
    df, rows = awkward(spark)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_bytes, r.over_limit) for r in token_count.token_counts(df).collect()))
    want = sorted((i is None, i or 0, len(library.encode(t or "")), len((t or "").encode()), len(library.encode(t or "")) > 4096) for i, t in rows)
    assert got == want


def test_no_dropout_gives_the_librarys_ids(spark, library):
    texts = [prose(k, 40) for k in range(5)] + ["", None, "Straße, naïve  double  spaces", "日本語 text", "tab\tand\nline"]
    got = {r.doc_id: r for r in sentencepiece_dropout.encode(documents(spark, texts), dropout=0.0).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].token_ids) == library.encode(t or "")


def test_dropout_varies_by_seed_and_decodes_losslessly(spark):
    df, rows = awkward(spark)
    one = sentencepiece_dropout.encode(df, dropout=0.3, seed=1)
    two = {(r.doc_id, r.n_chars): list(r.token_ids) for r in sentencepiece_dropout.encode(df, dropout=0.3, seed=2).collect()}
    again = {(r.doc_id, r.n_chars): list(r.token_ids) for r in sentencepiece_dropout.encode(df.repartition(7), dropout=0.3, seed=1).collect()}
    got = {(r.doc_id, r.n_chars): list(r.token_ids) for r in one.collect()}
    assert got == again
    assert got != two
    assert all(r.lossless for r in one.collect())
    back = sentencepiece_dropout.decode(one.where("doc_id is not null").select("doc_id", "token_ids"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i, t or "") for i, t in rows if i is not None)


def test_dropout_one_leaves_characters(spark):
    got = sentencepiece_dropout.encode(documents(spark, ["market garden"]), dropout=1.0).first()
    assert got.n_tokens == len(" market garden")


def test_unknown_ids_and_empty_tables(spark):
    assert sentencepiece_dropout.encode(empty(spark)).count() == 0
    assert token_count.token_counts(empty(spark)).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, token_ids array<int>")
    assert sorted((r.doc_id, r.text) for r in sentencepiece_dropout.decode(none).collect()) == [(1, ""), (2, "")]


def test_proven_strings_encode_alone(library):
    _, size, chars = token_count.proven(bpe.default_model())
    for k in np.random.default_rng(1).choice(len(size), 300, replace=False):
        piece = "".join(map(chr, chars[k, : size[k]]))
        assert library.encode(piece.replace("▁", " ")[1:], out_type=str) == [piece] or not piece.startswith("▁")
