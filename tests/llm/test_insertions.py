"""Operator 8: a passage with words put in, on either side, is one passage."""

import pytest
from foliospark.llm import substring

from .fixtures import documents, prose


@pytest.mark.parametrize("later", [True, False])
@pytest.mark.parametrize("around", [0, 40])
def test_words_put_into_a_passage(later, around):
    p, more = prose(1, 95).split(), prose(2, 9)
    whole, longer = " ".join(p), " ".join([*p[:47], more, *p[47:]])
    mine, partner = (longer, whole) if later else (whole, longer)
    a, b = (f"{prose(s, around)} {t} {prose(s + 1, around)}".strip() for s, t in ((5, mine), (7, partner)))
    ((s, e, ps, pe, n, j),) = substring.verify(a, b, 50, 0.8)
    assert (a[s:e], b[ps:pe], n) == (mine, partner, len(mine.split())) and 0.8 <= j < 0.85


def test_it_is_cut(spark):
    p = prose(1, 95).split()
    longer = " ".join([*p[:47], prose(2, 9), *p[47:]])
    texts = [f"{prose(3, 80)} {' '.join(p)}", f"{prose(4, 60)} {longer} {prose(5, 60)}"]
    (row,) = substring.passages(documents(spark, texts)).collect()
    assert texts[1][row.start_char : row.end_char] == longer
