"""Small tables with the awkward rows that every operator must take."""

import random

from pyspark.sql import Row
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = "the river valley market winter garden bridge letter window doctor summer number paper music story island forest village engine captain history morning evening silver copper planet ocean".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def documents(spark, texts, start=0):
    rows = [Row(doc_id=start + i, text=t, lang="en", source="s", n_chars=None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def awkward(spark):
    """Null and empty texts, blanks, control characters, a long word, a very long text, repeated rows, a null id, and columns that clash with results."""
    long = prose(5, 30_000)
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "Ünïcödé ▁ ▁ 漢字 😀\x00"), (6, "x" * 20_000), (7, long), (8, "same same same"), (8, "same same same"), (9, "same same same"), (None, "no id at all"),
    ]
    df = spark.createDataFrame([(i, t, None, None, None, "k", 1, "f") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, score int, fp string")
    return df, rows


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
