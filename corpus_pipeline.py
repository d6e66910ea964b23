"""A corpus through five stages; each takes (spark, docs, sf_dir) and is written before the next reads it.

Quality, near-duplicates, repeated passages and benchmark leaks filter or edit the documents and keep their
columns; the last stage encodes what is left.

Defined cases: a null text counts as empty everywhere; its score decides in the first stage, and of all texts without a word one stays after the second.
Null ids pass: each of their texts is a document of its own, of which no passage is cut. Repeated rows become one. Extra columns
travel along whatever their names; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontam, near_copies, quality, sentencepiece_dropout, substring
from foliospark.llm.common import checkpoint_dir, held_out, read



def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; fitted on the labelled rows of the learning folds that this stage gets."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels"), training=~held_out()))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-copies (five-word shingles, Jaccard 0.8 or more) the row with the smallest doc_id, a null one last, then the smallest
    text hash; of rows that repeat id and text, one. Of different texts of one id,
    the one with the smallest hash."""
    t = F.xxhash64(F.col("text").cast("string"))
    # structs compare field by field: any id goes before a null one
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    first = near_copies.near_copies(docs).groupBy("component").agg(F.min(row).alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.t").alias("__t"))
    # later stages know a document by its id, so of several texts of one id only one can go on
    first = first.where("__id is not null").groupBy("__id").agg(F.min("__t").alias("__t")).union(first.where("__id is null"))
    kept = docs.join(first, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (t == F.col("__t")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).select(docs.columns)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier document's are cut out."""
    return substring.cut_passages(docs, substring.passages(docs))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go."""
    return decontam.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the seeded dropout."""
    return sentencepiece_dropout.encode(docs)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("passages", without_passages), ("decontamination", without_leaks), ("tokens", encoded)]
#: Compression, hashing and tokenizer stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a Parquet table in the shared folder, removed when the next one is written."""
    import uuid

    at, docs, had = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if had:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(had)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        had = f"{at}/{name}"
    return docs
