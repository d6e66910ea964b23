"""New files as a stream: the same extraction, stateless, exactly once by the file source's log and the sink's checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import extract

FILE = "path string, modificationTime timestamp, length long, content binary"


def files_stream(spark: SparkSession, path: str, glob: str = "*.pdf", max_files: int = 1000) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def start(spark: SparkSession, path: str, to: str, checkpoint: str, *, table: str = "runs", once: bool = True, **options):
    """Appends a table of all new files under ``path`` to Parquet at ``to``; with ``once`` it ends when none is left."""
    rows = extract(files_stream(spark, path), table, **options)
    writer = rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, *, width: str = "1 hour", late: str = "30 minutes", time_col: str = "ts", by: str = "event_type") -> DataFrame:
    """Events by tumbling window and kind, batch or stream (then with a watermark)."""
    if events.isStreaming:
        events = events.withWatermark(time_col, late)
    return events.groupBy(F.window(time_col, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour", time_col: str = "ts", by: str = "user_id") -> DataFrame:
    """Runs of events of one user that lie less than ``gap`` apart."""
    if events.isStreaming:
        events = events.withWatermark(time_col, late)
    return events.groupBy(F.session_window(time_col, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
