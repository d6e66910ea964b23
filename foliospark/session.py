"""What every query needs of its session."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def share_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where it was imported from a folder, as in local mode.

    A cluster installs the package on its workers or gets it by ``--py-files``; this only adds a search path."""
    env = spark.sparkContext.environment
    had = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in had.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, had) if x)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its input has fewer files than those, as a table of one row group has.

    For steps that cost far more than a shuffle of their rows. Inputs of as many files as cores stay as they are; what is known of the files alone
    decides, so no job runs."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
