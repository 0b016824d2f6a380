"""The folder that driver and executors share, and results kept there."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and executors are local, as in tests, a local folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and not re.fullmatch(r"local(\[[^,]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="millrace-shared-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: stable under re-reads and lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df, which must be durable() and narrow, to be broadcast in a join if it has at most most_rows; else as it is."""
    return F.broadcast(df) if df.count() <= most_rows else df
