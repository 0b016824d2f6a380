"""The message log that the test tables stand for: events are messages, their types topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import epoch_ms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """offset, topic, key, payload (text), timestamp (ms) and value of every event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("offset"),
        F.col("event_type").alias("topic"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("payload"),
        epoch_ms("ts").alias("timestamp"),
        "value",
        "ts",
    )


def segments(messages: DataFrame, every: int = 1000) -> DataFrame:
    """Segments of each topic: a base for every so many global offsets that the topic has messages in; the first is 0."""
    return messages.groupBy("topic", (F.floor(F.col("offset") / every) * every).cast("long").alias("base")).agg(
        F.max("timestamp").alias("last_modified"), F.count(F.lit(1)).alias("n_messages"), F.sum(F.octet_length("payload")).cast("long").alias("n_bytes")
    )
