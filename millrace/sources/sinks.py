"""Small tables and expired segments, written so that readers see whole versions only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.storage import durable, small


class VersionedTable:
    """A small table, such as committed offsets, of which a write makes a new version visible by renaming one marker file."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[int, str]]:
        folder = self._path(f"{self.path}/_versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if not n.startswith("."))

    def write(self, rows: DataFrame) -> None:
        """Replaces the table; the version before stays for readers that have begun."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{name}")
        known = self._versions()
        number = known[-1][0] + 1 if known else 0
        draft, final = self._path(f"{self.path}/_versions/.{name}"), self._path(f"{self.path}/_versions/{number}-{name}")
        self._fs.create(draft, True).close()
        if not self._fs.rename(draft, final):
            raise OSError(f"version {number} can't be published")
        for _, old in known[:-1]:
            self._fs.delete(self._path(f"{self.path}/{old}"), True)
        for n, old in known[:-1]:
            self._fs.delete(self._path(f"{self.path}/_versions/{n}-{old}"), True)

    def read(self, schema: str) -> DataFrame:
        """The newest version; no rows before the first."""
        known = self._versions()
        return self.spark.read.schema(schema).parquet(f"{self.path}/{known[-1][1]}") if known else self.spark.createDataFrame([], schema)


def commit_offsets(table: VersionedTable, commits: DataFrame) -> None:
    """Commits (group, topic, committed) replace what the table has for their group and topic, even where they go back."""
    schema = "group string, topic string, committed long"
    before = table.read(schema).join(commits.select("group", "topic"), ["group", "topic"], "left_anti")
    table.write(before.select("group", "topic", "committed").unionByName(commits.select("group", "topic", "committed")).coalesce(1))


def archive_expired(messages: DataFrame, expired: DataFrame, archive_path: str) -> DataFrame:
    """Writes the messages of expired segments (topic, base, next_base) to the archive, by topic and segment; what stays hot.

    Messages carry segment_base. The archive is complete before anything is dropped: the caller
    replaces the hot log by what is returned.
    """
    gone = small(durable(expired.select("topic", F.col("base").alias("segment_base")).distinct()))
    messages.join(gone, ["topic", "segment_base"], "left_semi").write.mode("append").partitionBy("topic", "segment_base").parquet(archive_path)
    return messages.join(gone, ["topic", "segment_base"], "left_anti")


def to_console(stream: DataFrame, checkpoint: str):
    """A running query that prints each message as it comes."""
    return stream.writeStream.format("console").option("checkpointLocation", checkpoint).start()
