"""Appending streams, running counts and rates, and the stateful replay of group commands."""

from __future__ import annotations

import json
import time
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from millrace.operators.groups import REPLAY, GroupFold, apply_all
from millrace.operators.log import assign_offsets, read_from
from millrace.schema import LEASE_MS, MAX_DELIVERIES


class Ledger:
    """A log as a table of batches, each made visible by one small manifest that is renamed into place.

    A batch that runs again finds its manifest and does nothing, or overwrites what it left
    unpublished, with the same base offset. One writer at a time. Readers see whole batches only.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _published(self) -> list[int]:
        """Numbers of the published batches, ascending: one listing, no file is opened."""
        folder = self._path(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, batch_id: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/_commits/{batch_id:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def next_offset(self) -> int:
        published = self._published()
        return self._end(published[-1]) if published else 0

    def _end(self, batch_id: int) -> int:
        last = self._manifest(batch_id)
        return last["base_offset"] + last["count"]

    def append_batch(self, entries: DataFrame, order: list[str], stored_at_ms: int, batch_id: int | None = None) -> int:
        """Appends entries in order as one batch; how many there were. A batch_id that is published already is passed over."""
        published = self._published()
        if batch_id is None:
            batch_id = published[-1] + 1 if published else 0
        if batch_id in published:
            return 0
        base = self._end(published[-1]) if published else 0
        rows = assign_offsets(entries, order, base).withColumn("stored_at", F.lit(stored_at_ms).cast("long"))
        rows.write.mode("overwrite").partitionBy("topic").parquet(f"{self.path}/batch={batch_id}")
        # Topics are folders here and counts come from footers: no column is read again. One row a topic.
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/batch={batch_id}").groupBy("topic").count().collect()
        counts = {r["topic"]: r["count"] for r in written}
        self._publish({"batch_id": batch_id, "base_offset": base, "count": sum(counts.values()), "topics": counts, "schema": rows.schema.json()})
        return sum(counts.values())

    def _publish(self, manifest: dict) -> None:
        name = f"{manifest['batch_id']:020d}.json"
        draft, final = self._path(f"{self.path}/_commits/.{name}.draft"), self._path(f"{self.path}/_commits/{name}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"{final} can't be published")

    def read(self) -> DataFrame:
        """All published messages; an empty ledger has none to read."""
        published = self._published()
        if not published:
            raise ValueError(f"nothing is published in {self.path}")
        schema = StructType.fromJson(json.loads(self._manifest(published[-1])["schema"]))
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/batch={n}" for n in published]).drop("batch")


def long_poll(ledger: Ledger, topic: str, offset: int, n: int, timeout_s: float, every_s: float = 0.2) -> DataFrame:
    """The first n messages of a topic from an offset on, as soon as there are any; none once timeout_s is over.

    Between looks only the name of the last manifest is asked for; a query runs where it has changed.
    """
    until, seen = time.monotonic() + timeout_s, None
    while True:
        published = ledger._published()[-1:]
        if published and published != seen:
            found = read_from(ledger.read(), topic, offset, n)
            if n <= 0 or not found.isEmpty():
                return found
        seen = published
        if time.monotonic() >= until:
            break
        time.sleep(min(every_s, max(0.0, until - time.monotonic())))
    return read_from(ledger.read(), topic, offset, 0)


def append_stream(stream: DataFrame, ledger: Ledger, order: list[str], stored_at_ms: int, checkpoint: str) -> None:
    """Appends what a stream has now to a ledger, micro-batch by micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ledger.append_batch(batch, order, stored_at_ms, batch_id)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, keys: list[str], folder: str, checkpoint: str) -> DataFrame:
    """The rows of an aggregated stream, one for each of its keys, once all input is read.

    Each micro-batch writes the rows that it changed to its own folder, again if it runs again; of a key's
    rows the last one counts. Nothing passes through the driver.
    """
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    stream.sparkSession.createDataFrame([], schema).write.parquet(f"{folder}/batch=-1")  # for a stream without input
    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    changed = stream.sparkSession.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(folder)
    last = changed.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), "batch").alias("_row"))
    return last.select("_row.*")


def replay_stream(commands: DataFrame, lease_ms: int = LEASE_MS, most: int = MAX_DELIVERIES, batch: int = 10_000) -> DataFrame:
    """groups.replay() of a stream of commands and of the offsets that they can reach, as groups.with_reachable() has them;
    offsets must not come in a later micro-batch than commands that reach them.

    The state of a group and topic is GroupFold's, as JSON, and its offsets, packed. Commands of one micro-batch are
    applied in order of seq; a stream must not deliver a command after a later one of its group.
    """
    carried = ["seq", "at_ms", "group", "topic", "consumer", "op", "n", "offset"]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, packed = state.get if state.exists else (None, None)
        offsets = [np.cumsum(np.frombuffer(zlib.decompress(packed), "int64"))] if packed else []
        parts = []
        for rows in batches:
            told = rows["offsets"].notna()
            offsets += [np.asarray(x, "int64") for x in rows.loc[told, "offsets"]]
            parts.append(rows.loc[~told, carried])
        offsets = np.unique(np.concatenate(offsets)) if offsets else np.zeros(0, "int64")
        group = GroupFold(array("q", offsets.tobytes()), lease_ms, most)
        if kept:
            kept = json.loads(kept)
            kept["leases"] = {k: tuple(v) for k, v in kept["leases"].items()}
            kept["ranges"] = [tuple(x) for x in kept["ranges"]]
            kept["attempts"] = {int(k): v for k, v in kept["attempts"].items()}
            group.restore(kept)
        parts = pd.concat(parts, ignore_index=True)
        order = np.argsort(parts["seq"].to_numpy(), kind="stable")
        for at in range(0, len(order), batch):
            yield apply_all(group, parts.take(order[at : at + batch]))
        state.update((json.dumps(group.state()), zlib.compress(np.diff(offsets, prepend=0).tobytes(), 1)))

    return commands.groupBy("group", "topic").applyInPandasWithState(fold, REPLAY, "fold string, offsets binary", "append", GroupStateTimeout.NoTimeout)
