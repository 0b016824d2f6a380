"""Reads of the log, its catalogue, and the offsets that new messages get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import scalars as S
from millrace.operators.segments import _dealt, floor_cut
from millrace.schema import CACHED_PER_TOPIC, INDEX_EVERY, INDEX_KEPT, MAX_BATCH_BYTES, MAX_BATCH_MESSAGES, page_limit
from millrace.storage import durable, small


def get(messages: DataFrame, topic: str | Column, offset: int) -> DataFrame:
    """The message at an offset of a topic; no row if there is none."""
    return messages.where((F.col("topic") == topic) & (F.col("offset") == offset))


def read_from(messages: DataFrame, topic: str, offset: int, n: int) -> DataFrame:
    """The first n messages of a topic from an offset on, ascending; none for n <= 0."""
    return messages.where((F.col("topic") == topic) & (F.col("offset") >= offset)).orderBy("offset").limit(max(0, n))


def seek_time(messages: DataFrame, at: Column, by: tuple[str, ...] = ("topic",)) -> DataFrame:
    """For each topic, the smallest offset whose timestamp is at or after an instant; -1 if there is none."""
    return messages.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("timestamp") >= at, F.col("offset"))), F.lit(-1)).alias("offset"))


def read_since(messages: DataFrame, topic: str, at: Column, n: int) -> DataFrame:
    """The first n messages from the first one at or after an instant on, whatever the times of later ones."""
    mine = messages.where(F.col("topic") == topic)
    first = seek_time(mine, at).where("offset >= 0").select("offset").scalar()  # known before the scan, which it reaches
    return mine.where(F.col("offset") >= first).orderBy("offset").limit(max(0, n))


def poll(messages: DataFrame, positions: dict[str, int], n: int) -> DataFrame:
    """Of each subscribed topic the first n messages from its position on: a limit a topic, not one for all."""
    parts = [read_from(messages, topic, offset, n) for topic, offset in positions.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def next_page(messages: DataFrame, topic: str, last_offset: int, n: int) -> DataFrame:
    """The page after the one that ended at last_offset."""
    return read_from(messages, topic, last_offset + 1, n)


def inspect(messages: DataFrame, topic: str, offset: int, n: int | None = None) -> DataFrame:
    """A page for people: payload as text, in canonical form if it is JSON; n is clamped to 1 to 100."""
    page = read_from(messages, topic, offset, page_limit(n))
    return page.select("offset", "timestamp", "key", S.pretty_json(S.text_of(F.col("payload"))).alias("payload"))


def payload_bytes(messages: DataFrame) -> DataFrame:
    return messages.groupBy("topic").agg(F.sum(F.octet_length("payload")).cast("long").alias("payload_bytes"), F.count(F.lit(1)).alias("n_messages"))


def topic_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("topic").agg(F.count(F.lit(1)).alias("n_messages"))


def heads(messages: DataFrame) -> DataFrame:
    """The greatest offset of each topic."""
    return messages.groupBy("topic").agg(F.max("offset").alias("head"))


def next_offset(messages: DataFrame) -> DataFrame:
    """One row: the offset after the greatest of all topics; 0 for an empty log."""
    return messages.agg(F.coalesce(F.max("offset") + 1, F.lit(0)).cast("long").alias("next_offset"))


def topic_names(messages: DataFrame) -> DataFrame:
    return messages.select("topic").distinct()


def head_map(messages: DataFrame) -> DataFrame:
    """One row: a map from topic to head; there are few topics."""
    return heads(messages).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "head")))).alias("heads"))


def cached_messages(messages: DataFrame, per_topic: int = CACHED_PER_TOPIC) -> DataFrame:
    return topic_counts(messages).agg(F.coalesce(F.sum(F.least("n_messages", F.lit(per_topic))), F.lit(0)).cast("long").alias("cached"))


def sparse_index(messages: DataFrame, every: int = INDEX_EVERY, kept: int = INDEX_KEPT) -> DataFrame:
    """The offsets an index would hold: every so many, the newest of each topic."""
    rows = messages.where(F.col("offset") % every == 0)
    newest = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("offset")))
    return rows.withColumn("_n", newest).where(F.col("_n") <= kept).select("topic", "offset")


def assign_offsets(rows: DataFrame, order: list[str], base: int = 0, name: str = "offset", partitions: int | None = None) -> DataFrame:
    """rows with dense global offsets in the order of columns that identify a row.

    No task sees all rows: rows are dealt by ranges of the order and numbered within their range;
    only the counts, a row a range, meet in one task.
    """
    dealt = _dealt(rows, order, partitions)
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_range", (before + base).alias("_start")))  # as many as partitions
    return dealt.join(starts, "_range").withColumn(name, (F.col("_start") + F.col("_nth")).cast("long")).drop("_range", "_start", "_nth")


def number_within(rows: DataFrame, key: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """rows with their number, from 0, within their key, null keys too; as in assign_offsets() no task sees all rows of a hot key."""
    dealt = _dealt(rows, [*key, *order])
    of = [F.col(k).alias(f"_of_{k}") for k in key]
    counts = dealt.groupBy(*of, F.col("_range").alias("_of_range")).agg(F.count(F.lit(1)).alias("_n"), F.min("_nth").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*[f"_of_{k}" for k in key]).orderBy("_of_range").rowsBetween(Window.unboundedPreceding, -1))
    # A row for each key of a range; a key's rows of a range stand side by side.
    starts = small(durable(counts.withColumn("_start", F.coalesce(before, F.lit(0)) - F.col("_first")).drop("_n", "_first")))
    same = F.col("_range") == F.col("_of_range")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return dealt.join(starts, same).withColumn(name, (F.col("_start") + F.col("_nth")).cast("long")).drop(*[f"_of_{k}" for k in key], "_of_range", "_range", "_start", "_nth")


def batch_offsets(batches: DataFrame, batch: str, position: str, base: int = 0, partitions: int | None = None) -> DataFrame:
    """Rows of batches with base (their batch's first offset) and offset; batches follow each other in order of their id."""
    sizes = batches.groupBy(batch).agg(F.count(F.lit(1)).alias("_size"))
    bases = running_base(sizes, [batch], "_size", base, partitions).select(batch, F.col("base_offset"))
    nth = F.row_number().over(Window.partitionBy(batch).orderBy(position)) - 1
    return batches.withColumn("_nth", nth).join(bases, batch).withColumn("offset", (F.col("base_offset") + F.col("_nth")).cast("long")).drop("_nth")


def running_base(sizes: DataFrame, order: list[str], size: str, base: int = 0, partitions: int | None = None) -> DataFrame:
    """sizes with base_offset, the sum of all sizes before; in ranges, as in assign_offsets()."""
    dealt = sizes.repartitionByRange(partitions, *order) if partitions else sizes.repartitionByRange(*order)
    dealt = durable(dealt.withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.sum(size).alias("_total"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", (F.coalesce(F.sum("_total").over(earlier.orderBy("_range")), F.lit(0)) + base).alias("_start"))
    within = F.coalesce(F.sum(size).over(earlier.partitionBy("_range").orderBy(*order)), F.lit(0))
    return dealt.join(starts, "_range").withColumn("base_offset", (F.col("_start") + within).cast("long")).drop("_range", "_start")


def atomic_bases(slices: DataFrame, request: str, topic: str, size: str, base: int = 0) -> DataFrame:
    """Base offset of each topic of atomic requests: topics that repeat in a request are one slice; requests and, within them, topics follow in order."""
    merged = slices.groupBy(request, topic).agg(F.sum(size).cast("long").alias("n_entries"))
    return running_base(merged, [request, topic], "n_entries", base)


def merged_proposals(proposals: DataFrame, window: str, topic: str, seq: str, size: str, base: int = 0) -> DataFrame:
    """Proposals of a window and topic become one batch, in order of arrival; each gets its own base offset."""
    batches = proposals.groupBy(window, topic).agg(F.sum(size).cast("long").alias("batch_size"))
    bases = running_base(batches, [window, topic], "batch_size", base).select(window, topic, F.col("base_offset").alias("batch_base"))
    before = F.coalesce(F.sum(size).over(Window.partitionBy(window, topic).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return proposals.withColumn("_before", before).join(bases, [window, topic]).withColumn("base_offset", (F.col("batch_base") + F.col("_before")).cast("long")).drop("_before")


def batch_verdicts(batches: DataFrame, batch: str, payload: str, most: int = MAX_BATCH_MESSAGES, most_bytes: int = MAX_BATCH_BYTES) -> DataFrame:
    """Size of each batch and whether it may be appended; payload is text or binary."""
    sums = batches.groupBy(batch).agg(F.count(F.lit(1)).alias("n_entries"), F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)).cast("long").alias("n_bytes"))
    return sums.withColumn("accepted", (F.col("n_entries") > 0) & (F.col("n_entries") <= most) & (F.col("n_bytes") <= most_bytes))


def start_positions(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Where subscriptions (topic, start, value, committed) begin to read.

    start is earliest, offset (value), time (the first offset at or after value ms; none: the head's next)
    or committed (earliest where committed is null or negative). Times asked for cut a topic's
    messages; the least offset is taken a cut, once, and then from each cut on.
    """
    cuts = durable(subscriptions.where("start = 'time'").select("topic", F.col("value").alias("cut")).where("cut is not null").distinct())
    least = floor_cut(messages.select("topic", "timestamp", "offset"), cuts, "timestamp").groupBy("topic", "cut").agg(F.min("offset").alias("_least"))
    later = Window.partitionBy("topic").orderBy(F.desc("cut"))
    found = cuts.join(least, ["topic", "cut"], "left").select("topic", F.col("cut").alias("value"), F.min("_least").over(later).alias("_found"))
    out = subscriptions.join(found, ["topic", "value"], "left").join(heads(messages), "topic", "left")
    position = (
        F.when(F.col("start") == "offset", F.col("value"))
        .when(F.col("start") == "time", F.coalesce("_found", F.coalesce("head", F.lit(-1)) + 1))
        .when(F.col("start") == "committed", F.greatest(F.lit(0), F.coalesce("committed", F.lit(0))))
        .otherwise(0)
    )
    return out.select("topic", "start", "value", "committed", position.cast("long").alias("position"))


def auto_commit(polled: DataFrame, group: str) -> DataFrame:
    """The offsets that a poll commits: of each topic the last one it returned, plus 1."""
    return polled.groupBy("topic").agg((F.max("offset") + 1).alias("committed")).select(F.lit(group).alias("group"), "topic", "committed")


def gauges(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: topics, messages, the next offset, open segments and their bytes."""
    log_part = messages.agg(F.countDistinct("topic").alias("topics"), F.count(F.lit(1)).alias("n_messages"), F.coalesce(F.max("offset") + 1, F.lit(0)).cast("long").alias("next_offset"))
    disk_part = segments.agg(F.count(F.lit(1)).alias("open_segments"), F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("long").alias("segment_bytes"))
    return log_part.withColumn("_k", F.lit(0)).join(disk_part.withColumn("_k", F.lit(0)), "_k").drop("_k")  # one row each


def append(spark: SparkSession, entries: DataFrame, path: str, order: list[str], stored_at_ms: int) -> int:
    """Entries (topic, payload, key, timestamp) get the next offsets and go to the log at path; how many there were.

    One writer at a time; see streaming.streams.Ledger for appends that may run again.
    """
    from millrace.streaming.streams import Ledger

    return Ledger(spark, path).append_batch(entries, order, stored_at_ms)
