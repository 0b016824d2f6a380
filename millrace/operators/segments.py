"""Segments of the log: ranges, look-ups by offset, retention, archive, catch-up and rolling.

Segment tables are small beside the log (one row for megabytes of messages); look-ups join a
message to its segment by merging both in offset order, never by comparing all with all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.schema import SEGMENT_BYTES
from millrace.storage import durable, small


def _dealt(rows: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """rows dealt by ranges of an order, with _range and their number _nth, from 0, within it.

    Partitions are sorted where they lie, so numbering shuffles nothing more. The dealing is kept in
    the shared folder, so that counts and numbers agree.
    """
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    number = F.monotonically_increasing_id()  # the partition, then 33 bits that count its rows
    return durable(dealt.sortWithinPartitions(*order).withColumns({"_range": F.shiftright(number, 33), "_nth": number.bitwiseAND(F.lit((1 << 33) - 1))}))


def ranges(segments: DataFrame) -> DataFrame:
    """segments (topic, base) with next_base; null for the active, last one."""
    return segments.withColumn("next_base", F.lead("base").over(Window.partitionBy("topic").orderBy("base")))


def floor_segment(offsets: DataFrame, segments: DataFrame, bucket: int = 100_000) -> DataFrame:
    """offsets (topic, offset) with base: of the segment with the greatest base at or below it; null below the first.

    As-of, backward. Rows are dealt by topic and a bucket of offsets, so a hot topic
    spreads; each bucket begins with the last base before it.
    """
    return _as_of(offsets, segments, bucket, forward=False)


def next_segment(offsets: DataFrame, segments: DataFrame, bucket: int = 100_000) -> DataFrame:
    """offsets with base: of the first segment that begins above the offset; null beyond the last. As-of, forward."""
    return _as_of(offsets, segments, bucket, forward=True)


def floor_cut(rows: DataFrame, cuts: DataFrame, at: str, few: int = 64, most: int = 10_000, bucket: int = 100_000) -> DataFrame:
    """rows with cut: the greatest of cuts (topic, cut; distinct and durable()) at or below their `at`. Rows below all cuts go.

    Cuts are broadcast, an array a topic, where they were counted to be at most `most`, and `few` a topic: then
    rows don't move. Otherwise rows and cuts are merged in buckets, as in floor_segment().
    """
    sizes = cuts.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if sizes[0] <= most and sizes[1] <= few:
        per_topic = cuts.groupBy("topic").agg(F.collect_list("cut").alias("_cuts"), F.min("cut").alias("_least"))
        placed = rows.join(F.broadcast(per_topic), "topic").where(F.col("_least") <= F.col(at))
        return placed.withColumn("cut", F.array_max(F.filter("_cuts", lambda c: c <= F.col(at)))).drop("_cuts", "_least")
    carried = tuple(c for c in rows.columns if c not in ("topic", at))
    return _as_of(rows, cuts.withColumnRenamed("cut", "base"), bucket, False, at, carried).withColumnRenamed("base", "cut").where("cut is not null")


def _as_of(offsets: DataFrame, segments: DataFrame, bucket: int, forward: bool, at: str = "offset", carried: tuple[str, ...] = ()) -> DataFrame:
    bases = segments.select("topic", F.col("base").alias("_at"), F.col("base").alias("_base"), F.lit(0).alias("_probe")).distinct()
    probes = offsets.select("topic", F.col(at).cast("long").alias("_at"), F.lit(None).cast("long").alias("_base"), F.lit(1).alias("_probe"), *carried)
    both = bases.unionByName(probes, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_at") / bucket))
    # The base that a bucket begins with (or ends with, forward) comes from the buckets beside it.
    edge = F.min("_base") if forward else F.max("_base")
    edges = both.groupBy("topic", "_bucket").agg(edge.alias("_edge"))
    beside = Window.partitionBy("topic").orderBy(F.desc("_bucket") if forward else F.asc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("topic", "_bucket", F.last("_edge", ignorenulls=True).over(beside).alias("_carried"))
    # At equal offsets a base counts for a backward look-up, and not for a forward one.
    order = [F.desc("_at"), F.desc("_probe")] if forward else [F.asc("_at"), F.asc("_probe")]
    within = Window.partitionBy("topic", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_seen", F.last("_base", ignorenulls=True).over(within)).where("_probe = 1").join(edges, ["topic", "_bucket"])
    return found.select("topic", F.col("_at").alias(at), F.coalesce("_seen", "_carried").alias("base"), *carried)


def expired(segments: DataFrame, now_ms: Column, retention_ms: int) -> DataFrame:
    """Segments (topic, base, last_modified) that retention removes: not the active one, and older than it allows."""
    return ranges(segments).where(F.col("next_base").isNotNull() & (F.col("last_modified") < now_ms - retention_ms))


def with_archive(hot: DataFrame, archived: DataFrame) -> DataFrame:
    """Hot and archived messages; of those with one topic and offset, the hot one.

    Hot messages don't move, nor do archived ones below the first hot offset of their topic; only
    the others look for their offset among the hot.
    """
    first = small(durable(hot.groupBy("topic").agg(F.min("offset").alias("_first"))))
    placed = archived.join(first, "topic", "left")
    clear = F.col("_first").isNull() | (F.col("offset") < F.col("_first"))
    beside = placed.where(~clear).join(hot.select("topic", "offset"), ["topic", "offset"], "left_anti")
    return hot.unionByName(placed.where(clear).unionByName(beside).drop("_first"), allowMissingColumns=True)


def catch_up(segments: DataFrame, follower: DataFrame) -> DataFrame:
    """Segments that a follower lacks (topic, follower_offset; -1 where it has none): the one it stands in and all later."""
    known = ranges(segments).join(follower, "topic", "left").withColumn("follower_offset", F.coalesce("follower_offset", F.lit(-1)))
    return known.where(F.col("next_base").isNull() | (F.col("next_base") > F.col("follower_offset")))


def roll(messages: DataFrame, size: str = "n_bytes", limit: int = SEGMENT_BYTES) -> DataFrame:
    """messages (topic, offset, size) with segment_base: a new segment begins where the one before has `limit` bytes or more.

    A topic's first segment has base 0; a null size counts as 0. Where a segment ends depends on all before it, yet no
    task sees a whole topic: messages are dealt by ranges, and a range tells, for each row at which its first segment may begin,
    where its last one then does. Topics follow these answers from range to range, and ranges are cut side by side.
    Answers that agree are merged; there are at most as many as a segment has messages.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    rows = _dealt(messages.select("topic", "offset", size), ["topic", "offset"]).drop("_nth")

    def answers(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(parts))
        offsets, sizes = part["offset"].to_numpy(), part[size].fillna(0).to_numpy(np.int64)
        total, n = int(sizes.sum()), len(sizes)
        before = np.cumsum(sizes) - sizes
        entries = np.arange(min(n, int(np.searchsorted(before, limit)) + 1))
        last, place = entries, entries  # of each entry: the last segment's first row so far; place of it among the different ones
        while len(last):
            after = np.searchsorted(before, before[last] + limit)
            if (after == n).all():
                break
            last, same = np.unique(np.where(after < n, after, last), return_inverse=True)
            place = same[place]
        ends = np.flatnonzero(np.diff(place, append=-1))  # the last entry of those with one answer
        at = last[place[ends]]
        yield pd.DataFrame({"topic": [key[0]], "_range": [key[1]], "total": [total], "upto": [before[ends]], "bases": [offsets[at]], "held": [total - before[at]]})

    def follow(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, held = 0, 0
        for part in parts:
            given = []
            for r in part.itertuples():
                given.append((base, held))
                at = int(np.searchsorted(r.upto, limit - held))
                base, held = (int(r.bases[at]), int(r.held[at])) if at < len(r.upto) else (base, held + r.total)
            yield pd.DataFrame({"topic": key[0], "_range": part["_range"], "_base": [x[0] for x in given], "_held": [x[1] for x in given]})

    def cut(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = held = None
        for part in parts:
            if base is None:
                base, held = int(part["_base"].iloc[0]), int(part["_held"].iloc[0])
            offsets, sizes = part["offset"].to_numpy(), part[size].fillna(0).to_numpy(np.int64)
            total = np.cumsum(sizes)
            before, bases = total - sizes, np.empty(len(sizes), np.int64)
            at, began = 0, -held
            while (end := int(np.searchsorted(before, began + limit))) < len(sizes):
                bases[at:end] = base
                at, base, began = end, int(offsets[end]), int(before[end])
            bases[at:] = base
            held = int(total[-1]) - began
            yield part[["topic", "offset", size]].assign(segment_base=bases)

    keys = ["topic", "_range"]
    told = rows.mapInPandas(_by_run(keys, answers), "topic string, _range long, total long, upto array<long>, bases array<long>, held array<long>")
    entered = small(durable(_in_order(told, ["topic"], ["_range"], follow, "topic string, _range long, _base long, _held long")))
    schema = f"{messages.select('topic', 'offset', size).schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, segment_base long"
    return rows.join(entered, keys).sortWithinPartitions(*keys, "offset").mapInPandas(_by_run(keys, cut), schema)


def _by_run(keys: list[str], fold):
    """What mapInPandas needs to apply fold(key, batches) to each run of rows with one key, batch by batch: no run is held whole."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def runs() -> Iterator[tuple[tuple, pd.DataFrame]]:
            for batch in batches:
                if len(batch):
                    changed = (batch[keys] != batch[keys].shift()).any(axis=1).cumsum()
                    for _, part in batch.groupby(changed, sort=False):
                        yield tuple(part[keys].iloc[0]), part

        stream = runs()
        waiting = next(stream, None)
        while waiting is not None:
            key = waiting[0]

            def own(key: tuple = key) -> Iterator[pd.DataFrame]:
                nonlocal waiting
                while waiting is not None and waiting[0] == key:
                    part = waiting[1]
                    waiting = next(stream, None)
                    yield part

            yield from fold(key, own())

    return run


def _in_order(rows: DataFrame, keys: list[str], order: list[str], fold, schema: str, partitions: int | None = None) -> DataFrame:
    """fold(key, batches) for each key, with its rows in order, batch by batch."""
    dealt = rows.repartition(partitions, *keys) if partitions else rows.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(_by_run(keys, fold), schema)


def producer_batches(messages: DataFrame, most_bytes: int, linger_ms: int) -> DataFrame:
    """messages (producer, seq, at_ms, topic, n_bytes) with batch: its number within the producer, from 0.

    A batch takes messages in order until it has most_bytes or more, until the next one is
    linger_ms or more after its first, or until the topic changes; that message begins the next batch.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, topic, began, held = -1, None, 0, 0
        for batch in batches:
            numbers = []
            for t, at, n in zip(batch["topic"], batch["at_ms"], batch["n_bytes"], strict=True):
                if number < 0 or t != topic or held >= most_bytes or at - began >= linger_ms:
                    number, topic, began, held = number + 1, t, at, 0
                held += n
                numbers.append(number)
            yield batch.assign(batch=numbers)

    columns = ["producer", "seq", "at_ms", "topic", "n_bytes"]
    return _in_order(messages.select(*columns), ["producer"], ["seq"], fold, "producer long, seq long, at_ms long, topic string, n_bytes long, batch long")
