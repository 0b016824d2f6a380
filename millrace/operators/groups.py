"""Consumer groups: lag, dispatch, committed ranges, dead letters, and the replay of group commands."""

from __future__ import annotations

import bisect
import heapq
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import scalars as S
from millrace.operators.log import number_within
from millrace.operators.segments import _in_order, floor_cut, floor_segment
from millrace.schema import DLQ_PREFIX, LEASE_MS, MAX_DELIVERIES
from millrace.storage import durable, small


def lag_of(head: Column, committed: Column) -> Column:
    """In units of the global offset, which other topics use up too; 0 for an unknown topic."""
    return F.when(head < 0, F.lit(0)).otherwise(F.greatest(F.lit(0), head + 1 - F.greatest(F.lit(0), committed))).cast("long")


def group_lag(committed: DataFrame, heads: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """committed (group, topic, committed) with head, lag and members; -1 and 0 where they are unknown."""
    out = committed.join(heads, "topic", "left").withColumn("head", F.coalesce("head", F.lit(-1)))
    out = out.join(members, ["group", "topic"], "left") if members is not None else out.withColumn("members", F.lit(0))
    return out.select("group", "topic", "committed", "head", lag_of(F.col("head"), F.col("committed")).alias("lag"), F.coalesce("members", F.lit(0)).cast("long").alias("members"))


def message_lag(committed: DataFrame, messages: DataFrame) -> DataFrame:
    """(group, topic, message_lag): messages of the topic from the committed offset on.

    Committed offsets of a topic cut it into ranges; messages are counted a range, once, and
    the counts summed from each offset on: no message is repeated for each group.
    """
    cuts = durable(committed.select("topic", F.greatest(F.col("committed"), F.lit(0)).alias("cut")).distinct())
    placed = floor_cut(messages.select("topic", "offset"), cuts, "offset")
    counts = cuts.join(placed.groupBy("topic", "cut").agg(F.count(F.lit(1)).alias("n")), ["topic", "cut"], "left")
    later = Window.partitionBy("topic").orderBy(F.desc("cut"))
    sums = counts.withColumn("message_lag", F.sum(F.coalesce("n", F.lit(0))).over(later).cast("long")).drop("n")
    rows = committed.withColumn("cut", F.greatest(F.col("committed"), F.lit(0)))
    return rows.join(sums, ["topic", "cut"]).select("group", "topic", "message_lag")


def active_members(leases: DataFrame) -> DataFrame:
    """Consumers that hold a lease, and leases, of each group and topic."""
    return leases.groupBy("group", "topic").agg(F.countDistinct("consumer").alias("members"), F.count(F.lit(1)).alias("leases"))


def fetch_committed(wanted: DataFrame, committed: DataFrame) -> DataFrame:
    """wanted (group, topic) with the committed offset; -1 where there is none."""
    return wanted.join(committed, ["group", "topic"], "left").withColumn("committed", F.coalesce("committed", F.lit(-1)))


def seek_time(committed: DataFrame, positions: DataFrame) -> DataFrame:
    """committed after groups (positions: group, topic, position) moved to where a time was found; others stay."""
    moved = committed.join(positions, ["group", "topic"], "full")
    return moved.select("group", "topic", F.coalesce("position", "committed").alias("committed"))


def consumer_groups(lags: DataFrame) -> DataFrame:
    """One row a group: its topics as an array of (topic, head, committed, lag, members), by topic."""
    return lags.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("topic", "head", "committed", "lag", "members"))).alias("topics"))


def dispatch_chunks(messages: DataFrame, n: int) -> DataFrame:
    """Consecutive disjoint chunks (topic, chunk, from_offset, to_offset, n_messages) of at most n messages; to_offset is exclusive."""
    numbered = number_within(messages.select("topic", "offset"), ["topic"], ["offset"])
    chunked = numbered.select("topic", "offset", F.floor(F.col("nth") / n).cast("long").alias("chunk"))
    return chunked.groupBy("topic", "chunk").agg(F.min("offset").alias("from_offset"), (F.max("offset") + 1).alias("to_offset"), F.count(F.lit(1)).alias("n_messages"))


def coalesce_ranges(committed: DataFrame, ranges: DataFrame) -> DataFrame:
    """(group, topic, committed) moved on over ranges (group, topic, from_offset, to_offset) up to the first gap."""
    keys = ["group", "topic"]
    start = committed.select(*keys, F.lit(-1).cast("long").alias("from_offset"), F.col("committed").alias("to_offset"))
    both = start.unionByName(ranges.select(*keys, "from_offset", "to_offset"))
    order = Window.partitionBy(*keys).orderBy("from_offset", "to_offset")
    reach = F.max("to_offset").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # An unset committed offset (-1) stands before offset 0.
    gaps = both.withColumn("_gap", F.when(F.col("from_offset") > F.greatest(reach, F.lit(0)), 1).otherwise(0))
    islands = gaps.withColumn("_island", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.where("_island = 0").groupBy(*keys).agg(F.max("to_offset").alias("committed"))


def latest_offsets(commits: DataFrame) -> DataFrame:
    """The last commit of each group and topic by seq, even where it goes back."""
    return commits.groupBy("group", "topic").agg(F.max_by("offset", "seq").alias("committed"))


def dead_letters(nacks: DataFrame, messages: DataFrame, most: int = MAX_DELIVERIES, prefix: str = DLQ_PREFIX) -> DataFrame:
    """Messages whose failed deliveries (group, topic, offset) reach most, as they go to their dead-letter topic."""
    attempts = nacks.groupBy("group", "topic", "offset").agg(F.count(F.lit(1)).alias("attempts")).where(F.col("attempts") >= most)
    found = attempts.join(messages, ["topic", "offset"])
    return found.select(S.dlq_topic(F.col("group"), F.col("topic"), prefix).alias("dlq_topic"), "offset", "key", "payload", "timestamp", "attempts")


def delivery_attempts(nacks: DataFrame, expired: DataFrame, most: int = MAX_DELIVERIES) -> DataFrame:
    """(group, topic, offset) with failures, attempts since the last dead letter, and dead_letters.

    Rejections (nacks) and expiries of leases (expired: group, topic, from_offset) share a count, that of
    a lease at its first offset; the count begins anew when it reaches most and the message is a dead letter.
    """
    keys = ["group", "topic", "offset"]
    failed = nacks.select(*keys).unionByName(expired.select("group", "topic", F.col("from_offset").alias("offset")))
    counted = failed.groupBy(*keys).agg(F.count(F.lit(1)).alias("failures"))
    return counted.withColumns({"attempts": F.col("failures") % most, "dead_letters": F.floor(F.col("failures") / most).cast("long")})


def poll(committed: DataFrame, messages: DataFrame, n: int) -> DataFrame:
    """Of each (group, topic, committed) the next n messages: what its only consumer gets; commit what log.auto_commit() makes of it.

    Each task keeps the first n of its own messages of a group and topic before they meet.
    """
    due = messages.join(small(durable(committed.select("group", "topic", "committed"))), "topic").where(F.col("offset") >= F.col("committed")).drop("committed")
    nth = F.row_number().over(Window.partitionBy("group", "topic").orderBy("offset"))
    return due.withColumn("_n", nth).where(F.col("_n") <= max(0, n)).drop("_n")


def redeliveries(leases: DataFrame, messages: DataFrame, now_ms: Column, bucket: int = 1024) -> DataFrame:
    """Messages of leases (group, topic, consumer, from_offset, to_offset, expires_at) that have expired: what is delivered again.

    A range join by buckets of offsets: a lease is short, and a message meets the leases of its bucket only.
    """
    late = leases.where(now_ms >= F.col("expires_at"))
    spread = late.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("from_offset") / bucket), F.floor((F.col("to_offset") - 1) / bucket))))
    rows = messages.select("topic", "offset", F.floor(F.col("offset") / bucket).alias("_bucket"))
    found = rows.join(spread, ["topic", "_bucket"]).where("offset >= from_offset and offset < to_offset")
    return found.select("group", "topic", "consumer", "offset")


def fan_out(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """messages once for each group of subscriptions (group, topic) of their topic; repeated subscriptions count once.

    Subscriptions are broadcast where they are counted to be few. Messages of topics that nobody subscribes to go.
    """
    return messages.join(small(durable(subscriptions.select("group", "topic").distinct())), "topic")


class GroupFold:
    """One group and topic, command by command; the one place where lease semantics are.

    offsets: ascending offsets of the topic's messages, by which acquire moves on. The topic's
    offsets are sparse: the next one is the last plus 1, not plus a count.

    stored is what the group's offset store says; committed is what the coordinator has advanced to since the first
    acquire. A group is active while it has members, which are the holders of leases: then commits go through the
    coordinator, and otherwise they overwrite the stored offset, without moving dispatch.

    Kept on purpose: a commit inside a lease drops the lease's tail; expiry counts an attempt on the
    lease's first offset only; a NACK rewinds the whole lease; a late commit changes nothing.

    Ranges beyond a gap wait as a heap, and offsets with attempts are kept in order too: a command costs the same
    however many of either there are.
    """

    def __init__(self, offsets: Sequence[int], lease_ms: int = LEASE_MS, most: int = MAX_DELIVERIES, committed: int = -1) -> None:
        self.offsets, self.lease_ms, self.most = offsets, lease_ms, most
        self.stored = committed
        self.committed = self.dispatch = max(0, committed)
        self.begun = False  # an acquire, even an empty one, starts the coordinator from the stored offset
        self.leases: dict[str, tuple[int, int, int]] = {}  # consumer: from, to, expires at
        self.ranges = []
        self.attempts = {}

    @property
    def active(self) -> bool:
        return bool(self.leases)

    @property
    def ranges(self) -> list[tuple[int, int]]:
        """Committed ranges that the committed offset hasn't reached: a heap."""
        return self._ranges

    @ranges.setter
    def ranges(self, ranges: list[tuple[int, int]]) -> None:
        self._ranges = list(ranges)
        heapq.heapify(self._ranges)

    @property
    def attempts(self) -> dict[int, int]:
        return self._attempts

    @attempts.setter
    def attempts(self, attempts: dict[int, int]) -> None:
        self._attempts = dict(attempts)
        self._tried = sorted(self._attempts)

    def state(self) -> dict:
        return {k.removeprefix("_"): v for k, v in self.__dict__.items() if k not in ("offsets", "_tried")}

    def restore(self, state: dict) -> GroupFold:
        for k, v in state.items():
            setattr(self, k, v)
        return self

    def _advance(self) -> None:
        at = self.committed
        while self._ranges and self._ranges[0][0] <= at:
            at = max(at, heapq.heappop(self._ranges)[1])
        if at > self.committed:
            self.committed = self.stored = at

    def _forget(self, low: int, high: int) -> None:
        i, j = bisect.bisect_left(self._tried, low), bisect.bisect_left(self._tried, high)
        for o in self._tried[i:j]:
            del self._attempts[o]
        del self._tried[i:j]

    def _dead(self, offset: int) -> None:
        heapq.heappush(self._ranges, (offset, offset + 1))
        self._advance()
        self.dispatch = max(self.dispatch, offset + 1)
        self._forget(offset, offset + 1)

    def _failed(self, offset: int) -> bool:
        if offset not in self._attempts:
            bisect.insort(self._tried, offset)
        self._attempts[offset] = self._attempts.get(offset, 0) + 1
        return self._attempts[offset] >= self.most

    def apply(self, at_ms: int, consumer: str | None, op: str, n: int | None, offset: int | None) -> dict:
        """What a command did: delivered_from, delivered_to (exclusive), delivered_n, routed_to_dlq (offsets)."""
        out = {"delivered_from": None, "delivered_to": None, "delivered_n": 0, "routed_to_dlq": []}
        if op == "acquire":
            if not self.begun:
                self.begun = True
                self.committed = self.dispatch = max(0, self.stored)
            i = bisect.bisect_left(self.offsets, self.dispatch)
            taken = self.offsets[i : i + max(0, n or 0)]
            if taken:
                low, high = taken[0], taken[-1] + 1
                out |= {"delivered_from": low, "delivered_to": high, "delivered_n": len(taken)}
                held = self.leases.get(consumer)
                self.leases[consumer] = (held[0] if held else self.dispatch, high, at_ms + self.lease_ms)
                self.dispatch = high
        elif op == "commit":
            if not self.active:
                self.stored = offset
            elif held := self.leases.pop(consumer, None):
                if offset > held[0]:
                    heapq.heappush(self._ranges, (held[0], offset))
                    self._forget(held[0], offset)
                    self._advance()
        elif op == "nack":
            if self.begun:
                held = self.leases.pop(consumer, None)
                back = held[0] if held else offset
                if self._failed(offset):
                    out["routed_to_dlq"].append(offset)
                    self._dead(offset)
                    back = offset + 1 if back == offset else back
                self.dispatch = min(self.dispatch, back)
        elif op == "expire":
            late = sorted((low, who) for who, (low, _, expires) in self.leases.items() if at_ms >= expires)
            for low, who in late:
                del self.leases[who]
                back = low
                if self._failed(low):
                    out["routed_to_dlq"].append(low)
                    self._dead(low)
                    back = low + 1
                self.dispatch = min(self.dispatch, back)
        else:
            raise ValueError(f"unknown command {op!r}")
        return out | {"committed": self.stored, "dispatch": self.dispatch if self.begun else max(0, self.stored)}


REPLAY = "seq long, group string, topic string, op string, delivered_from long, delivered_to long, delivered_n long, committed long, dispatch long, routed_to_dlq array<long>"
DID = ["delivered_from", "delivered_to", "delivered_n", "committed", "dispatch", "routed_to_dlq"]


def reachable_offsets(commands: DataFrame, messages: DataFrame, width: int = 1024) -> DataFrame:
    """group, topic, chunk, offsets: the offsets of messages that the commands of a group can ever deliver, ascending.

    A chunk has a topic's messages of `width` offsets. A group moves on from 0, from an offset it committed before it
    first acquired, or from a rejected one; and no further than all its acquires take together. These spans are found
    among the chunks' counts. They overlap, so each goes on only to where the next one begins: a chunk comes once a
    group, however many spans it lies in. A few offsets more than can be reached do no harm.
    """
    keys = ["group", "topic"]
    chunk = F.floor(F.col("offset") / width)
    chunks = durable(messages.where("offset is not null").groupBy("topic", chunk.alias("chunk")).agg(F.array_sort(F.collect_set("offset")).alias("offsets")))
    order = Window.partitionBy("topic").orderBy("chunk")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = durable(chunks.select("topic", "chunk", F.size("offsets").alias("n")).select("topic", "chunk", "n", F.row_number().over(order).alias("nth"), before.alias("before")))

    acquires = F.col("op") == "acquire"
    takes = commands.groupBy(*keys).agg(F.sum(F.when(acquires, F.greatest(F.lit(0), F.col("n"))).otherwise(0)).alias("_takes"), F.min(F.when(acquires, F.col("seq"))).alias("_begun"))
    takes = durable(takes)
    jumps = commands.where(F.col("op").isin("commit", "nack") & F.col("offset").isNotNull()).groupBy(*keys, "op", chunk.alias("chunk")).agg(F.min("seq").alias("seq"))
    jumps = jumps.join(takes, keys).where((F.col("op") == "nack") | F.col("_begun").isNull() | (F.col("seq") < F.col("_begun")))
    starts = durable(jumps.select(*keys, "chunk").unionByName(takes.select(*keys, F.lit(0).cast("long").alias("chunk"))).distinct())

    floors = floor_segment(starts.select("topic", F.col("chunk").alias("offset")).distinct(), counts.select("topic", F.col("chunk").alias("base")))
    floors = floors.join(counts.withColumnRenamed("chunk", "base"), ["topic", "base"], "left")
    floors = floors.select("topic", F.col("offset").alias("chunk"), F.coalesce("nth", F.lit(1)).alias("low"), F.coalesce(F.col("before") + F.col("n"), F.lit(0)).alias("after"))
    spans = durable(starts.join(floors, ["topic", "chunk"]).join(takes, keys).select(*keys, "low", (F.col("after") + F.col("_takes")).alias("end")))
    ends = floor_segment(spans.select("topic", F.col("end").alias("offset")).distinct(), counts.select("topic", F.col("before").alias("base")))
    ends = ends.join(counts.select("topic", F.col("before").alias("base"), F.col("nth").alias("high")), ["topic", "base"]).select("topic", F.col("offset").alias("end"), "high")
    spans = spans.join(ends, ["topic", "end"]).groupBy(*keys, "low").agg(F.max("high").alias("high"))
    following = F.lead("low").over(Window.partitionBy(*keys).orderBy("low"))
    covered = spans.withColumn("high", F.least("high", following - 1)).select(*keys, F.explode(F.sequence("low", "high")).alias("nth"))
    return covered.join(counts.select("topic", "nth", "chunk"), ["topic", "nth"]).join(chunks, ["topic", "chunk"]).select(*keys, "chunk", "offsets")


def with_reachable(commands: DataFrame, messages: DataFrame) -> DataFrame:
    """commands with offsets, which is null, and further rows without a command, whose offsets are those of reachable_offsets()."""
    columns = ["seq", "at_ms", "group", "topic", "consumer", "op", "n", "offset"]
    reached = reachable_offsets(commands, messages).select("group", "topic", F.col("chunk").alias("seq"), F.lit(0).cast("long").alias("at_ms"), "offsets")
    return commands.select(*columns).unionByName(reached, allowMissingColumns=True).select(*columns, "offsets")


def apply_all(state: GroupFold, rows: pd.DataFrame) -> pd.DataFrame:
    """What commands (seq, at_ms, group, topic, consumer, op, n, offset), in order, did, as in REPLAY."""
    whole = lambda c: [None if absent else int(x) for x, absent in zip(rows[c].tolist(), rows[c].isna(), strict=True)]
    did = [state.apply(*r) for r in zip(whole("at_ms"), rows["consumer"], rows["op"], whole("n"), whole("offset"), strict=True)]
    out = rows[["seq", "group", "topic", "op"]].assign(**{c: [d[c] for d in did] for c in DID})
    return out.astype({"delivered_from": "Int64", "delivered_to": "Int64"})


def replay(commands: DataFrame, messages: DataFrame, lease_ms: int = LEASE_MS, most: int = MAX_DELIVERIES) -> DataFrame:
    """One row per command (schema.COMMAND), in order of seq within group and topic, with what it did.

    A group and topic is one sequential state machine, folded in one task; groups run in
    parallel. The offsets that its commands can reach come before them, chunk by chunk, and are all it
    holds, 8 bytes each; commands stream through it.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = GroupFold(array("q"), lease_ms, most)
        for batch in batches:
            told = batch["offsets"].notna()
            for offsets in batch.loc[told, "offsets"]:
                state.offsets.frombytes(np.asarray(offsets, "int64").tobytes())
            if not told.all():
                yield apply_all(state, batch[~told])

    rows = with_reachable(commands, messages).withColumn("_command", F.col("offsets").isNull())
    # Few groups in many partitions: hardly any two share a task, which would take as long as both.
    return _in_order(rows, ["group", "topic"], ["_command", "seq"], fold, REPLAY, partitions=200)
