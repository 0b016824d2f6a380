"""The data model of a message log: schemas, limits and the rules that input must meet."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("offset", T.LongType(), False),
    T.StructField("topic", T.StringType(), False),
    T.StructField("payload", T.BinaryType()),
    T.StructField("key", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("stored_at", T.LongType()),
])
BATCH_ENTRY = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("key", T.StringType()), T.StructField("client_timestamp", T.LongType())])
ATOMIC_SLICES = T.ArrayType(T.StructType([T.StructField("topic", T.StringType()), T.StructField("entries", T.ArrayType(BATCH_ENTRY))]))
COMMITTED = T.StructType([T.StructField("group", T.StringType()), T.StructField("topic", T.StringType()), T.StructField("committed", T.LongType())])
COMMAND = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("at_ms", T.LongType()), T.StructField("group", T.StringType()), T.StructField("topic", T.StringType()),
    T.StructField("consumer", T.StringType()), T.StructField("op", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("offset", T.LongType()),
])
RAFT_ENTRY = T.StructType([
    T.StructField("term", T.LongType()), T.StructField("index", T.LongType()), T.StructField("topic", T.StringType()), T.StructField("payload", T.BinaryType()),
    T.StructField("key", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("command_type", T.StringType()),
    T.StructField("consumer_group", T.StringType()), T.StructField("offset_value", T.LongType()),
])
CLUSTER_EVENT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("timestamp", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("node_id", T.StringType()), T.StructField("severity", T.StringType()),
])

# Limits that decide results.
TOPIC_PATTERN = "^[A-Za-z0-9._-]+$"
RESERVED_TOPICS = [".", "..", "raft", "__consumer_offsets"]
MAX_MESSAGE_BYTES = 10 * 1024 * 1024
MAX_BATCH_MESSAGES = 10_000
MAX_BATCH_BYTES = 10 * 1024 * 1024
SEGMENT_BYTES = 100 * 1024 * 1024
RETENTION_MS = 7 * 24 * 3600 * 1000
MAX_DELIVERIES = 5
DLQ_PREFIX = "dlq."
LEASE_MS = 30_000
CACHED_PER_TOPIC = 1000
INDEX_EVERY, INDEX_KEPT = 1000, 10_000
RPC_ENTRIES, RPC_BYTES = 500, 8 * 1024 * 1024
PRODUCER_BATCH_BYTES, PRODUCER_LINGER_MS = 1024 * 1024, 5
HISTORY_TICKS = 300
QUORUM_CONTACT_MS = 6000
STALE_PROPOSAL_MS = 65_000


def topic_is_valid(topic: Column) -> Column:
    """Whether a topic may be written to; null is not valid."""
    return F.coalesce(topic.rlike(TOPIC_PATTERN) & ~topic.isin(RESERVED_TOPICS), F.lit(False))


def page_limit(n: int | None, default: int = 10, least: int = 1, most: int = 100) -> int:
    """The number of rows a page has: n, clamped."""
    return min(most, max(least, default if n is None else n))


@dataclasses.dataclass(frozen=True)
class LogConfig:
    """Settings that change results. from_options(): later options win; bad values raise ValueError."""

    segment_bytes: int = SEGMENT_BYTES
    retention_ms: int = RETENTION_MS
    max_deliveries: int = MAX_DELIVERIES
    dlq_prefix: str = DLQ_PREFIX
    lease_ms: int = LEASE_MS
    compaction_threshold: int = 10_000

    @classmethod
    def from_options(cls, *sources: dict[str, str | int]) -> LogConfig:
        merged: dict = {}
        for source in sources:
            merged |= source
        kinds = {f.name: f.type for f in dataclasses.fields(cls)}
        if unknown := merged.keys() - kinds.keys():
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        for name, value in merged.items():
            if kinds[name] == "int":
                merged[name] = int(value)
                if merged[name] <= 0:
                    raise ValueError(f"{name} must be positive, not {value}")
            elif not str(value).strip():
                raise ValueError(f"{name} must not be blank")
        return cls(**merged)

    @staticmethod
    def parse_properties(text: str) -> dict[str, str]:
        """key=value lines; blank lines and those that begin with # or ! say nothing."""
        lines = (line.strip() for line in text.splitlines())
        pairs = (line.split("=", 1) for line in lines if line and line[0] not in "#!" and "=" in line)
        return {k.strip(): v.strip() for k, v in pairs}
