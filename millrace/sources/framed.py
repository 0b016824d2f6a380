"""Segment files of framed records: for each, a 4-byte big-endian length and a message in protocol-buffer wire format.

Files are read whole through Spark, from any store it knows; a file is one segment, of
bounded size. Reading a file stops at its first bad frame, as recovery does.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalars import segment_base
from millrace.schema import MAX_MESSAGE_BYTES, RAFT_ENTRY

# Field numbers of a stored message.
FIELDS = {1: "offset", 2: "topic", 3: "payload", 4: "key", 5: "timestamp", 6: "stored_at"}
_NUMBERS = {"offset", "timestamp", "stored_at"}
# Field numbers of a replicated log's entry, and its command types in order.
ENTRY_FIELDS = {1: "term", 2: "index", 3: "topic", 4: "payload", 5: "key", 6: "timestamp", 7: "command_type", 8: "consumer_group", 9: "offset_value"}
_ENTRY_NUMBERS = {"term", "index", "timestamp", "command_type", "offset_value"}
COMMAND_TYPES = ["MESSAGE", "OFFSET_COMMIT", "BATCH_MESSAGE", "ATOMIC_BATCH"]
_TEXTS = {"topic", "key", "consumer_group"}
_OPTIONAL = {"key", "consumer_group", "offset_value"}
_SCHEMA = "segment_base long, topic_dir string, offset long, topic string, payload binary, key string, timestamp long, stored_at long"


class CorruptRecord(ValueError):
    """A frame with a bad length, cut short or not a message."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise CorruptRecord("number cut short")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return (value - (1 << 64) if value >= 1 << 63 else value), at


def decode(data: bytes, fields: dict[int, str] = FIELDS, numbers: set[str] = _NUMBERS) -> dict:
    """A message; fields that it lacks have the defaults of the format, optional ones are None."""
    out = {x: None if x in _OPTIONAL else 0 if x in numbers else "" if x in _TEXTS else b"" for x in fields.values()}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        name, kind = fields.get(tag >> 3), tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            value, at = None, at + (8 if kind == 1 else 4)
        elif kind == 2:
            size, at = _varint(data, at)
            if not 0 <= size <= len(data) - at:
                raise CorruptRecord("field cut short")
            value, at = data[at : at + size], at + size
        else:
            raise CorruptRecord(f"wire type {kind}")
        if at > len(data):
            raise CorruptRecord("field cut short")
        if name and (kind == 0) == (name in numbers):
            try:
                out[name] = value.decode("utf-8") if name in _TEXTS else value
            except UnicodeDecodeError as e:
                raise CorruptRecord(str(e)) from e
    return out


def _number(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode(message: dict, fields: dict[int, str] = FIELDS, numbers: set[str] = _NUMBERS) -> bytes:
    """A framed message; MAX_MESSAGE_BYTES at most."""
    body = bytearray()
    for field, name in fields.items():
        value = message.get(name)
        if name in numbers:
            if value or (name in _OPTIONAL and value is not None):
                body += _number(field << 3) + _number(value)
        elif value or (name in _OPTIONAL and value is not None):
            raw = value.encode() if isinstance(value, str) else bytes(value)
            body += _number(field << 3 | 2) + _number(len(raw)) + raw
    if len(body) > MAX_MESSAGE_BYTES:
        raise ValueError(f"a message of {len(body)} bytes is too large")
    return struct.pack(">i", len(body)) + bytes(body)


def encode_entry(entry: dict) -> bytes:
    """A framed entry of a replicated log (schema.RAFT_ENTRY)."""
    return encode(entry | {"command_type": COMMAND_TYPES.index(entry.get("command_type") or "MESSAGE")}, ENTRY_FIELDS, _ENTRY_NUMBERS)


def records(data: bytes, fields: dict[int, str] = FIELDS, numbers: set[str] = _NUMBERS) -> Iterator[dict]:
    """The messages of a file up to its first bad frame."""
    at = 0
    while at + 4 <= len(data):
        (size,) = struct.unpack_from(">i", data, at)
        if not 0 < size <= MAX_MESSAGE_BYTES or at + 4 + size > len(data):
            return
        try:
            yield decode(data[at + 4 : at + 4 + size], fields, numbers)
        except CorruptRecord:
            return
        at += 4 + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """Messages of all segment files at or below path, with their segment's base and folder; other files are passed over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true").load(path)
    topic_dir = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return decoded(files.select(segment_base(F.col("path")).alias("segment_base"), topic_dir.alias("topic_dir"), "content").where("segment_base is not null and topic_dir not in ('raft', '__consumer_offsets')"))


def encoded(messages: DataFrame) -> DataFrame:
    """segment_base, topic_dir, content of messages (schema.MESSAGE) with segment_base: a row for each segment, whose size is bounded."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset").astype(object).where(rows.notna(), None)
        return pd.DataFrame({"segment_base": [key[1]], "topic_dir": [key[0]], "content": [b"".join(map(encode, rows.to_dict("records")))]})

    return messages.groupBy("topic", "segment_base").applyInPandas(run, "segment_base long, topic_dir string, content binary")


def decoded(segments: DataFrame) -> DataFrame:
    """Messages of segments (segment_base, topic_dir, content), each up to its first bad frame."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for base, folder, content in batch.itertuples(index=False):
                if rows := list(records(bytes(content))):
                    yield pd.DataFrame(rows).assign(segment_base=base, topic_dir=folder)[[c.split()[0] for c in _SCHEMA.split(", ")]]

    return segments.select("segment_base", "topic_dir", "content").mapInPandas(run, _SCHEMA)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries (schema.RAFT_ENTRY) of the replicated logs at or below path, with their file; each up to its first bad or empty frame.

    A log is compacted: it is one file of bounded size. Unknown command types are null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "raft.log").option("recursiveFileLookup", "true").load(path)
    return decoded_entries(files.select(F.col("path").alias("log"), "content"))


def encoded_entries(entries: DataFrame, by: list[str]) -> DataFrame:
    """log, content of entries (log and schema.RAFT_ENTRY): a row for each group of `by`, whose size is bounded; log must be among by."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index").astype(object).where(rows.notna(), None)
        whole = [{k: int(v) if k in _ENTRY_NUMBERS and k != "command_type" and v is not None else v for k, v in r.items()} for r in rows.to_dict("records")]
        return pd.DataFrame({"log": [rows["log"].iloc[0]], "content": [b"".join(map(encode_entry, whole))]})

    return entries.groupBy(*by).applyInPandas(run, "log string, content binary")


def decoded_entries(logs: DataFrame) -> DataFrame:
    """Entries of logs (log, content), see read_entries."""
    columns = [f.name for f in RAFT_ENTRY.fields]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for log, content in batch.itertuples(index=False):
                rows = list(records(bytes(content), ENTRY_FIELDS, _ENTRY_NUMBERS))
                for r in rows:
                    r["command_type"] = COMMAND_TYPES[r["command_type"]] if 0 <= r["command_type"] < len(COMMAND_TYPES) else None
                if rows:
                    found = pd.DataFrame(rows)[columns]
                    yield found.assign(offset_value=found["offset_value"].astype("Int64"), log=log)[["log", *columns]]

    return logs.select("log", "content").mapInPandas(run, T.StructType([T.StructField("log", T.StringType()), *RAFT_ENTRY.fields]))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """current_term, voted_for, last_applied, last_applied_term of a replica's properties file: one row, also where it is empty.

    Missing numbers are 0 and a missing or empty vote is null; a value that is no whole number fails the query.
    """
    line = F.trim("value")
    parts = F.split(line, "=", 2)
    rows = spark.read.text(path).where(~line.rlike("^[#!]") & (F.size(parts) == 2)).select(F.trim(parts[0]).alias("name"), F.trim(parts[1]).alias("text"))
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("text")))
    number = lambda name: F.coalesce(value(name), F.lit("0")).cast("long")
    return rows.agg(
        number("currentTerm").alias("current_term"), F.nullif(value("votedFor"), F.lit("")).alias("voted_for"),
        number("lastApplied").alias("last_applied"), number("lastAppliedTerm").alias("last_applied_term"),
    )


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Committed offsets from a properties file of group/topic=offset; lines without a whole number or two parts say nothing."""
    line = F.trim("value")
    parts = F.split(line, "=", 2)
    names = F.split(F.trim(parts[0]), "/")
    rows = spark.read.text(path).where(~line.rlike("^[#!]") & (F.size(parts) == 2) & (F.size(names) == 2))
    return rows.select(names[0].alias("group"), names[1].alias("topic"), F.trim(parts[1]).try_cast("long").alias("committed")).where("committed is not null")
