"""Scalar column functions of the log model. All stay inside generated code; none is a Python UDF."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schema import DLQ_PREFIX

#: Of a TIMESTAMP_NTZ column, whatever the session's time zone.
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def epoch_ms(ts: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, {_EPOCH}, {ts})")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def round4(x: Column) -> Column:
    return F.round(x, 4)


def mib(n_bytes: Column) -> Column:
    return n_bytes / F.lit(1048576.0)


def text_of(payload: Column) -> Column:
    return F.decode(payload, "UTF-8")


def bytes_of(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def null_if_empty(key: Column) -> Column:
    return F.nullif(key, F.lit(""))


def segment_file(base: Column) -> Column:
    return F.format_string("%020d.log", base)


def segment_base(file_name: Column) -> Column:
    """The base offset that a segment's file name tells; null for other names."""
    found = F.regexp_extract(file_name, r"(?:^|/)(\d{20})\.log$", 1)
    return F.when(found != "", found.cast("long"))


def archive_key(node: Column, topic: Column, file_name: Column) -> Column:
    return F.concat_ws("/", F.lit("archive"), node, topic, file_name)


def dlq_topic(group: Column, topic: Column, prefix: str = DLQ_PREFIX) -> Column:
    return F.concat(F.lit(prefix), group, F.lit("."), topic)


def offset_key(group: Column, topic: Column) -> Column:
    return F.concat_ws("/", group, topic)


def split_offset_key(key: Column) -> tuple[Column, Column]:
    """Group and topic; both null unless there are exactly two parts."""
    parts = F.split(key, "/")
    two = F.size(parts) == 2
    return F.when(two, parts[0]), F.when(two, parts[1])


def lookup(mapping: Column, key: Column, default: int = -1) -> Column:
    return F.coalesce(F.try_element_at(mapping, key), F.lit(default))


def majority(n_peers: Column | int) -> Column:
    """Of a cluster of n_peers and this node."""
    n = F.lit(n_peers) if isinstance(n_peers, int) else n_peers
    return (F.floor((n + 1) / 2) + 1).cast("long")


def log_score(x: Column, decades: int = 4) -> Column:
    """0 to 100 on a scale of so many powers of ten; 0 for what isn't positive."""
    return F.when(x <= 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.log10(x) / decades * 100))


def latency_score(ms: Column, worst: float = 50.0) -> Column:
    return clamp(100 - ms / worst * 100, 0.0, 100.0)


def instant_ms(text: Column) -> Column:
    """Milliseconds of an epoch number or an ISO-8601 instant; null for anything else."""
    return F.coalesce(text.try_cast("long"), F.unix_millis(F.try_to_timestamp(text)))


def addresses(text: Column) -> Column:
    """Array of (id, host, port) of a list of addresses, id:host:port or host:port with the host as id; items of other forms are passed over."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.split(F.trim(x), ":"))
    port = lambda p: F.element_at(p, -1).try_cast("int")
    sound = F.filter(items, lambda p: F.size(p).between(2, 3) & port(p).isNotNull() & ~F.array_contains(p, ""))
    return F.transform(sound, lambda p: F.struct(F.get(p, F.lit(0)).alias("id"), F.get(p, F.size(p) - 2).alias("host"), port(p).alias("port")))


def time_ago(now_ms: Column, then_ms: Column) -> Column:
    seconds = F.floor((now_ms - then_ms) / 1000)
    return F.when(seconds < 5, "just now").when(seconds < 60, F.concat(seconds, F.lit("s ago"))).otherwise(F.concat(F.floor(seconds / 60), F.lit("m ago")))


def pretty_json(text: Column) -> Column:
    """JSON values without white space, members of objects by name; anything else as it is."""
    # The parser passes over what follows a value; within both brackets there is no such place.
    member, element = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))), F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce(F.when(element.isNotNull(), F.to_json(F.variant_get(member, "$.v", "variant"))), text)


def lag_band(lag: Column) -> Column:
    return F.when(lag == 0, "ok").when(lag < 100, "behind").otherwise("far behind")


def replica_band(lag: Column) -> Column:
    return F.when(lag < 0, "offline").when(lag > 10, "warn").otherwise("ok")


def health(has_leader: Column, sync: Column, errors_per_s: Column) -> Column:
    return F.when(~has_leader, "CRITICAL").when((sync < 80) | (errors_per_s > 10), "DEGRADED").otherwise("OPTIMAL")


def up_to_date(term: Column, index: Column, own_term: Column, own_index: Column) -> Column:
    """Whether a log that ends in (term, index) is at least as new as one's own."""
    return (term > own_term) | ((term == own_term) & (index >= own_index))


def varint_bytes(n: Column) -> Column:
    """Bytes of a non-negative base-128 number."""
    return functools.reduce(lambda size, bits: size + F.when(n >= (1 << bits), 1).otherwise(0), range(7, 63, 7), F.lit(1))


def record_bytes(offset: Column, topic: Column, payload: Column, key: Column, timestamp: Column, stored_at: Column) -> Column:
    """Bytes of a framed record: 4 for its length, then tagged fields; zero numbers and empty texts take none."""
    number = lambda x: F.when(F.coalesce(x, F.lit(0)) == 0, 0).otherwise(1 + varint_bytes(x))
    block = lambda n: F.when(n == 0, 0).otherwise(1 + varint_bytes(n) + n)
    size = lambda x: F.coalesce(F.octet_length(x), F.lit(0))
    keyed = F.when(key.isNull(), 0).otherwise(1 + varint_bytes(size(key)) + size(key))
    return (4 + number(offset) + block(size(topic)) + block(size(payload)) + keyed + number(timestamp) + number(stored_at)).cast("long")


# 32-bit arithmetic is done in longs, cut to their low half. Offset and prime of the published FNV-1a hash,
# and what stands in for a seed of 0.
_LOW = 0xFFFFFFFF
_FNV_OFFSET, _FNV_PRIME, _SEED = 2166136261, 16777619, 0x9E3779B9


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a hash of the UTF-16 units of a text, as a long from 0 on; null for null."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), F.floor(F.length(digits) / 4).cast("int") - 1), lambda k: F.conv(F.substring(digits, k * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    step = lambda h, u: (h.bitwiseXOR(u) * _FNV_PRIME).bitwiseAND(F.lit(_LOW))
    start = F.lit(_FNV_OFFSET).cast("long")
    return F.when(F.length(text) == 0, start).when(text.isNotNull(), F.aggregate(units, start, step))


def xorshift32(seed: Column, n: int) -> Column:
    """The first n numbers, 0 to 1, of the xorshift generator (13, 17, 5) that a seed starts, as an array."""
    low = lambda x: x.bitwiseAND(F.lit(_LOW))

    def step(state: Column, _: Column) -> Column:
        a = state["s"].bitwiseXOR(low(F.shiftleft(state["s"], 13)))
        b = a.bitwiseXOR(F.shiftright(a, 17))
        c = b.bitwiseXOR(low(F.shiftleft(b, 5)))
        return F.struct(c.alias("s"), F.concat(state["out"], F.array(c / F.lit(4294967296.0))).alias("out"))

    start = F.struct(F.when(seed == 0, F.lit(_SEED)).otherwise(seed).cast("long").alias("s"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step)["out"] if n > 0 else F.array().cast("array<double>")


def leader_of(error: Column) -> Column:
    """(redirected, host, port) of an error text: whether it says that another node leads, and where, if it tells one address with a port."""
    redirected = F.coalesce(error.startswith("NOT_LEADER:"), F.lit(False))
    at = F.when(redirected, F.regexp_replace(error, "^NOT_LEADER:", ""))
    host, port = F.regexp_extract(at, r"^([^:]*):([+-]?\d+):*$", 1), F.try_to_number(F.regexp_extract(at, r"^([^:]*):[+]?(-?\d+):*$", 2), F.lit("S9999999999")).cast("int")
    known = redirected & at.rlike(r"^[^:]*:[+-]?\d+:*$") & port.isNotNull()
    return F.struct(redirected.alias("redirected"), F.when(known, host).alias("host"), F.when(known, port).alias("port"))


def retry_starts(first_ms: int = 100, most_ms: int = 2000, budget_ms: int = 120_000) -> Column:
    """When attempts start, in ms from the first, if each fails at once: waits double up to most_ms, and none starts beyond the budget."""
    starts, wait = [0], first_ms
    while starts[-1] + wait <= budget_ms:
        starts.append(starts[-1] + wait)
        wait = min(most_ms, 2 * wait)
    return F.array(*map(F.lit, starts)).cast("array<long>")


def election_timeout(seed: Column, low_ms: int = 1000, high_ms: int = 2000, starting: bool = False) -> Column:
    """A wait from low_ms to below high_ms, drawn by a hash of a seed text; three times high_ms at start-up."""
    if starting:
        return F.lit(3 * high_ms).cast("long")
    return low_ms + F.conv(F.substring(F.md5(F.encode(seed, "UTF-8")), 1, 8), 16, 10).cast("long") % (high_ms - low_ms)
