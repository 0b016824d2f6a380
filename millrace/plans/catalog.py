"""Named queries: each applies an operator to whole tables; SQL is DuckDB's.

Bindings: events are messages (sources.fixtures), conversations batches of turns, orders a second
log whose returned lineitems are failed deliveries, nations replicas. Groups g0 to g3 have committed offsets that
are a quarter, a half and three quarters of a topic's head, and none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import scalars as S
from millrace.operators import groups, log, metrics, replica, segments
from millrace.schema import topic_is_valid
from millrace.sources import fixtures, framed, sinks
from millrace.sources.fixtures import messages, table
from millrace.storage import shared_dir
from millrace.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_MESSAGES = """
WITH messages AS (
    SELECT event_id AS "offset", event_type AS topic, CAST(user_id AS VARCHAR) AS key, props AS payload,
        epoch_us(ts) // 1000 AS "timestamp", value, ts, user_id FROM events),
heads AS (SELECT topic, max("offset") AS head FROM messages GROUP BY topic),
seg AS (
    SELECT topic, CAST(floor("offset" / 1000) * 1000 AS BIGINT) AS base, max("timestamp") AS last_modified,
        count(*) AS n_messages, CAST(sum(octet_length(encode(payload))) AS BIGINT) AS n_bytes FROM messages GROUP BY 1, 2),
ranged AS (SELECT *, lead(base) OVER (PARTITION BY topic ORDER BY base) AS next_base FROM seg),
groups AS (
    SELECT 'g' || k AS "group", k, topic, CASE WHEN k = 3 THEN -1 ELSE CAST(floor(head * (k + 1) / 4.0) AS BIGINT) END AS committed
    FROM heads, (SELECT unnest([0, 1, 2, 3]) AS k)),
members AS (SELECT 'g' || (user_id % 4) AS "group", topic, count(DISTINCT user_id) AS members FROM messages WHERE user_id % 4 < 3 GROUP BY 1, 2),
lags AS (
    SELECT g."group", g.topic, committed, coalesce(head, -1) AS head,
        CAST(CASE WHEN coalesce(head, -1) < 0 THEN 0 ELSE greatest(0, head + 1 - greatest(0, committed)) END AS BIGINT) AS lag, coalesce(members, 0) AS members
    FROM groups g LEFT JOIN heads USING (topic) LEFT JOIN members m ON m."group" = g."group" AND m.topic = g.topic),
replicas AS (
    SELECT n_nationkey AS node_id, n_regionkey AS cluster, coalesce(m, 0) AS match_index, coalesce(seen, 0) AS contact_ms
    FROM nation LEFT JOIN (SELECT user_id % 25 AS n, max("offset") AS m, max("timestamp") AS seen FROM messages GROUP BY 1) ON n = n_nationkey)
"""


def query(name: str, sql: str | None = None, plain: bool = False, recursive: bool = False):
    """Registers a query; sql follows the common definitions unless plain."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql if plain else (_MESSAGES.replace("WITH", "WITH RECURSIVE", 1) if recursive else _MESSAGES) + sql
        return f

    return keep


# What several queries start from.


def _committed(spark: SparkSession, d: str) -> DataFrame:
    numbered = log.heads(messages(spark, d)).withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    offset = F.when(F.col("k") == 3, -1).otherwise(F.floor(F.col("head") * (F.col("k") + 1) / 4))
    return numbered.select(F.concat(F.lit("g"), "k").alias("group"), "topic", offset.cast("long").alias("committed"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("key").cast("long")
    rows = messages(spark, d).where(user % 4 < 3)
    return rows.groupBy(F.concat(F.lit("g"), user % 4).alias("group"), "topic").agg(F.countDistinct("key").alias("members"))


def _lags(spark: SparkSession, d: str) -> DataFrame:
    return groups.group_lag(_committed(spark, d), log.heads(messages(spark, d)), _members(spark, d))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.segments(messages(spark, d))


def _replicas(spark: SparkSession, d: str) -> DataFrame:
    seen = messages(spark, d).groupBy((F.col("key").cast("long") % 25).alias("node_id")).agg(F.max("offset").alias("match_index"), F.max("timestamp").alias("contact_ms"))
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_regionkey").cast("long").alias("cluster"))
    return nodes.join(seen, "node_id", "left").na.fill(0, ["match_index", "contact_ms"])


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    """Messages of each topic and hour, and how many there were so far."""
    hours = messages(spark, d).groupBy("topic", F.floor(F.col("timestamp") / 3_600_000).cast("long").alias("tick")).agg(F.count(F.lit(1)).alias("n"))
    return hours.withColumn("total", F.sum("n").over(Window.partitionBy("topic").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)))


_TICKS = """,
hours AS (SELECT topic, "timestamp" // 3600000 AS tick, count(*) AS n FROM messages GROUP BY 1, 2),
ticks AS (SELECT *, CAST(sum(n) OVER (PARTITION BY topic ORDER BY tick) AS BIGINT) AS total FROM hours)
"""
_SINCE = 1_705_276_800_000  # 2024-01-15T00:00:00Z


# 1. Reads.


@query("log_get", """SELECT "offset", topic, key, payload, "timestamp" FROM messages WHERE topic = (SELECT min(topic) FROM messages WHERE "offset" = 500) AND "offset" = 500""")
def log_get(spark, d):
    m = messages(spark, d)
    topic = m.where("offset = 500").agg(F.min("topic")).scalar()
    return log.get(m, topic, 500).select("offset", "topic", "key", "payload", "timestamp")


@query("log_read_from", """SELECT "offset", topic, key, payload, "timestamp" FROM messages WHERE topic = 'purchase' AND "offset" >= 100 ORDER BY "offset" LIMIT 100""")
def log_read_from(spark, d):
    return log.read_from(messages(spark, d), "purchase", 100, 100).select("offset", "topic", "key", "payload", "timestamp")


@query("log_seek_time", f"""SELECT topic, coalesce(min("offset") FILTER ("timestamp" >= {_SINCE}), -1) AS "offset" FROM messages GROUP BY topic""")
def log_seek_time(spark, d):
    return log.seek_time(messages(spark, d), F.lit(_SINCE))


@query("log_read_since", f"""SELECT "offset", key, payload, "timestamp" FROM messages WHERE topic = 'purchase'
    AND "offset" >= (SELECT min("offset") FROM messages WHERE topic = 'purchase' AND "timestamp" >= {_SINCE}) ORDER BY "offset" LIMIT 100""")
def log_read_since(spark, d):
    return log.read_since(messages(spark, d), "purchase", F.lit(_SINCE), 100).select("offset", "key", "payload", "timestamp")


@query("log_poll_multi", """SELECT topic, "offset", payload FROM messages WHERE topic IN ('click', 'view', 'purchase') AND "offset" >= CASE topic WHEN 'click' THEN 0 WHEN 'view' THEN 50 ELSE 200 END
    QUALIFY row_number() OVER (PARTITION BY topic ORDER BY "offset") <= 40""")
def log_poll_multi(spark, d):
    return log.poll(messages(spark, d), {"click": 0, "view": 50, "purchase": 200}, 40).select("topic", "offset", "payload")


@query("log_page_next", """SELECT "offset", payload FROM messages WHERE topic = 'view' AND "offset" >= 301 ORDER BY "offset" LIMIT 25""")
def log_page_next(spark, d):
    return log.next_page(messages(spark, d), "view", 300, 25).select("offset", "payload")


@query("log_inspect", """SELECT "offset", "timestamp", key, coalesce(TRY(CAST(json(payload) AS VARCHAR)), payload) AS payload FROM messages WHERE topic = 'error' AND "offset" >= 10 ORDER BY "offset" LIMIT 100""")
def log_inspect(spark, d):
    m = messages(spark, d).withColumn("payload", S.bytes_of(F.col("payload")))
    return log.inspect(m, "error", 10, 500)


@query("log_payload_bytes", """SELECT topic, CAST(sum(octet_length(encode(payload))) AS BIGINT) AS payload_bytes, count(*) AS n_messages FROM messages GROUP BY topic""")
def log_payload_bytes(spark, d):
    return log.payload_bytes(messages(spark, d))


# 2. Catalogue.


@query("topic_counts", "SELECT topic, count(*) AS n_messages FROM messages GROUP BY topic")
def topic_counts(spark, d):
    return log.topic_counts(messages(spark, d))


@query("topic_heads", "SELECT topic, head FROM heads")
def topic_heads(spark, d):
    return log.heads(messages(spark, d))


@query("next_offset", """SELECT coalesce(max("offset") + 1, 0) AS next_offset FROM messages""")
def next_offset(spark, d):
    return log.next_offset(messages(spark, d))


@query("topic_names", "SELECT DISTINCT topic FROM messages")
def topic_names(spark, d):
    return log.topic_names(messages(spark, d))


@query("cached_messages", "SELECT CAST(coalesce(sum(least(n, 1000)), 0) AS BIGINT) AS cached FROM (SELECT count(*) AS n FROM messages GROUP BY topic)")
def cached_messages(spark, d):
    return log.cached_messages(messages(spark, d))


@query("sparse_index", """SELECT topic, "offset" FROM messages WHERE "offset" % 100 = 0 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY "offset" DESC) <= 50""")
def sparse_index(spark, d):
    return log.sparse_index(messages(spark, d), every=100, kept=50)


@query("topic_name_valid", """SELECT p_name AS topic, count(*) AS n, regexp_full_match(p_name, '[A-Za-z0-9._-]+') AND p_name NOT IN ('.', '..', 'raft', '__consumer_offsets') AS valid FROM part GROUP BY p_name
    UNION ALL SELECT c_mktsegment, count(*), regexp_full_match(c_mktsegment, '[A-Za-z0-9._-]+') FROM customer GROUP BY c_mktsegment""", plain=True)
def topic_name_valid(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    more = table(spark, d, "customer").select(F.col("c_mktsegment").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return names.unionByName(more).withColumn("valid", topic_is_valid(F.col("topic")))


# 3. Offsets of new messages.


@query("assign_offsets", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 + (SELECT max(event_id) + 1 FROM events) AS "offset" FROM orders""", plain=True)
def assign_offsets(spark, d):
    base = log.next_offset(messages(spark, d)).first()[0]
    return log.assign_offsets(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], base).select("o_orderkey", "offset")


@query("batch_offsets", """SELECT conv_id, turn, min(o) OVER (PARTITION BY conv_id) AS base_offset, o AS "offset" FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS o FROM conversations)""", plain=True)
def batch_offsets(spark, d):
    return log.batch_offsets(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn").select("conv_id", "turn", "base_offset", "offset")


@query("merged_proposal_offsets", """,
p AS (SELECT event_id AS seq, CAST(floor(event_id / 512) AS BIGINT) AS win, event_type AS topic, 1 + user_id % 5 AS n FROM events),
b AS (SELECT win, topic, sum(n) AS size FROM p GROUP BY 1, 2),
bb AS (SELECT win, topic, coalesce(sum(size) OVER (ORDER BY win, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS batch_base FROM b)
SELECT seq, CAST(batch_base + coalesce(sum(n) OVER (PARTITION BY win, topic ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base_offset FROM p JOIN bb USING (win, topic)""")
def merged_proposal_offsets(spark, d):
    p = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 512).alias("win"), F.col("event_type").alias("topic"), (1 + F.col("user_id") % 5).alias("n"))
    return log.merged_proposals(p, "win", "topic", "seq", "n").select("seq", "base_offset")


@query("atomic_base_offsets", """SELECT conv_id AS request, role AS topic, n AS n_entries, CAST(coalesce(sum(n) OVER (ORDER BY conv_id, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base_offset
FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2)""", plain=True)
def atomic_base_offsets(spark, d):
    slices = table(spark, d, "conversations").select(F.col("conv_id").alias("request"), F.col("role").alias("topic"), F.lit(1).alias("n"))
    return log.atomic_bases(slices, "request", "topic", "n")


@query("batch_limits", """SELECT conv_id, count(*) AS n_entries, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes, count(*) <= 6 AND sum(octet_length(encode(text))) <= 4000 AS accepted FROM conversations GROUP BY 1""", plain=True)
def batch_limits(spark, d):
    return log.batch_verdicts(table(spark, d, "conversations"), "conv_id", "text", most=6, most_bytes=4000)


# 4. Segments.


@query("segment_of_offset", """SELECT m.topic, m."offset", s.base FROM messages m ASOF LEFT JOIN seg s ON m.topic = s.topic AND m."offset" >= s.base""")
def segment_of_offset(spark, d):
    return segments.floor_segment(messages(spark, d).select("topic", "offset"), _segments(spark, d))


@query("next_segment_in_gap", """SELECT m.topic, m."offset", coalesce(s.base, -1) AS base FROM messages m ASOF LEFT JOIN seg s ON m.topic = s.topic AND m."offset" < s.base""")
def next_segment_in_gap(spark, d):
    return segments.next_segment(messages(spark, d).select("topic", "offset"), _segments(spark, d), bucket=3000).na.fill(-1, ["base"])


@query("segment_ranges", "SELECT topic, base, coalesce(next_base, -1) AS next_base, n_messages, n_bytes FROM ranged")
def segment_ranges(spark, d):
    return segments.ranges(_segments(spark, d)).na.fill(-1, ["next_base"]).select("topic", "base", "next_base", "n_messages", "n_bytes")


@query("retention_expired", f"SELECT topic, base, last_modified FROM ranged WHERE next_base IS NOT NULL AND last_modified < {_SINCE}")
def retention_expired(spark, d):
    week = 7 * 24 * 3600 * 1000
    return segments.expired(_segments(spark, d), F.lit(_SINCE + week), week).select("topic", "base", "last_modified")


@query("archive_union", """SELECT topic, "offset", payload, CASE WHEN "offset" >= (SELECT max("offset") // 2 FROM messages) THEN 'hot' ELSE 'archive' END AS tier FROM messages""")
def archive_union(spark, d):
    m = messages(spark, d).select("topic", "offset", "payload")
    middle = m.agg(F.expr("max(offset) div 2")).scalar()
    hot = m.where(F.col("offset") >= middle).withColumn("tier", F.lit("hot"))
    archived = m.where(F.col("offset") < middle + 500).withColumn("tier", F.lit("archive"))
    return segments.with_archive(hot, archived)


@query("catchup_segments", """SELECT r.topic, base, coalesce(next_base, -1) AS next_base, coalesce(committed, -1) AS follower_offset FROM ranged r LEFT JOIN (SELECT topic, committed FROM groups WHERE k = 1 AND topic <> 'view') USING (topic)
    WHERE next_base IS NULL OR next_base > coalesce(committed, -1)""")
def catchup_segments(spark, d):
    follower = _committed(spark, d).where("group = 'g1' and topic <> 'view'").select("topic", F.col("committed").alias("follower_offset"))
    return segments.catch_up(_segments(spark, d), follower).na.fill(-1, ["next_base"]).select("topic", "base", "next_base", "follower_offset")


# A record is 4 bytes of length and a message of six tagged fields: numbers in base 128, texts behind their length.
_RECORDS = """,
record AS (
    SELECT topic, "offset", 4 + CASE WHEN "offset" = 0 THEN 0 ELSE 1 + CAST(ceil(len(ltrim(bin("offset"), '0')) / 7.0) AS BIGINT) END
        + 2 + octet_length(encode(topic)) + 2 + octet_length(encode(payload)) + 2 + octet_length(encode(key))
        + 2 * (1 + CAST(ceil(len(ltrim(bin("timestamp"), '0')) / 7.0) AS BIGINT)) AS n_bytes FROM messages),
sized AS (
    SELECT *, row_number() OVER w AS rn, CAST(sum(n_bytes) OVER w AS BIGINT) - n_bytes AS before
    FROM record WINDOW w AS (PARTITION BY topic ORDER BY "offset" ROWS UNBOUNDED PRECEDING))
"""


def _record_sizes(spark, d):
    m = messages(spark, d)
    size = S.record_bytes(F.col("offset"), F.col("topic"), F.col("payload"), F.col("key"), F.col("timestamp"), F.col("timestamp"))
    return m.select("topic", "offset", size.alias("n_bytes"))


@query("record_sizes", _RECORDS + """SELECT topic, "offset", n_bytes FROM record""")
def record_sizes(spark, d):
    return _record_sizes(spark, d)


@query("segment_roll", _RECORDS + """,
starts AS (
    SELECT topic, 1::BIGINT AS rn, 0::BIGINT AS base, 0::BIGINT AS before FROM heads
    UNION ALL
    SELECT s.topic, min(z.rn), arg_min(z."offset", z.rn), min(z.before) FROM starts s JOIN sized z ON z.topic = s.topic AND z.before >= s.before + 2000 GROUP BY s.topic),
spans AS (SELECT *, coalesce(lead(rn) OVER (PARTITION BY topic ORDER BY rn), 9223372036854775807) AS until FROM starts)
SELECT z.topic, z."offset", z.n_bytes, s.base AS segment_base FROM sized z JOIN spans s ON s.topic = z.topic AND z.rn >= s.rn AND z.rn < s.until""", recursive=True)
def segment_roll(spark, d):
    return segments.roll(_record_sizes(spark, d), limit=2000)


def _stored(spark, d):
    """Messages as a segment file holds them: the payload as bytes, each segment a thousand global offsets."""
    m = messages(spark, d).withColumn("payload", S.bytes_of(F.col("payload"))).withColumn("stored_at", F.col("timestamp"))
    return m.select("offset", "topic", "payload", "key", "timestamp", "stored_at", F.expr("offset div 1000 * 1000").alias("segment_base"))


@query("framed_segments", """SELECT "offset" // 1000 * 1000 AS segment_base, topic AS topic_dir, topic, "offset", payload, key, "timestamp", "timestamp" AS stored_at FROM messages""")
def framed_segments(spark, d):
    """Messages framed into segments and recovered from them."""
    found = framed.decoded(framed.encoded(_stored(spark, d)))
    return found.withColumn("payload", S.text_of(F.col("payload")))


@query("framed_damage", """,
cut AS (SELECT topic, "offset" // 1000 * 1000 AS segment_base, count(*) AS n FROM messages GROUP BY 1, 2)
SELECT topic, segment_base, n - 1 AS n_messages FROM cut WHERE n > 1""")
def framed_damage(spark, d):
    """Segments whose last byte is lost: recovery ends before the last record."""
    torn = framed.encoded(_stored(spark, d)).withColumn("content", F.expr("substring(content, 1, octet_length(content) - 1)"))
    return framed.decoded(torn).groupBy("topic", "segment_base").agg(F.count(F.lit(1)).alias("n_messages"))


@query("offsets_file", """SELECT "group", topic, committed FROM groups""")
def offsets_file(spark, d):
    """Committed offsets written as an offsets file, beside lines that say nothing, and read back."""
    line = F.concat(S.offset_key(F.col("group"), F.col("topic")), F.lit("="), F.col("committed"))
    rows = _committed(spark, d).select(line.alias("value"))
    odd = spark.createDataFrame([("# made by a broker",), ("g0/click=seven",), ("no offset",), ("g0=5",)], "value string")
    rows.unionByName(odd).write.text(path := _fresh(spark, "offsets"))
    return framed.read_offsets(spark, path)


@query("offsets_table", """SELECT "group", topic, CASE WHEN topic = 'click' THEN 3 WHEN k = 0 THEN committed + 1 ELSE committed END AS committed FROM groups""")
def offsets_table(spark, d):
    """Snapshots of committed offsets, each replacing the one before whole: later commits count, even where they go back."""
    kept = sinks.VersionedTable(spark, _fresh(spark, "offsets"))
    first = _committed(spark, d)
    sinks.commit_offsets(kept, first)
    sinks.commit_offsets(kept, first.where(F.col("group") == "g0").withColumn("committed", F.col("committed") + 1))
    sinks.commit_offsets(kept, first.where("topic = 'click'").withColumn("committed", F.lit(3).cast("long")))
    return kept.read("group string, topic string, committed long")


# 5. Groups.


@query("group_lag", """SELECT "group", topic, committed, head, lag, members FROM lags""")
def group_lag(spark, d):
    return _lags(spark, d)


@query("group_message_lag", """SELECT g."group", g.topic, count(m."offset") AS message_lag FROM groups g LEFT JOIN messages m ON m.topic = g.topic AND m."offset" >= greatest(0, committed) GROUP BY 1, 2""")
def group_message_lag(spark, d):
    return groups.message_lag(_committed(spark, d), messages(spark, d))


@query("consumer_groups", """SELECT "group", count(*) AS n_topics, CAST(sum(lag) AS BIGINT) AS lag, string_agg(topic || ':' || head || ':' || committed || ':' || lag || ':' || members, ',' ORDER BY topic) AS topics FROM lags GROUP BY 1""")
def consumer_groups(spark, d):
    nested = groups.consumer_groups(_lags(spark, d))
    line = lambda t: F.concat_ws(":", t["topic"], t["head"], t["committed"], t["lag"], t["members"])
    total = F.aggregate("topics", F.lit(0).cast("long"), lambda a, t: a + t["lag"])
    return nested.select("group", F.size("topics").cast("long").alias("n_topics"), total.alias("lag"), F.array_join(F.transform("topics", line), ",").alias("topics"))


@query("dispatch_chunks", """SELECT topic, CAST(floor((n - 1) / 50) AS BIGINT) AS chunk, min("offset") AS from_offset, max("offset") + 1 AS to_offset, count(*) AS n_messages
    FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY "offset") AS n FROM messages) GROUP BY 1, 2""")
def dispatch_chunks(spark, d):
    return groups.dispatch_chunks(messages(spark, d), 50)


_RANGES = """,
ranges AS (SELECT 'g' || (user_id % 3) AS "group", topic, "offset" // 8 * 8 AS from_offset, "offset" // 8 * 8 + 8 + user_id % 5 AS to_offset FROM messages WHERE "offset" // 8 % 97 <> 96)
"""


def _commit_ranges(spark, d):
    low = F.expr("offset div 8 * 8")
    rows = messages(spark, d).where("offset div 8 % 97 <> 96")
    user = F.col("key").cast("long")
    return rows.select(F.concat(F.lit("g"), user % 3).alias("group"), "topic", low.alias("from_offset"), (low + 8 + user % 5).alias("to_offset"))


@query("commit_coalesce", _RANGES + """,
all_ranges AS (SELECT "group", topic, -1 AS from_offset, -1 AS to_offset FROM (SELECT DISTINCT "group", topic FROM ranges) UNION ALL SELECT * FROM ranges),
gaps AS (SELECT *, CASE WHEN from_offset > greatest(0, max(to_offset) OVER (PARTITION BY "group", topic ORDER BY from_offset, to_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) THEN 1 ELSE 0 END AS gap FROM all_ranges),
islands AS (SELECT *, sum(gap) OVER (PARTITION BY "group", topic ORDER BY from_offset, to_offset ROWS UNBOUNDED PRECEDING) AS island FROM gaps)
SELECT "group", topic, CAST(max(to_offset) AS BIGINT) AS committed FROM islands WHERE island = 0 GROUP BY 1, 2""")
def commit_coalesce(spark, d):
    ranges = _commit_ranges(spark, d)
    unset = ranges.select("group", "topic").distinct().withColumn("committed", F.lit(-1).cast("long"))
    return groups.coalesce_ranges(unset, ranges)


@query("latest_offset", """SELECT 'g' || (user_id % 5) AS "group", topic, arg_max("offset" // 3 + user_id, "offset") AS committed FROM messages GROUP BY 1, 2""")
def latest_offset(spark, d):
    user = F.col("key").cast("long")
    commits = messages(spark, d).select(F.concat(F.lit("g"), user % 5).alias("group"), "topic", (F.expr("offset div 3") + user).alias("offset"), F.col("offset").alias("seq"))
    return groups.latest_offsets(commits)


@query("dlq_route", """SELECT 'dlq.returns.orders' AS dlq_topic, o_orderkey AS "offset", o_orderpriority AS key, count(*) AS attempts FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2, 3 HAVING count(*) >= 5""", plain=True)
def dlq_route(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    nacks = returned.select(F.lit("returns").alias("group"), F.lit("orders").alias("topic"), F.col("l_orderkey").alias("offset"))
    orders = table(spark, d, "orders").select(F.lit("orders").alias("topic"), F.col("o_orderkey").alias("offset"), F.col("o_orderpriority").alias("key"), F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("long").alias("timestamp"))
    return groups.dead_letters(nacks, orders).select("dlq_topic", "offset", "key", "attempts")


@query("group_fanout", """SELECT g."group", topic, count(*) AS n_messages, CAST(sum("offset") AS BIGINT) AS offset_sum FROM (SELECT DISTINCT "group" FROM groups) g, messages GROUP BY 1, 2""")
def group_fanout(spark, d):
    """Every group sees every message of its topics; what reaches each is counted."""
    seen = groups.fan_out(messages(spark, d).select("topic", "offset"), _committed(spark, d))
    return seen.groupBy("group", "topic").agg(F.count(F.lit(1)).alias("n_messages"), F.sum("offset").cast("long").alias("offset_sum"))


@query("group_disjoint", """,
chunks AS (SELECT topic, min("offset") AS low, max("offset") + 1 AS high FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY "offset") AS n FROM messages) GROUP BY topic, (n - 1) // 50),
held AS (SELECT m.topic, m."offset", count(c.low) AS times FROM messages m LEFT JOIN chunks c ON c.topic = m.topic AND m."offset" >= c.low AND m."offset" < c.high GROUP BY 1, 2)
SELECT topic, count(*) FILTER (times > 0) AS delivered, count(*) FILTER (times > 1) AS twice, count(*) FILTER (times = 0) AS missing FROM held GROUP BY topic""")
def group_disjoint(spark, d):
    """Chunks are disjoint and complete: messages that are in none, or in two that follow each other."""
    m = messages(spark, d)
    chunks = groups.dispatch_chunks(m, 50)
    found = segments.floor_segment(m.select("topic", "offset"), chunks.select("topic", F.col("from_offset").alias("base")))
    held = found.join(chunks.select("topic", F.col("from_offset").alias("base"), "to_offset"), ["topic", "base"], "left")
    late = F.lag("to_offset").over(Window.partitionBy("topic").orderBy("from_offset")) > F.col("from_offset")
    overlaps = chunks.groupBy("topic").agg(F.count(F.lit(1)).alias("chunks")).join(chunks.withColumn("late", late).where("late").groupBy("topic").agg(F.count(F.lit(1)).alias("twice")), "topic", "left")
    inside = F.col("to_offset") > F.col("offset")
    counts = held.groupBy("topic").agg(F.count(F.when(inside, 1)).alias("delivered"), F.count(F.when(~F.coalesce(inside, F.lit(False)), 1)).alias("missing"))
    return counts.join(overlaps, "topic").select("topic", "delivered", F.coalesce("twice", F.lit(0)).cast("long").alias("twice"), "missing")


@query("lease_redelivery", """,
leases AS (SELECT topic, 'c' || chunk AS consumer, from_offset, to_offset, chunk * 1000 AS expires_at FROM (
    SELECT topic, CAST(floor((n - 1) / 50) AS BIGINT) AS chunk, min("offset") AS from_offset, max("offset") + 1 AS to_offset
    FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY "offset") AS n FROM messages) GROUP BY 1, 2))
SELECT 'g0' AS "group", m.topic, consumer, m."offset" FROM leases l JOIN messages m ON m.topic = l.topic AND m."offset" >= from_offset AND m."offset" < to_offset WHERE expires_at <= 5000""")
def lease_redelivery(spark, d):
    chunks = groups.dispatch_chunks(messages(spark, d), 50)
    leases = chunks.select(F.lit("g0").alias("group"), "topic", F.concat(F.lit("c"), "chunk").alias("consumer"), "from_offset", "to_offset", (F.col("chunk") * 1000).alias("expires_at"))
    return groups.redeliveries(leases, messages(spark, d), F.lit(5000))


def commands(spark: SparkSession, d: str) -> DataFrame:
    """A command table made from events: two consumers a group acquire, commit, fail and expire by turns."""
    kinds = ["acquire", "commit", "acquire", "nack", "expire"]
    e = table(spark, d, "events")
    turn = F.expr("cast(event_id % 5 as int)")
    op = F.element_at(F.array(*map(F.lit, kinds)), turn + 1)
    near = F.expr("event_id - event_id % 11")
    return e.select(
        F.col("event_id").alias("seq"), (F.col("event_id") * 100).alias("at_ms"), F.concat(F.lit("g"), F.col("user_id") % 3).alias("group"), F.col("event_type").alias("topic"),
        F.concat(F.lit("c"), F.col("user_id") % 2).alias("consumer"), op.alias("op"), F.when(op == "acquire", 5).alias("n"), F.when(op.isin("commit", "nack"), near).alias("offset"),
    )


# 6. Stateful groups.


@query("group_replay")
def group_replay(spark, d):
    return groups.replay(commands(spark, d), messages(spark, d), lease_ms=30_000, most=3)


# 7. Telemetry.


def _requests(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("type"), (F.col("user_id") % 10 != 0).alias("ok"), F.octet_length("props").cast("long").alias("n_bytes"), (F.col("user_id") % 4).alias("n_records"), "value")


@query("request_counters", """SELECT event_type AS type, user_id % 10 <> 0 AS ok, count(*) AS n_requests, CAST(sum(octet_length(encode(props))) AS BIGINT) AS n_bytes, CAST(sum(user_id % 4) AS BIGINT) AS n_records FROM events GROUP BY 1, 2""", plain=True)
def request_counters(spark, d):
    return metrics.request_counters(_requests(spark, d))


@query("mean_latency", "SELECT event_type AS type, round(avg(value), 4) AS mean FROM events GROUP BY 1", plain=True)
def mean_latency(spark, d):
    return metrics.mean_latency(_requests(spark, d))


@query("throughput", """SELECT count(*) AS n_records, CAST(sum(octet_length(encode(payload))) AS BIGINT) AS n_bytes, round(count(*) / s, 4) AS records_s, round(sum(octet_length(encode(payload))) / 1048576.0 / s, 4) AS mib_s
FROM messages, (SELECT (max("timestamp") - min("timestamp")) / 1000.0 AS s FROM messages) GROUP BY s""")
def throughput(spark, d):
    m = messages(spark, d).withColumn("n_bytes", F.octet_length("payload"))
    return metrics.throughput(m, (F.max("timestamp") - F.min("timestamp")) / 1000.0)


@query("latency_percentiles", """SELECT event_type AS type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95,
    percentile_disc(0.99) WITHIN GROUP (ORDER BY value) AS p99, percentile_disc(0.999) WITHIN GROUP (ORDER BY value) AS p999, round(avg(value), 4) AS mean, max(value) AS max FROM events GROUP BY 1""", plain=True)
def latency_percentiles(spark, d):
    return metrics.latency_percentiles(_requests(spark, d))


@query("rates", _TICKS + "SELECT topic, tick, total, CAST(coalesce(greatest(0, total - lag(total) OVER (PARTITION BY topic ORDER BY tick)), 0) AS BIGINT) AS rate FROM ticks")
def rates(spark, d):
    return metrics.rates(_ticks(spark, d).select("topic", "tick", "total"), "total", ["topic"])


@query("ring_history", _TICKS + """SELECT topic, tick, n, CAST(sum(n) OVER w AS BIGINT) AS ring_sum, count(*) OVER w AS ring_filled FROM ticks WINDOW w AS (PARTITION BY topic ORDER BY tick ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)""")
def ring_history(spark, d):
    return metrics.ring_history(_ticks(spark, d).select("topic", "tick", "n"), "n", ["topic"])


@query("history_slice", _TICKS + "SELECT topic, tick, n FROM ticks QUALIFY row_number() OVER (PARTITION BY topic ORDER BY tick DESC) <= 30")
def history_slice(spark, d):
    return metrics.history_slice(_ticks(spark, d).select("topic", "tick", "n"), ["topic"])


@query("recent_events", "SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50", plain=True)
def recent_events(spark, d):
    return metrics.recent_events(table(spark, d, "events").select("event_id", "event_type", "user_id", "ts")).select("event_id", "event_type", "user_id")


@query("merge_events", """,
told AS (SELECT CAST(user_id AS BIGINT) % 5 AS node_id, "offset" % 200 AS id, topic AS type, "offset" AS seq FROM messages)
SELECT node_id, id, arg_max(type, seq) AS type, max(seq) AS seq FROM told GROUP BY 1, 2""")
def merge_events(spark, d):
    m = messages(spark, d)
    told = m.select((F.col("key").cast("long") % 5).alias("node_id"), (F.col("offset") % 200).alias("id"), F.col("topic").alias("type"), F.col("offset").alias("seq"))
    return metrics.merge_events(told)


_SPLIT = """,
t AS (SELECT topic, count(DISTINCT user_id) AS connections, count(*) FILTER (user_id % 3 = 0) AS produced, count(*) FILTER (user_id % 3 > 0) AS consumed FROM messages GROUP BY 1),
p AS (SELECT *, greatest(CASE WHEN produced > 0 AND connections > 0 THEN 1 ELSE 0 END, CAST(round(connections * CASE WHEN produced + consumed > 0 THEN produced / (produced + consumed) ELSE 0.5 END) AS BIGINT)) AS producers FROM t)
SELECT topic, connections, produced, consumed, producers, greatest(CASE WHEN consumed > 0 AND connections > 0 THEN 1 ELSE 0 END, connections - producers) AS consumers FROM p"""


@query("connection_split", _SPLIT)
def connection_split(spark, d):
    user = F.col("key").cast("long")
    totals = messages(spark, d).groupBy("topic").agg(F.countDistinct("key").alias("connections"), F.count(F.when(user % 3 == 0, 1)).alias("produced"), F.count(F.when(user % 3 > 0, 1)).alias("consumed"))
    return metrics.connection_split(totals)


@query("radar_scores", """SELECT event_type AS type, round(least(100.0, log10(count(*)) / 4 * 100), 4) AS volume_score, round(greatest(0.0, least(100.0, 100 - avg(value) / 50 * 100)), 4) AS latency_score FROM events GROUP BY 1""", plain=True)
def radar_scores(spark, d):
    return metrics.radar_scores(_requests(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n_messages"), F.avg("value").alias("mean_ms")))


_DAYS = """,
days AS (SELECT "timestamp" // 86400000 AS day, topic, count(*) AS n FROM messages GROUP BY 1, 2)
"""


def _days(spark, d):
    return messages(spark, d).groupBy(F.expr("timestamp div 86400000").alias("day"), "topic").agg(F.count(F.lit(1)).alias("n"))


@query("stack_bands", _DAYS + "SELECT day, topic, n, CAST(sum(n) OVER w - n AS DOUBLE) AS y0, CAST(sum(n) OVER w AS DOUBLE) AS y1 FROM days WINDOW w AS (PARTITION BY day ORDER BY topic)")
def stack_bands(spark, d):
    return metrics.stack_bands(_days(spark, d), "day", "topic", "n")


@query("stack_bands_percent", _DAYS + """SELECT day, topic, n, round((sum(n) OVER w - n) / sum(n) OVER (PARTITION BY day), 4) AS y0, round(sum(n) OVER w / sum(n) OVER (PARTITION BY day), 4) AS y1
FROM days WINDOW w AS (PARTITION BY day ORDER BY topic)""")
def stack_bands_percent(spark, d):
    return metrics.stack_bands(_days(spark, d), "day", "topic", "n", percent=True)


@query("chart_domain", _DAYS + "SELECT CAST(0 AS DOUBLE) AS low, CAST(max(s) AS DOUBLE) AS high FROM (SELECT sum(n) AS s FROM days GROUP BY day)")
def chart_domain(spark, d):
    return metrics.domain(metrics.stack_bands(_days(spark, d), "day", "topic", "n"))


@query("pie_share", """,
s AS (SELECT topic, count(*) / sum(count(*)) OVER () AS share FROM messages GROUP BY topic),
u AS (SELECT *, sum(share) OVER (ORDER BY topic) AS upto FROM s)
SELECT topic, round(share, 4) AS share, round((upto - share) * 2 * pi() - pi() / 2, 4) AS start_angle, round((upto - share / 2) * 2 * pi() - pi() / 2, 4) AS mid_angle, round(upto * 2 * pi() - pi() / 2, 4) AS end_angle FROM u""")
def pie_share(spark, d):
    return metrics.pie(log.topic_counts(messages(spark, d)), "topic", "n_messages")


@query("resample", _DAYS + """,
v AS (SELECT topic, list(CAST(n AS DOUBLE) ORDER BY day) AS v FROM days GROUP BY topic),
p AS (SELECT topic, v, i, i * (len(v) - 1) / 19.0 AS x FROM v, (SELECT unnest(range(20)) AS i)),
q AS (SELECT topic, v, i, x, CAST(floor(x) AS INTEGER) AS low FROM p)
SELECT topic, CAST(i AS BIGINT) AS i, round(v[low + 1] + (v[least(low + 2, len(v))] - v[low + 1]) * (x - low), 4) AS point FROM q""")
def resample(spark, d):
    series = _days(spark, d).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("s"))
    points = metrics.resample(series.select("topic", F.transform("s", lambda x: x["n"].cast("double")).alias("v")), "v", 20)
    return points.select("topic", F.posexplode("points").alias("i", "point")).withColumn("i", F.col("i").cast("long"))


@query("lag_bands", """SELECT "group", topic, lag, CASE WHEN lag = 0 THEN 'ok' WHEN lag < 100 THEN 'behind' ELSE 'far behind' END AS band FROM lags""")
def lag_bands(spark, d):
    return _lags(spark, d).select("group", "topic", "lag", S.lag_band(F.col("lag")).alias("band"))


@query("scalar_texts", """SELECT topic, 'dlq.g0.' || topic AS dlq_topic, 'g0/' || topic AS offset_key, lpad(CAST(head AS VARCHAR), 20, '0') || '.log' AS segment_file, head AS segment_base,
    'archive/n1/' || topic || '/' || lpad(CAST(head AS VARCHAR), 20, '0') || '.log' AS archive_key, CAST(CAST(floor(head % 90) AS BIGINT) AS VARCHAR) AS age FROM heads""")
def scalar_texts(spark, d):
    h, t = F.col("head"), F.col("topic")
    file = S.segment_file(h)
    out = log.heads(messages(spark, d)).select("topic", S.dlq_topic(F.lit("g0"), t).alias("dlq_topic"), S.offset_key(F.lit("g0"), t).alias("offset_key"), file.alias("segment_file"), S.segment_base(file).alias("segment_base"), S.archive_key(F.lit("n1"), t, file).alias("archive_key"), F.floor(h % 90).cast("string").alias("age"))
    return out


@query("scalar_times", f"""SELECT "offset", CASE "offset" % 3 WHEN 2 THEN NULL ELSE "timestamp" // 1000 * 1000 END AS instant,
    CASE WHEN ({_SINCE} - "timestamp") < 5000 THEN 'just now' WHEN ({_SINCE} - "timestamp") < 60000 THEN (({_SINCE} - "timestamp") // 1000) || 's ago' ELSE (({_SINCE} - "timestamp") // 60000) || 'm ago' END AS ago,
    CASE WHEN "offset" % 4 = 0 THEN NULL ELSE key END AS key FROM messages""")
def scalar_times(spark, d):
    whole = F.expr("timestamp div 1000 * 1000")
    iso = F.date_format(F.timestamp_millis(whole), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(F.col("offset") % 3 == 0, whole.cast("string")).when(F.col("offset") % 3 == 1, iso).otherwise("next week")
    key = S.null_if_empty(F.when(F.col("offset") % 4 == 0, F.lit("")).otherwise(F.col("key")))
    return messages(spark, d).select("offset", S.instant_ms(text).alias("instant"), S.time_ago(F.lit(_SINCE), F.col("timestamp")).alias("ago"), key.alias("key"))


@query("address_lists", """SELECT node_id, 'n' || node_id AS id, 'host' || cluster AS host, CAST(9000 + node_id AS INTEGER) AS port FROM replicas
UNION ALL SELECT node_id, 'seed' || cluster, 'seed' || cluster, 9092 FROM replicas""")
def address_lists(spark, d):
    n, c = F.col("node_id").cast("string"), F.col("cluster").cast("string")
    text = F.concat(F.lit("n"), n, F.lit(":host"), c, F.lit(":"), (9000 + F.col("node_id")).cast("string"), F.lit(", seed"), c, F.lit(":9092,bad,host:port,a:b:c:1,,:7"))
    return _replicas(spark, d).select("node_id", F.inline(S.addresses(text)))


# 8. Replicas.


@query("quorum_commit", """SELECT cluster, match_index AS commit_index FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY match_index DESC) AS n, count(*) OVER (PARTITION BY cluster) AS c FROM replicas) WHERE n = c // 2 + 1""")
def quorum_commit(spark, d):
    return replica.quorum_commit(_replicas(spark, d), ["cluster"])


@query("follower_sync", """,
c AS (SELECT max("offset") AS commit FROM messages),
l AS (SELECT node_id, CASE WHEN node_id % 6 = 5 THEN 0 ELSE match_index END AS match_index FROM replicas),
g AS (SELECT *, greatest(0, commit - match_index) AS lag FROM l, c)
SELECT node_id, match_index, CAST(lag AS BIGINT) AS lag, CAST(greatest(0, least(100, 100 - floor(max(lag) OVER () * 100 / 1000))) AS BIGINT) AS sync FROM g""")
def follower_sync(spark, d):
    nodes = _replicas(spark, d)
    commit = messages(spark, d).agg(F.max("offset")).first()[0]
    return replica.follower_sync(nodes.select("node_id"), nodes.where("node_id % 6 <> 5").select("node_id", "match_index"), commit)


@query("replica_message_lag", """,
c AS (SELECT max("offset") AS commit FROM messages),
f AS (SELECT node_id, CASE WHEN node_id % 7 = 6 THEN NULL ELSE greatest(0, match_index - node_id * 150) END AS match_index FROM replicas)
SELECT node_id, coalesce(match_index, -1) AS match_index, CAST(CASE WHEN match_index IS NULL THEN -1 WHEN commit - match_index <= 0 THEN 0
    WHEN commit - match_index <= 2000 THEN (SELECT coalesce(sum(1 + user_id % 5), 0) FROM messages m WHERE m."offset" > f.match_index AND m."offset" <= commit)
    ELSE floor((commit - match_index) * 50.0) END AS BIGINT) AS message_lag FROM f, c""")
def replica_message_lag(spark, d):
    m = messages(spark, d)
    commit = m.agg(F.max("offset")).first()[0]
    behind = F.greatest(F.lit(0), F.col("match_index") - F.col("node_id") * 150)
    followers = _replicas(spark, d).select("node_id", F.when(F.col("node_id") % 7 != 6, behind).alias("match_index"))
    return replica.message_lag(followers, m.select(F.col("offset").alias("index"), (1 + F.col("key").cast("long") % 5).alias("batch_size")), commit).na.fill(-1, ["match_index"]).select("node_id", "match_index", "message_lag")


@query("health", """SELECT node_id, CASE WHEN node_id % 5 = 4 THEN 'CRITICAL' WHEN match_index % 100 < 80 OR node_id % 13 > 10 THEN 'DEGRADED' ELSE 'OPTIMAL' END AS health FROM replicas""")
def health(spark, d):
    n = F.col("node_id")
    return _replicas(spark, d).select("node_id", S.health(n % 5 != 4, F.col("match_index") % 100, n % 13).alias("health"))


_REPORTS = """
WITH r AS (SELECT s_nationkey % 5 AS reporter, s_suppkey % 5 AS node_id, max(s_suppkey) AS k FROM supplier GROUP BY 1, 2),
reports AS (SELECT CAST(reporter AS BIGINT) AS reporter, node_id, CASE WHEN k % 3 = 0 THEN 'LEADER' ELSE 'FOLLOWER' END AS state, k % 11 AS term, k % 13 AS lag FROM r),
l AS (SELECT arg_max(reporter, term * 1000 + reporter) AS leader FROM reports WHERE reporter = node_id AND state = 'LEADER'),
t AS (SELECT max(term) AS top FROM reports),
b AS (
    SELECT node_id, arg_max(state, (CASE WHEN reporter = node_id THEN 1 ELSE 0 END) * 1000000 + term * 1000 + reporter) AS state,
        arg_max(term, (CASE WHEN reporter = node_id THEN 1 ELSE 0 END) * 1000000 + term * 1000 + reporter) AS term,
        max(lag) FILTER (reporter <> node_id AND reporter = leader) AS told, max(lag) FILTER (reporter = node_id) AS own
    FROM reports, l GROUP BY node_id)
SELECT node_id, CASE WHEN state = 'LEADER' AND term < top THEN 'FOLLOWER' ELSE state END AS state, term, coalesce(told, own) AS lag FROM b, t
"""


@query("node_merge", _REPORTS, plain=True)
def node_merge(spark, d):
    r = table(spark, d, "supplier").groupBy((F.col("s_nationkey") % 5).cast("long").alias("reporter"), (F.col("s_suppkey") % 5).alias("node_id")).agg(F.max("s_suppkey").alias("k"))
    reports = r.select("reporter", "node_id", F.when(F.col("k") % 3 == 0, "LEADER").otherwise("FOLLOWER").alias("state"), (F.col("k") % 11).alias("term"), (F.col("k") % 13).alias("lag"))
    return replica.merge_nodes(reports)


@query("compaction_bound", """SELECT cluster AS leader, max(match_index) AS applied, min(match_index) AS min_match, CAST(least(greatest(max(match_index) - 200, min(match_index)), max(match_index) - 100) AS BIGINT) AS bound FROM replicas GROUP BY 1""")
def compaction_bound(spark, d):
    nodes = _replicas(spark, d).select(F.col("cluster").alias("leader"), F.col("match_index").alias("applied"), "match_index")
    return replica.compaction_bound(nodes, 100)


@query("log_diff", """SELECT min("offset") AS first_difference FROM messages WHERE "offset" % 997 = 996""")
def log_diff(spark, d):
    left = messages(spark, d).select(F.col("offset").alias("index"), F.expr("offset div 1000").alias("term"))
    right = left.withColumn("term", F.when(F.col("index") % 997 == 996, F.col("term") + 1).otherwise(F.col("term")))
    return replica.log_diff(left, right)


@query("log_up_to_date", """SELECT a.node_id AS candidate, b.node_id AS voter, a.node_id % 7 > b.node_id % 7 OR (a.node_id % 7 = b.node_id % 7 AND a.match_index >= b.match_index) AS grants FROM replicas a JOIN replicas b ON a.cluster = b.cluster AND a.node_id <> b.node_id""")
def log_up_to_date(spark, d):
    nodes = _replicas(spark, d)
    a = nodes.select("cluster", F.col("node_id").alias("candidate"), F.col("match_index").alias("i"))
    b = nodes.select("cluster", F.col("node_id").alias("voter"), F.col("match_index").alias("j"))
    pairs = a.join(b, "cluster").where("candidate <> voter")  # the few nodes of a cluster
    return pairs.select("candidate", "voter", S.up_to_date(F.col("candidate") % 7, F.col("i"), F.col("voter") % 7, F.col("j")).alias("grants"))


@query("quorum_alive", """,
n AS (SELECT max("timestamp") AS now FROM messages)
SELECT cluster, 1 + count(*) FILTER (node_id % 9 = 0 OR contact_ms >= now - 21600000) AS alive, (count(*) + 1) // 2 + 1 AS needed, 1 + count(*) FILTER (node_id % 9 = 0 OR contact_ms >= now - 21600000) >= (count(*) + 1) // 2 + 1 AS has_quorum
FROM replicas, n GROUP BY cluster""")
def quorum_alive(spark, d):
    now = messages(spark, d).agg(F.max("timestamp")).scalar()
    return replica.quorum_alive(_replicas(spark, d).withColumn("in_snapshot", F.col("node_id") % 9 == 0), now, 21_600_000)


@query("rpc_cap", """,
e AS (SELECT topic, "offset", octet_length(encode(payload)) * 4000 AS size FROM messages),
r AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS b FROM e WINDOW w AS (PARTITION BY topic ORDER BY "offset" ROWS UNBOUNDED PRECEDING))
SELECT topic, "offset" AS index, CAST(size AS BIGINT) AS size FROM r WHERE n = 1 OR (n <= 500 AND b <= 8388608)""")
def rpc_cap(spark, d):
    entries = messages(spark, d).select("topic", F.col("offset").alias("index"), (F.octet_length("payload") * 4000).cast("long").alias("size"))
    return replica.rpc_prefix(entries, ["topic"], "size")


@query("settle_proposals", """SELECT "offset" AS index, "offset" // 1000 AS term, "offset" % 10 <> 0 AS settled FROM messages""")
def settle_proposals(spark, d):
    proposals = messages(spark, d).select(F.col("offset").alias("index"), F.expr("offset div 1000").alias("term"))
    applied = messages(spark, d).select(F.col("offset").alias("index"), F.expr("offset div 1000 + case when offset % 10 = 0 then 1 else 0 end").alias("term"))
    return replica.settle_proposals(proposals, applied)


@query("stale_proposals", f"""SELECT "offset" AS index FROM messages WHERE {_SINCE} - "timestamp" > 65000""")
def stale_proposals(spark, d):
    return replica.stale_proposals(messages(spark, d).select(F.col("offset").alias("index"), F.col("timestamp").alias("proposed_ms")), F.lit(_SINCE)).select("index")


# More of the reads, groups, telemetry and replicas.


@query("head_map", "SELECT topic, head FROM heads")
def head_map(spark, d):
    return log.head_map(messages(spark, d)).select(F.explode("heads").alias("topic", "head"))


@query("start_positions", f""",
s(topic, start, value, committed) AS (VALUES ('click', 'earliest', 0, 7), ('click', 'time', {_SINCE}, 7), ('view', 'time', 9999999999999, 7), ('view', 'committed', 0, 70), ('error', 'committed', 0, -1), ('error', 'offset', 33, -1))
SELECT s.topic, s.start, s.value, CAST(s.committed AS BIGINT) AS committed, CAST(CASE start WHEN 'offset' THEN s.value WHEN 'committed' THEN greatest(0, committed)
    WHEN 'time' THEN coalesce((SELECT min("offset") FROM messages m WHERE m.topic = s.topic AND m."timestamp" >= s.value), (SELECT head + 1 FROM heads h WHERE h.topic = s.topic)) ELSE 0 END AS BIGINT) AS position FROM s""")
def start_positions(spark, d):
    rows = [("click", "earliest", 0, 7), ("click", "time", _SINCE, 7), ("view", "time", 9_999_999_999_999, 7), ("view", "committed", 0, 70), ("error", "committed", 0, -1), ("error", "offset", 33, -1)]
    return log.start_positions(messages(spark, d), spark.createDataFrame(rows, "topic string, start string, value long, committed long"))


@query("auto_commit", """SELECT 'g9' AS "group", topic, max("offset") + 1 AS committed FROM (SELECT * FROM messages WHERE topic IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY topic ORDER BY "offset") <= 40) GROUP BY topic""")
def auto_commit(spark, d):
    return log.auto_commit(log.poll(messages(spark, d), {"click": 0, "view": 0}, 40), "g9")


@query("gauges", """SELECT count(DISTINCT topic) AS topics, count(*) AS n_messages, max("offset") + 1 AS next_offset, (SELECT count(*) FROM seg) AS open_segments, (SELECT CAST(sum(n_bytes) AS BIGINT) FROM seg) AS segment_bytes FROM messages""")
def gauges(spark, d):
    return log.gauges(messages(spark, d), _segments(spark, d))


@query("open_segments", "SELECT topic, count(*) AS segments, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM seg GROUP BY topic")
def open_segments(spark, d):
    return _segments(spark, d).groupBy("topic").agg(F.count(F.lit(1)).alias("segments"), F.sum("n_bytes").cast("long").alias("n_bytes"))


@query("active_members", """SELECT 'g' || (user_id % 4) AS "group", topic, count(DISTINCT user_id) AS members, count(*) AS leases FROM messages GROUP BY 1, 2""")
def active_members(spark, d):
    leases = messages(spark, d).select(F.concat(F.lit("g"), F.col("key").cast("long") % 4).alias("group"), "topic", F.col("key").alias("consumer"))
    return groups.active_members(leases)


@query("fetch_committed", """SELECT w."group", w.topic, coalesce(committed, -1) AS committed FROM (SELECT 'g' || k AS "group", topic FROM heads, (SELECT unnest(range(1, 7)) AS k)) w LEFT JOIN groups g ON g."group" = w."group" AND g.topic = w.topic""")
def fetch_committed(spark, d):
    wanted = log.heads(messages(spark, d)).select(F.explode(F.array(*[F.lit(f"g{k}") for k in range(1, 7)])).alias("group"), "topic")
    return groups.fetch_committed(wanted, _committed(spark, d))


@query("group_seek_time", f"""SELECT g."group", g.topic, CASE WHEN k < 2 THEN coalesce((SELECT min("offset") FROM messages m WHERE m.topic = g.topic AND "timestamp" >= {_SINCE}), -1) ELSE committed END AS committed FROM groups g""")
def group_seek_time(spark, d):
    found = log.seek_time(messages(spark, d), F.lit(_SINCE))
    moved = _committed(spark, d).where("group in ('g0', 'g1')").join(found, "topic").select("group", "topic", F.col("offset").alias("position"))
    return groups.seek_time(_committed(spark, d), moved)


@query("zip_histories", _TICKS + """,
p AS (SELECT topic, n, row_number() OVER (PARTITION BY topic ORDER BY tick DESC) AS place FROM ticks WHERE n > 1),
c AS (SELECT topic, n, total, row_number() OVER (PARTITION BY topic ORDER BY tick DESC) AS place FROM ticks)
SELECT c.topic, c.place, CAST(coalesce(p.n, greatest(0, c.total - c.n)) AS BIGINT) AS produced, c.n AS consumed FROM c LEFT JOIN p ON p.topic = c.topic AND p.place = c.place""")
def zip_histories(spark, d):
    ticks = _ticks(spark, d)
    return metrics.zip_histories(ticks.where("n > 1"), ticks, ["topic"])


@query("worst_mean", "SELECT max(mean) AS worst_mean FROM (SELECT round(avg(value), 4) AS mean FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type)", plain=True)
def worst_mean(spark, d):
    return metrics.worst_mean(_requests(spark, d), ("click", "view"))


@query("topics_json", """SELECT '{"topic":"' || topic || '","messages":' || count(*) || ',"head":' || max("offset") || '}' AS frame FROM messages GROUP BY topic""")
def topics_json(spark, d):
    m = messages(spark, d)
    return metrics.frame(log.topic_counts(m).join(log.heads(m), "topic").select("topic", F.col("n_messages").alias("messages"), "head"))


@query("consumers_json", """SELECT '{"group":"' || "group" || '","topic":"' || topic || '","committed":' || committed || ',"head":' || head || ',"lag":' || lag || ',"members":' || members || '}' AS frame FROM lags""")
def consumers_json(spark, d):
    return metrics.frame(_lags(spark, d).select("group", "topic", "committed", "head", "lag", "members"))


@query("messages_json", """SELECT '{"offset":' || "offset" || ',"timestamp":' || "timestamp" || ',"key":"' || key || '","payload":' || to_json(payload) || '}' AS frame FROM messages WHERE topic = 'view' AND "offset" >= 50 ORDER BY "offset" LIMIT 100""")
def messages_json(spark, d):
    """A page of a topic's messages, as a browser of the log asks for it."""
    return metrics.frame(log.read_from(messages(spark, d), "view", 50, 100).select("offset", "timestamp", "key", "payload"))


@query("telemetry_frame", """,
t AS (SELECT list('{"topic":"' || topic || '","head":' || head || '}' ORDER BY topic) AS l FROM heads),
g AS (SELECT list('{"group":"' || "group" || '","lag":' || lag || '}' ORDER BY "group") AS l FROM (SELECT "group", CAST(sum(lag) AS BIGINT) AS lag FROM lags GROUP BY 1))
SELECT '{"node":"n1","topics":[' || array_to_string(t.l, ',') || '],"groups":[' || array_to_string(g.l, ',') || ']}' AS frame FROM t, g""")
def telemetry_frame(spark, d):
    lags = _lags(spark, d).groupBy("group").agg(F.sum("lag").alias("lag"))
    return metrics.telemetry(log.heads(messages(spark, d)).select("topic", "head"), lags, "n1")


@query("scrape_text", """SELECT 'log_head{node="n1",topic="' || topic || '"} ' || head AS line FROM heads
UNION ALL SELECT 'group_lag{group="' || "group" || '",topic="' || topic || '"} ' || lag FROM lags UNION ALL SELECT 'log_messages ' || count(*) FROM messages""")
def scrape_text(spark, d):
    text = lambda *pairs: F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[c for _, c in pairs]))
    m = messages(spark, d)
    heads = log.heads(m).select(F.lit("log_head").alias("name"), text(("topic", F.col("topic")), ("node", F.lit("n1"))).alias("labels"), F.col("head").alias("value"))
    lags = _lags(spark, d).select(F.lit("group_lag").alias("name"), text(("topic", F.col("topic")), ("group", F.col("group"))).alias("labels"), F.col("lag").alias("value"))
    whole = m.agg(F.count(F.lit(1)).alias("value")).select(F.lit("log_messages").alias("name"), F.create_map().cast("map<string,string>").alias("labels"), "value")
    return metrics.scrape(heads.unionByName(lags).unionByName(whole))


@query("raft_entries", """SELECT topic AS log, "offset" // 1000 AS term, "offset" AS index, topic, payload, CASE WHEN "offset" % 7 = 0 THEN NULL ELSE key END AS key, "timestamp",
    CASE WHEN "offset" % 5 = 0 THEN 'OFFSET_COMMIT' ELSE 'MESSAGE' END AS command_type, CASE WHEN "offset" % 5 = 0 THEN 'g0' END AS consumer_group, CASE WHEN "offset" % 5 = 0 THEN "offset" END AS offset_value FROM messages""")
def raft_entries(spark, d):
    """Entries framed into a log a thousand offsets of each topic, whose end is torn, and recovered from them."""
    m, commit = messages(spark, d), F.col("offset") % 5 == 0
    entries = m.select(
        F.col("topic").alias("log"), F.expr("offset div 1000").alias("term"), F.col("offset").alias("index"), "topic", S.bytes_of(F.col("payload")).alias("payload"), F.when(F.col("offset") % 7 != 0, F.col("key")).alias("key"),
        "timestamp", F.when(commit, "OFFSET_COMMIT").otherwise("MESSAGE").alias("command_type"), F.when(commit, "g0").alias("consumer_group"), F.when(commit, F.col("offset")).alias("offset_value"),
    )
    logs = framed.encoded_entries(entries, ["log", "term"])
    torn = logs.withColumn("content", F.concat("content", F.lit(b"\x00\x00\x00\x09half")))
    return framed.decoded_entries(torn).withColumn("payload", S.text_of(F.col("payload")))


@query("raft_state", """SELECT max("offset") // 1000 AS current_term, 'n2' AS voted_for, max("offset") AS last_applied, 0::BIGINT AS last_applied_term FROM messages""")
def raft_state(spark, d):
    """A replica's state written as properties and read back; what it lacks has its default."""
    last = messages(spark, d).agg(F.max("offset").alias("o"))
    lines = F.array(F.lit("#state"), F.concat(F.lit("currentTerm="), F.expr("o div 1000")), F.lit("votedFor=n2"), F.concat(F.lit("lastApplied = "), F.col("o")))
    last.select(F.explode(lines).alias("value")).write.text(path := _fresh(spark, "state"))
    return framed.read_state(spark, path)


@query("rpc_from_index", """,
e AS (SELECT topic, "offset", octet_length(encode(payload)) * 4000 AS size FROM messages WHERE "offset" >= 300),
r AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS b FROM e WINDOW w AS (PARTITION BY topic ORDER BY "offset" ROWS UNBOUNDED PRECEDING))
SELECT topic, "offset" AS index, CAST(size AS BIGINT) AS size FROM r WHERE n = 1 OR (n <= 500 AND b <= 8388608)""")
def rpc_from_index(spark, d):
    entries = messages(spark, d).select("topic", F.col("offset").alias("index"), (F.octet_length("payload") * 4000).cast("long").alias("size"))
    return replica.rpc_prefix(entries, ["topic"], "size", start=300)


@query("reachable_followers", "SELECT node_id FROM (SELECT node_id, CASE WHEN node_id % 5 = 0 THEN 'LEADER' ELSE 'FOLLOWER' END AS state, node_id % 4 - 1 AS lag FROM replicas) WHERE state <> 'LEADER' AND lag >= 0")
def reachable_followers(spark, d):
    n = F.col("node_id")
    nodes = _replicas(spark, d).select("node_id", F.when(n % 5 == 0, "LEADER").otherwise("FOLLOWER").alias("state"), (n % 4 - 1).alias("lag"))
    return replica.reachable_followers(nodes).select("node_id")


@query("replica_bands", "SELECT node_id, CASE WHEN node_id % 14 - 1 < 0 THEN 'offline' WHEN node_id % 14 - 1 > 10 THEN 'warn' ELSE 'ok' END AS band FROM replicas")
def replica_bands(spark, d):
    return _replicas(spark, d).select("node_id", S.replica_band(F.col("node_id") % 14 - 1).alias("band"))


# 9. Streams: each reads all input there is, through a checkpoint in the shared folder.


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _fresh(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4()}"


@query("stream_topic_counts", "SELECT topic, count(*) AS n_messages FROM messages GROUP BY topic")
def stream_topic_counts(spark, d):
    stream = _stream(spark, d, "events").select(F.col("event_type").alias("topic"))
    return streams.drain(log.topic_counts(stream), ["topic"], _fresh(spark, "counts"), _fresh(spark, "stream"))


@query("stream_rates", _TICKS + "SELECT topic, tick, n, CAST(coalesce(greatest(0, total - lag(total) OVER (PARTITION BY topic ORDER BY tick)), 0) AS BIGINT) AS rate FROM ticks")
def stream_rates(spark, d):
    stream = _stream(spark, d, "events").select(F.col("event_type").alias("topic"), F.floor(S.epoch_ms("ts") / 3_600_000).cast("long").alias("tick"))
    hours = streams.drain(stream.groupBy("topic", "tick").agg(F.count(F.lit(1)).alias("n")), ["topic", "tick"], _fresh(spark, "rates"), _fresh(spark, "stream"))
    total = F.sum("n").over(Window.partitionBy("topic").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0))
    return metrics.rates(hours.withColumn("total", total), "total", ["topic"]).select("topic", "tick", "n", "rate")


@query("stream_dlq", """SELECT l_orderkey AS "offset", count(*) AS attempts FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 5""", plain=True)
def stream_dlq(spark, d):
    nacks = _stream(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("offset")).agg(F.count(F.lit(1)).alias("attempts"))
    return streams.drain(nacks.where("attempts >= 5"), ["offset"], _fresh(spark, "dlq"), _fresh(spark, "stream"))  # counts only grow


@query("stream_append", """SELECT "offset", topic, key, payload, "timestamp" FROM messages""")
def stream_append(spark, d):
    stream = _stream(spark, d, "events").select("event_id", F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("payload"), S.epoch_ms("ts").alias("timestamp"))
    ledger = streams.Ledger(spark, _fresh(spark, "ledger"))
    streams.append_stream(stream, ledger, ["event_id"], 0, _fresh(spark, "stream"))
    return ledger.read().select("offset", "topic", "key", "payload", "timestamp")


@query("stream_group_replay")
def stream_group_replay(spark, d):
    """Commands arrive from a table of them; the result equals group_replay."""
    rows = groups.with_reachable(commands(spark, d), messages(spark, d))
    folder, found = _fresh(spark, "commands"), _fresh(spark, "replayed")
    rows.write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    out = streams.replay_stream(stream, lease_ms=30_000, most=3)
    out.writeStream.format("parquet").option("path", found).option("checkpointLocation", _fresh(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(found)


# 10. Producers.


@query("producer_batches", """,
sent AS (SELECT user_id % 16 AS producer, "offset" AS seq, "timestamp" AS at_ms, CASE WHEN "offset" % 50 < 40 THEN 'click' ELSE topic END AS topic, octet_length(encode(payload)) AS n_bytes FROM messages),
placed AS (
    SELECT *, row_number() OVER w AS rn, CAST(sum(n_bytes) OVER w AS BIGINT) - n_bytes AS before FROM sent WINDOW w AS (PARTITION BY producer ORDER BY seq ROWS UNBOUNDED PRECEDING)),
starts AS (
    SELECT producer, rn, topic, at_ms, before, 0::BIGINT AS batch FROM placed WHERE rn = 1
    UNION ALL
    SELECT n.producer, n.rn, p.topic, p.at_ms, p.before, n.batch FROM (
        SELECT s.producer, min(z.rn) AS rn, min(s.batch) + 1 AS batch FROM starts s JOIN placed z
        ON z.producer = s.producer AND z.rn > s.rn AND (z.topic <> s.topic OR z.before - s.before >= 64 OR z.at_ms - s.at_ms >= 14400000) GROUP BY s.producer) n
    JOIN placed p ON p.producer = n.producer AND p.rn = n.rn),
spans AS (SELECT *, coalesce(lead(rn) OVER (PARTITION BY producer ORDER BY rn), 9223372036854775807) AS until FROM starts)
SELECT p.producer, p.seq, p.at_ms, p.topic, CAST(p.n_bytes AS BIGINT) AS n_bytes, s.batch FROM placed p JOIN spans s ON s.producer = p.producer AND p.rn >= s.rn AND p.rn < s.until""", recursive=True)
def producer_batches(spark, d):
    e = table(spark, d, "events")
    sent = e.select((F.col("user_id") % 16).alias("producer"), F.col("event_id").alias("seq"), S.epoch_ms("ts").alias("at_ms"), F.when(F.col("event_id") % 50 < 40, F.lit("click")).otherwise(F.col("event_type")).alias("topic"), F.octet_length("props").cast("long").alias("n_bytes"))
    return segments.producer_batches(sent, most_bytes=64, linger_ms=4 * 3600 * 1000)


# 11. Clients and elections, as far as they are decisions over rows.


@query("leader_redirect", """SELECT n_nationkey AS node_id, n_nationkey % 5 <> 4 AS redirected, CASE WHEN n_nationkey % 5 < 2 THEN 'host' || n_nationkey END AS host,
    CASE WHEN n_nationkey % 5 < 2 THEN CAST(9000 + n_nationkey AS INTEGER) END AS port FROM nation""", plain=True)
def leader_redirect(spark, d):
    n = F.col("n_nationkey").cast("string")
    whole = F.concat(F.lit("NOT_LEADER:host"), n, F.lit(":"), (9000 + F.col("n_nationkey")).cast("string"))
    turn = F.col("n_nationkey") % 5
    error = F.when(turn < 2, whole).when(turn == 2, "NOT_LEADER:UNKNOWN").when(turn == 3, F.concat(whole, F.lit(":x"))).otherwise("timed out")
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("node_id"), S.leader_of(error).alias("r")).select("node_id", "r.*")


_HASHES = """WITH h AS (SELECT n_name AS name, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(n_name, ''), lambda c: unicode(c)::BIGINT)), lambda a, x: (xor(a, x) * 16777619) % 4294967296) AS hash FROM nation),
a AS (SELECT *, xor(hash, (hash * 8192) % 4294967296) AS s FROM h), b AS (SELECT name, hash, xor(s, s // 131072) AS s FROM a), c AS (SELECT name, hash, xor(s, (s * 32) % 4294967296) AS s FROM b)
SELECT name, hash, s / 4294967296.0::DOUBLE AS drawn FROM c"""


@query("name_hash", _HASHES, plain=True)
def name_hash(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"), S.fnv1a(F.col("n_name")).alias("hash"))
    return names.select("name", "hash", F.get(S.xorshift32(F.col("hash"), 1), F.lit(0)).alias("drawn"))


@query("retry_schedule", """WITH RECURSIVE r AS (SELECT 0::BIGINT AS attempt, 0::BIGINT AS at_ms, 100::BIGINT AS wait
    UNION ALL SELECT attempt + 1, at_ms + wait, least(2000, 2 * wait) FROM r WHERE at_ms + wait <= 120000)
SELECT n_nationkey AS node_id, attempt, at_ms FROM r, nation""", plain=True)
def retry_schedule(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("node_id"), F.posexplode(S.retry_starts()).alias("attempt", "at_ms"))
    return rows.select("node_id", F.col("attempt").cast("long").alias("attempt"), "at_ms")


@query("election_timeouts", """SELECT node_id, 1000 + CAST('0x' || substr(md5('n' || node_id), 1, 8) AS BIGINT) % 1000 AS timeout_ms, CAST(6000 AS BIGINT) AS startup_ms FROM replicas""")
def election_timeouts(spark, d):
    seed = F.concat(F.lit("n"), F.col("node_id").cast("string"))
    return _replicas(spark, d).select("node_id", S.election_timeout(seed).alias("timeout_ms"), S.election_timeout(seed, starting=True).alias("startup_ms"))


@query("votes", """,
n AS (SELECT node_id, node_id % 4 AS own_term, match_index AS own_index, contact_ms, max(contact_ms) OVER () AS now FROM replicas),
r AS (SELECT *, own_term + node_id % 3 - 1 AS term, CASE WHEN node_id % 2 = 0 THEN 'a' ELSE 'b' END AS candidate, CASE WHEN node_id % 5 = 0 THEN own_index - 1 ELSE own_index END AS last_index,
    CASE WHEN node_id % 7 = 0 THEN NULL ELSE 'a' END AS voted_for FROM n)
SELECT node_id AS node, candidate, term > own_term AND NOT (node_id % 11 = 0 OR now - contact_ms < 3600000) AND last_index >= own_index AS pre_vote,
    term >= own_term AND (term > own_term OR voted_for IS NULL OR voted_for = candidate) AND last_index >= own_index AS vote, greatest(term, own_term) AS term FROM r""")
def votes(spark, d):
    n = _replicas(spark, d)
    k = F.col("node_id")
    now = n.agg(F.max("contact_ms")).scalar()
    nodes = n.select(k.alias("node"), (k % 4).alias("current_term"), F.when(k % 7 != 0, "a").alias("voted_for"), F.col("match_index").alias("own_index"), (k % 4).alias("own_term"), (k % 11 == 0).alias("is_leader"), F.col("contact_ms").alias("heartbeat_ms"))
    last = F.when(k % 5 == 0, F.col("match_index") - 1).otherwise(F.col("match_index"))
    requests = n.select(k.alias("node"), (k % 4 + k % 3 - 1).alias("term"), F.when(k % 2 == 0, "a").otherwise("b").alias("candidate"), last.alias("last_index"), (k % 4).alias("last_term"))
    return replica.votes(requests, nodes, now, within_ms=3_600_000)


_CUTS = """,
e AS (SELECT topic, "offset" AS index FROM messages),
b AS (SELECT topic, min(index) AS low, max(index) AS high, CASE topic WHEN 'click' THEN max(index) // 2 WHEN 'view' THEN max(index) + 1 WHEN 'error' THEN min(index) END AS cut_at FROM e GROUP BY topic)
SELECT topic, index FROM e JOIN b USING (topic) WHERE """


def _cut_logs(spark, d):
    entries = messages(spark, d).select("topic", F.col("offset").alias("index"))
    at = F.when(F.col("topic") == "click", F.expr("max(index) div 2")).when(F.col("topic") == "view", F.max("index") + 1).when(F.col("topic") == "error", F.min("index"))
    return entries, entries.groupBy("topic").agg(at.alias("at"))


@query("log_truncate", _CUTS + "cut_at IS NULL OR cut_at < low OR cut_at > high OR index < cut_at")
def log_truncate(spark, d):
    return replica.truncate_from(*_cut_logs(spark, d), "topic")


@query("log_compact", _CUTS + "cut_at IS NULL OR cut_at <= low OR cut_at > high OR index > cut_at")
def log_compact(spark, d):
    return replica.compact(*_cut_logs(spark, d), "topic")


@query("delivery_attempts", """,
failed AS (SELECT 'g' || (user_id % 3) AS "group", topic, "offset" // 10 AS "offset" FROM messages WHERE "offset" % 3 = 0
    UNION ALL SELECT 'g' || (user_id % 3), topic, "offset" // 10 FROM messages WHERE "offset" % 3 = 1)
SELECT "group", topic, "offset", count(*) AS failures, count(*) % 2 AS attempts, count(*) // 2 AS dead_letters FROM failed GROUP BY ALL""")
def delivery_attempts(spark, d):
    m = messages(spark, d)
    failed = m.select(F.concat(F.lit("g"), (F.col("key").cast("long") % 3).cast("string")).alias("group"), "topic", F.expr("offset div 10").alias("from_offset"), F.col("offset").alias("_at"))
    return groups.delivery_attempts(failed.where("_at % 3 = 0").withColumnRenamed("from_offset", "offset"), failed.where("_at % 3 = 1"), most=2)


@query("group_poll", """,
p AS (SELECT g."group", g.topic, m."offset", m.payload, row_number() OVER (PARTITION BY g."group", g.topic ORDER BY m."offset") AS n FROM groups g JOIN messages m ON m.topic = g.topic AND m."offset" >= committed)
SELECT "group", topic, "offset", payload FROM p WHERE n <= 20""")
def group_poll(spark, d):
    return groups.poll(_committed(spark, d), messages(spark, d), 20).select("group", "topic", "offset", "payload")


# 12. Extensions: not in the reference; Spark's own windows over the log.


@query("ext_tumbling_counts", """SELECT topic, date_trunc('hour', ts) AS window_start, count(*) AS n FROM messages GROUP BY 1, 2""")
def ext_tumbling_counts(spark, d):
    return messages(spark, d).groupBy("topic", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("topic", F.col("w.start").alias("window_start"), "n")


@query("ext_session_counts", """,
g AS (SELECT topic, "timestamp", CASE WHEN "timestamp" - lag("timestamp") OVER (PARTITION BY topic ORDER BY "timestamp") < 3600000 THEN 0 ELSE 1 END AS new FROM messages),
s AS (SELECT topic, "timestamp", sum(new) OVER (PARTITION BY topic ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT topic, min("timestamp") AS began, count(*) AS n FROM s GROUP BY topic, session""")
def ext_session_counts(spark, d):
    m = messages(spark, d)
    out = m.groupBy("topic", F.session_window("ts", "1 hour").alias("w")).agg(F.min("timestamp").alias("began"), F.count(F.lit(1)).alias("n"))
    return out.select("topic", "began", "n")
