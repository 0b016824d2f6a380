"""The other ways that operators take beyond what is broadcast, and numbering and percentiles over many ranges."""

import math
import random

from pyspark.sql import functions as F

from millrace.operators import groups, log, metrics, segments
from millrace.storage import durable
from millrace.streaming import streams


def test_floor_cut_by_array_and_by_merging(spark):
    rng = random.Random(5)
    rows = [(t, rng.randrange(500), k) for k, t in enumerate(rng.choices("ab", k=300))] + [("c", 5, 999)]
    cuts = [("a", 0), ("a", 100), ("a", 333), ("b", 50), ("b", 499)]
    df = spark.createDataFrame(rows, "topic string, timestamp long, offset long")
    cut = durable(spark.createDataFrame(cuts, "topic string, cut long"))
    wanted = set()
    for topic, at, offset in rows:
        below = [c for t, c in cuts if t == topic and c <= at]
        if below:
            wanted.add((topic, at, offset, max(below)))
    for few, bucket in ((64, 100_000), (0, 100_000), (0, 7)):
        found = segments.floor_cut(df, cut, "timestamp", few=few, bucket=bucket).select("topic", "timestamp", "offset", "cut").collect()
        assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted


def test_start_by_time_is_the_least_offset_even_where_times_go_back(spark):
    m = spark.createDataFrame([("a", 0, 50), ("a", 1, 10), ("a", 2, 60), ("a", 3, 20)], "topic string, offset long, timestamp long")
    subs = [("a", "time", at, None) for at in (5, 15, 55, 61)] + [("a", "time", None, None), ("none", "time", 5, None)]
    found = {(r.topic, r.value): r.position for r in log.start_positions(m, spark.createDataFrame(subs, "topic string, start string, value long, committed long")).collect()}
    assert found == {("a", 5): 0, ("a", 15): 0, ("a", 55): 2, ("a", 61): 4, ("a", None): 4, ("none", 5): 0}


def test_backlog_is_that_of_counting(spark):
    m = spark.createDataFrame([(t, o) for t in "ab" for o in range(0, 60, 3)], "topic string, offset long")
    committed = [("g", "a", -1), ("h", "a", 10), ("i", "a", 57), ("j", "a", 58), ("g", "b", 30)]
    found = {r[:2]: r.message_lag for r in groups.message_lag(spark.createDataFrame(committed, "group string, topic string, committed long"), m).collect()}
    assert found == {(g, t): sum(o >= c for o in range(0, 60, 3)) for g, t, c in committed}


def test_numbers_within_hot_and_null_keys(spark):
    rows = [("hot", k) for k in range(500)] + [(None, k) for k in range(7)] + [("x", 3)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "t string, k long").repartition(5)
    found = log.number_within(df, ["t"], ["k"]).collect()
    assert sorted((str(r.t), r.nth) for r in found) == sorted([("hot", k) for k in range(500)] + [("None", k) for k in range(7)] + [("x", 0)])
    assert all(r.nth == r.k for r in found if r.t != "x")


def test_percentiles_are_nearest_rank(spark):
    rng = random.Random(2)
    values = {"even": [float(k) for k in range(1, 1001)], "one": [4.0], "ties": [rng.choice([1.0, 2.0, 9.0]) for _ in range(777)], "nulls": [None, None]}
    df = spark.createDataFrame([(t, v) for t, vs in values.items() for v in vs], "type string, value double").repartition(7)
    found = {r.type: r for r in metrics.latency_percentiles(df).collect()}
    for t, vs in values.items():
        vs = sorted(v for v in vs if v is not None)
        for name, per_mille in (("p50", 500), ("p95", 950), ("p99", 990), ("p999", 999)):
            assert found[t][name] == (vs[math.ceil(len(vs) * per_mille / 1000) - 1] if vs else None)
    assert metrics.latency_percentiles(df.limit(0)).count() == 0


def test_archived_messages_beside_hot_ones(spark):
    schema = "topic string, offset long, payload string"
    hot = spark.createDataFrame([("a", 10, "hot"), ("a", 12, "hot")], schema)
    archived = spark.createDataFrame([("a", 9, "old"), ("a", 10, "old"), ("a", 11, "old"), ("b", 50, "old")], schema)
    found = sorted(tuple(r) for r in segments.with_archive(hot, archived).collect())
    assert found == [("a", 9, "old"), ("a", 10, "hot"), ("a", 11, "old"), ("a", 12, "hot"), ("b", 50, "old")]


def test_drained_keys_keep_their_last_row(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([("a",)] * (k + 1) + [(f"only{k}",)], "topic string").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("topic string").option("maxFilesPerTrigger", 1).parquet(str(source))
    counts = stream.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    found = streams.drain(counts, ["topic"], str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", 6), ("only0", 1), ("only1", 1), ("only2", 1)]


def test_drain_of_no_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("topic string").parquet(str(tmp_path / "in"))
    counts = stream.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    assert streams.drain(counts, ["topic"], str(tmp_path / "out"), str(tmp_path / "cp")).count() == 0


def test_ledger_with_an_empty_batch(spark, tmp_path):
    ledger = streams.Ledger(spark, str(tmp_path / "log"))
    rows = lambda *keys: spark.createDataFrame([(k, "t") for k in keys], "k long, topic string")
    assert [ledger.append_batch(rows(*ks), ["k"], 7) for ks in ((), (1, 2), (), (3,))] == [0, 2, 0, 1]
    assert [(r.offset, r.k) for r in ledger.read().orderBy("offset").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_long_poll_waits_for_an_append(spark, tmp_path):
    import threading
    import time

    ledger = streams.Ledger(spark, str(tmp_path / "log"))
    rows = lambda *keys: spark.createDataFrame([(k, "t") for k in keys], "k long, topic string")
    ledger.append_batch(rows(1), ["k"], 7)
    assert streams.long_poll(ledger, "t", 1, 5, timeout_s=0.1).count() == 0
    assert [r.k for r in streams.long_poll(ledger, "t", 0, 5, timeout_s=0).collect()] == [1]
    later = threading.Thread(target=lambda: (time.sleep(0.5), ledger.append_batch(rows(2, 3), ["k"], 8)))
    later.start()
    found = streams.long_poll(ledger, "t", 1, 1, timeout_s=60)
    later.join()
    assert [(r.offset, r.k) for r in found.collect()] == [(1, 2)]


def test_hashes_and_draws(spark):
    from millrace.functions import scalars as S

    def draws(s, n):
        s, out = s or 0x9E3779B9, []
        for _ in range(n):
            s ^= s << 13 & 0xFFFFFFFF
            s ^= s >> 17
            s ^= s << 5 & 0xFFFFFFFF
            out.append(s / 2**32)
        return out

    texts = ["", "a", "foobar", "é😀", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.fnv1a(F.col("t")).alias("h"))
    found = {r.t: r.h for r in df.collect()}
    assert found[""] == 0x811C9DC5 and found["a"] == 0xE40C292C and found["foobar"] == 0xBF9CF968 and found[None] is None  # published values
    h = 0x811C9DC5
    for unit in (0xE9, 0xD83D, 0xDE00):
        h = (h ^ unit) * 16777619 & 0xFFFFFFFF
    assert found["é😀"] == h
    seeds = [0, 1, 0xFFFFFFFF, 12345]
    for r in spark.createDataFrame([(s,) for s in seeds], "s long").select("s", S.xorshift32(F.col("s"), 4).alias("d")).collect():
        assert r.d == draws(r.s, 4)


def test_redirects_and_retries(spark):
    from millrace.functions import scalars as S

    cases = {"NOT_LEADER:h:1": (True, "h", 1), "NOT_LEADER:h:1::": (True, "h", 1), "NOT_LEADER:h:x": (True, None, None), "NOT_LEADER:UNKNOWN": (True, None, None), "NOT_LEADER:": (True, None, None), "other": (False, None, None), None: (False, None, None)}
    for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", S.leader_of(F.col("t")).alias("r")).collect():
        assert tuple(r.r) == cases[r.t], r.t
    starts = spark.range(1).select(S.retry_starts()).first()[0]
    assert starts[:7] == [0, 100, 300, 700, 1500, 3100, 5100] and starts[-1] <= 120_000 < starts[-1] + 2000


def test_rolling_over_many_ranges_is_the_sequential_rule(spark):
    rng = random.Random(4)
    rows = [("hot", o, rng.choice([0, 0, 1, 7, 50, 400])) for o in range(0, 9000, 3)] + [("even", o, 10) for o in range(700)] + [("one", 5, 9)] + [("null", o, None) for o in range(3)]
    wanted = {}
    for limit in (1, 30, 95, 100, 5000, 10**9):
        base, held, of = 0, 0, None
        for topic, o, n in rows:
            if topic != of:
                base, held, of = 0, 0, topic
            if held >= limit:
                base, held = o, 0
            held += n or 0
            wanted[limit, topic, o] = base
    df = spark.createDataFrame(rows, "topic string, offset long, n_bytes int").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for limit in (1, 30, 95, 100, 5000, 10**9):
            found = segments.roll(df, limit=limit).collect()
            assert len(found) == len(rows)
            assert all(wanted[limit, r.topic, r.offset] == r.segment_base for r in found), limit
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert segments.roll(df.limit(0)).count() == 0
