"""Reads, offsets, segments, framed files and ledgers on small cases."""

import struct

import pytest
from pyspark.sql import functions as F

from millrace import schema
from millrace.functions import scalars as S
from millrace.operators import log, metrics, replica, segments
from millrace.sources import framed
from millrace.streaming.streams import Ledger


def messages(spark, rows):
    return spark.createDataFrame(rows, "topic string, offset long, timestamp long")


def test_read_from_crosses_gaps_and_limits(spark):
    m = messages(spark, [("a", o, o) for o in (0, 3, 9, 12)] + [("b", 1, 1)])
    assert [r.offset for r in log.read_from(m, "a", 1, 2).collect()] == [3, 9]
    assert log.read_from(m, "a", 0, 0).count() == 0 and log.read_from(m, "nope", 0, 5).count() == 0
    assert [r.offset for r in log.next_page(m, "a", 9, 5).collect()] == [12]


def test_seek_takes_the_smallest_offset_even_where_times_go_back(spark):
    m = messages(spark, [("a", 0, 50), ("a", 1, 10), ("a", 2, 60), ("b", 3, 5)])
    found = {r.topic: r.offset for r in log.seek_time(m, F.lit(40)).collect()}
    assert found == {"a": 0, "b": -1}


def test_seek_between_messages(spark):
    m = messages(spark, [("a", 0, 10), ("a", 1, 20), ("a", 2, 30)])
    assert [r.offset for r in log.read_since(m, "a", F.lit(15), 10).collect()] == [1, 2]


def test_empty_log(spark):
    m = messages(spark, [])
    assert log.next_offset(m).first()[0] == 0 and log.heads(m).count() == 0
    assert log.cached_messages(m).first()[0] == 0
    assert log.assign_offsets(m, ["topic"], name="new").count() == 0


def test_offsets_are_dense_whatever_the_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    for n in (1, 3, 16):
        found = log.assign_offsets(rows, ["k"], base=5, partitions=n).orderBy("k").collect()
        assert [r.offset for r in found] == list(range(5, 1005))


def test_atomic_batch_offsets(spark):
    slices = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (1, "a", 1), (1, "a", 1)], "r long, t string, n long")
    found = [(x.r, x.t, x.n_entries, x.base_offset) for x in log.atomic_bases(slices, "r", "t", "n").orderBy("base_offset").collect()]
    assert found == [(0, "a", 2, 0), (0, "b", 1, 2), (1, "a", 2, 3)]


def test_floor_and_next_segment(spark):
    seg = spark.createDataFrame([("t", 0), ("t", 1000), ("t", 2000)], "topic string, base long")
    at = spark.createDataFrame([("t", o) for o in (0, 999, 1000, 1500, 2500)] + [("u", 3)], "topic string, offset long")
    for bucket in (7, 100_000):
        low = {(r.topic, r.offset): r.base for r in segments.floor_segment(at, seg, bucket).collect()}
        high = {(r.topic, r.offset): r.base for r in segments.next_segment(at, seg, bucket).collect()}
        assert low == {("t", 0): 0, ("t", 999): 0, ("t", 1000): 1000, ("t", 1500): 1000, ("t", 2500): 2000, ("u", 3): None}
        assert high == {("t", 0): 1000, ("t", 999): 1000, ("t", 1000): 2000, ("t", 1500): 2000, ("t", 2500): None, ("u", 3): None}


def test_rolling_is_the_sequential_rule(spark):
    rows = [(t, o, (o * 37) % 90 + 1) for o in range(400) for t in "ab"]
    df = spark.createDataFrame(rows, "topic string, offset long, n_bytes long")
    found = {(r.topic, r.offset): r.segment_base for r in segments.roll(df, limit=200).collect()}
    for t in "ab":
        base = held = 0
        for o in range(400):
            if held >= 200:
                base, held = o, 0
            held += (o * 37) % 90 + 1
            assert found[t, o] == base


def test_producer_batches_rules(spark):
    rows = [(1, 0, 0, "a", 10), (1, 1, 1, "a", 10), (1, 2, 1, "b", 10), (1, 3, 2, "b", 100), (1, 4, 2, "b", 1), (1, 5, 50, "b", 1)]
    df = spark.createDataFrame(rows, "producer long, seq long, at_ms long, topic string, n_bytes long")
    assert [r.batch for r in segments.producer_batches(df, 100, 20).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 3]


def test_retention_spares_the_active_segment(spark):
    seg = spark.createDataFrame([("t", 0, 1), ("t", 10, 2), ("t", 20, 3)], "topic string, base long, last_modified long")
    assert [r.base for r in segments.expired(seg, F.lit(1000), 10).orderBy("base").collect()] == [0, 10]


def test_topic_names(spark):
    names = ["a.b-C_9", ".", "..", "raft", "__consumer_offsets", "a/b", "", None]
    found = {r.n: r.ok for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", schema.topic_is_valid(F.col("n")).alias("ok")).collect()}
    assert [found[n] for n in names] == [True] + [False] * 7


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(S.instant_ms(F.lit("1500"))) == 1500
    assert value(S.instant_ms(F.lit("1970-01-01T00:00:01Z"))) == 1000
    assert value(S.instant_ms(F.lit("soon"))) is None
    assert [value(S.time_ago(F.lit(100_000), F.lit(t))) for t in (98_000, 70_000, 0)] == ["just now", "30s ago", "1m ago"]
    assert value(S.segment_base(F.lit("x/00000000000000001000.log"))) == 1000 and value(S.segment_base(F.lit("x.tmp"))) is None
    assert value(S.null_if_empty(F.lit(""))) is None
    assert [value(S.majority(n)) for n in (2, 4, 1)] == [2, 3, 2]
    assert value(S.log_score(F.lit(0))) == 0.0 and value(S.log_score(F.lit(10_000))) == 100.0
    group, topic = S.split_offset_key(F.lit("g/t"))
    assert one.select(group, topic).first()[:] == ("g", "t")
    assert value(S.split_offset_key(F.lit("a/b/c"))[0]) is None


def test_record_size_is_that_of_the_frame(spark):
    for m in ({"offset": 0, "topic": "t", "payload": b"x" * 200, "key": None, "timestamp": 1, "stored_at": 300}, {"offset": 70_000, "topic": "ab", "payload": b"", "key": "k", "timestamp": 0, "stored_at": 1 << 40}):
        df = spark.createDataFrame([tuple(m[k] for k in ("offset", "topic", "payload", "key", "timestamp", "stored_at"))], schema.MESSAGE)
        size = df.select(S.record_bytes(*[F.col(c) for c in ("offset", "topic", "payload", "key", "timestamp", "stored_at")])).first()[0]
        assert size == len(framed.encode(m))


def test_framed_files_stop_at_the_first_bad_frame(spark, tmp_path):
    good = [{"offset": k, "topic": "t", "payload": b"p%d" % k, "key": "k" if k else None, "timestamp": k, "stored_at": 9} for k in range(3)]
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / f"{0:020d}.log").write_bytes(b"".join(map(framed.encode, good)) + struct.pack(">i", 99) + b"short")
    (folder / f"{7:020d}.log").write_bytes(struct.pack(">i", 0))
    (folder / "notes.txt").write_text("no")
    found = framed.read(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r.segment_base, r.topic_dir, r.offset, bytes(r.payload), r.key) for r in found] == [(0, "t", k, b"p%d" % k, "k" if k else None) for k in range(3)]


def test_offsets_file(spark, tmp_path):
    (tmp_path / "o").write_text("#x\ng/t=5\ng/t/u=6\nbad\ng/u=x\n")
    assert [r[:] for r in framed.read_offsets(spark, str(tmp_path / "o")).collect()] == [("g", "t", 5)]


def test_ledger_batches_can_run_again(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "log"))
    rows = lambda *keys: spark.createDataFrame([(k, "t" if k % 2 else "u") for k in keys], "k long, topic string")
    assert ledger.append_batch(rows(1, 2, 3), ["k"], 7, batch_id=0) == 3
    assert ledger.append_batch(rows(1, 2, 3), ["k"], 7, batch_id=0) == 0
    rows(8, 9).write.parquet(str(tmp_path / "log/batch=1"))  # left by a run that failed before it published
    assert ledger.append_batch(rows(4, 5), ["k"], 8, batch_id=1) == 2
    assert [(r.offset, r.k) for r in ledger.read().orderBy("offset").collect()] == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    assert ledger.next_offset() == 5


def test_config():
    assert schema.LogConfig.from_options({"lease_ms": "5"}, {"lease_ms": 7}).lease_ms == 7
    assert schema.LogConfig.parse_properties("# c\n a = 1\n\nb=x=y") == {"a": "1", "b": "x=y"}
    for bad in ({"lease_ms": 0}, {"dlq_prefix": " "}, {"nope": 1}):
        with pytest.raises(ValueError):
            schema.LogConfig.from_options(bad)
    assert [schema.page_limit(n) for n in (None, 0, 7, 500)] == [10, 1, 7, 100]


def test_charts(spark):
    pie = metrics.pie(spark.createDataFrame([("a", -1.0), ("b", 0.0)], "n string, v double"), "n", "v").collect()
    assert all(r.share == 0 for r in pie)
    flat = spark.createDataFrame([(0.0, 0.0)], "y0 double, y1 double")
    assert metrics.domain(flat).first()[:] == (0.0, 1.0)
    series = spark.createDataFrame([([0.0, 10.0],), ([],)], "v array<double>")
    assert [r.points for r in metrics.resample(series, "v", 3).collect()] == [[0.0, 5.0, 10.0], [0.0, 0.0, 0.0]]


def test_replica_replay(spark):
    rows = [(1, 1, "t", b"a", None, 5, "MESSAGE", None, None), (1, 2, "t", None, None, 6, "OFFSET_COMMIT", "g", 1), (1, 3, "t", b"b", None, 7, "MESSAGE", None, None), (1, 4, "t", b"c", None, 8, "MESSAGE", None, None)]
    messages, commits = replica.replay(spark.createDataFrame(rows, schema.RAFT_ENTRY), 3)
    assert [(r.offset, bytes(r.payload)) for r in messages.orderBy("offset").collect()] == [(0, b"a"), (1, b"b")]
    assert commits.first()[:] == ("g", "t", 1)


def test_rpc_prefix_takes_one_at_least(spark):
    df = spark.createDataFrame([("t", 1, 100), ("t", 2, 1), ("u", 1, 3), ("u", 2, 3), ("u", 3, 9)], "topic string, index long, size long")
    assert sorted((r["topic"], r["index"]) for r in replica.rpc_prefix(df, ["topic"], "size", most=5, most_bytes=10).collect()) == [("t", 1), ("u", 1), ("u", 2)]


def test_negative_and_long_lengths_are_corrupt():
    import pytest

    from millrace.sources import framed

    for size in (-11, -1, 1 << 40, 6):
        with pytest.raises(framed.CorruptRecord):
            framed.decode(bytes([26]) + framed._number(size) + b"short")
    good = framed.encode({"offset": 1, "topic": "t"})
    assert [m["offset"] for m in framed.records(good + b"\x00\x00\x00\x0b" + bytes([26]) + framed._number(-11))] == [1]


def test_message_lag_of_logs_with_gaps(spark):
    from millrace.operators import replica

    entries = spark.createDataFrame([(10, 4), (20, 5), (40, 6)], "index long, batch_size long")
    followers = spark.createDataFrame([("a", 9), ("b", 10), ("c", 15), ("d", 39), ("e", 40), ("f", None), ("g", 0)], "node string, match_index long")
    found = {r.node: r.message_lag for r in replica.message_lag(followers, entries, 40).collect()}
    assert found == {"a": 15, "b": 11, "c": 11, "d": 6, "e": 0, "f": -1, "g": 15}


def test_json_keeps_its_kinds(spark):
    from pyspark.sql import functions as F

    from millrace.functions import scalars

    texts = ['1, 2', '1],[2', '1},{"v":2', '1, "w": 2', '[1, {"b": null}]', '"x"', '{"k": 5}', '{"a": {"b": [1, true]}}', '{"a":1} x', "plain", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", scalars.pretty_json(F.col("t")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == ['1, 2', '1],[2', '1},{"v":2', '1, "w": 2', '[1,{"b":null}]', '"x"', '{"k":5}', '{"a":{"b":[1,true]}}', '{"a":1} x', "plain", "", None]


def test_shared_folders_are_asked_for_on_clusters():
    from types import SimpleNamespace

    import pytest

    from millrace.storage import shared_dir

    conf = SimpleNamespace(get=lambda k: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")))
