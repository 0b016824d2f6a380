"""Versioned tables, offset commits and the archive."""

from millrace.operators import segments
from millrace.sources import framed
from millrace.sources.sinks import VersionedTable, archive_expired, commit_offsets

SCHEMA = "group string, topic string, committed long"


def test_commits_replace_and_may_go_back(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "offsets"))
    assert table.read(SCHEMA).count() == 0
    for rows in ([("g", "t", 5), ("g", "u", 1)], [("g", "t", 2)], [("h", "t", 9)]):
        commit_offsets(table, spark.createDataFrame(rows, SCHEMA))
    assert sorted(r[:] for r in table.read(SCHEMA).collect()) == [("g", "t", 2), ("g", "u", 1), ("h", "t", 9)]


def test_unpublished_versions_are_not_read(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "offsets"))
    table.write(spark.createDataFrame([("g", "t", 1)], SCHEMA))
    spark.createDataFrame([("g", "t", 7)], SCHEMA).write.parquet(str(tmp_path / "offsets/left_over"))
    assert [r.committed for r in table.read(SCHEMA).collect()] == [1]


def test_archive_then_union_gives_everything_back(spark, tmp_path):
    m = spark.createDataFrame([("t", o, o // 10 * 10, f"p{o}") for o in range(30)], "topic string, offset long, segment_base long, payload string")
    gone = spark.createDataFrame([("t", 0, 10)], "topic string, base long, next_base long")
    hot = archive_expired(m, gone, str(tmp_path / "archive"))
    assert hot.count() == 20
    archived = spark.read.parquet(str(tmp_path / "archive")).select("topic", "offset", "segment_base", "payload")
    both = segments.with_archive(hot, archived)
    assert sorted((r.offset, r.payload) for r in both.collect()) == [(o, f"p{o}") for o in range(30)]


def test_framed_messages_recover_the_catalogue(spark, tmp_path):
    from millrace.operators import log

    for topic, offsets in (("a", [0, 2]), ("b", [1, 5])):
        (tmp_path / topic).mkdir()
        (tmp_path / topic / f"{0:020d}.log").write_bytes(b"".join(framed.encode({"offset": o, "topic": topic, "payload": b"x", "timestamp": 1, "stored_at": 1}) for o in offsets))
    (tmp_path / "raft").mkdir()
    (tmp_path / "raft" / f"{0:020d}.log").write_bytes(framed.encode({"offset": 99, "topic": "raft", "payload": b"x"}))
    found = framed.read(spark, str(tmp_path))
    assert log.next_offset(found).first()[0] == 6
    assert {r.topic: r.head for r in log.heads(found).collect()} == {"a": 2, "b": 5}
