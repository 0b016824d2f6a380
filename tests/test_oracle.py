"""Every query that has SQL, against DuckDB on the smallest tables."""

import pytest

from millrace.plans import catalog
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys()))
def test_query_without_sql_runs(name, spark):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 20


def test_batch_and_stream_replay_agree(spark):
    columns = ["seq", "group", "topic", "op", "delivered_from", "delivered_to", "delivered_n", "committed", "dispatch", "routed_to_dlq"]
    batch, stream = (catalog.QUERIES[n](spark, SF).select(*columns).orderBy("seq").collect() for n in ("group_replay", "stream_group_replay"))
    assert batch == stream


def test_commit_ranges_come_from_the_whole_table(spark):
    ranges = catalog._commit_ranges(spark, SF.replace("0.001", "0.01"))
    messages = catalog.messages(spark, SF.replace("0.001", "0.01"))
    assert ranges.count() == messages.where("offset div 8 % 97 <> 96").count() > 4000
    assert ranges.agg({"from_offset": "max"}).first()[0] == messages.agg({"offset": "max"}).first()[0] // 8 * 8


def test_every_event_is_a_command(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert {r.seq for r in catalog.commands(spark, SF).select("seq").collect()} == {r.event_id for r in events.select("event_id").collect()}
    for name in ("group_replay", "stream_group_replay"):
        assert catalog.QUERIES[name](spark, SF).count() == events.count()
