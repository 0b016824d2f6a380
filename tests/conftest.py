import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("BENCH_DRIVER_MEMORY", "4g")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session

    session = local_session("tests", cpus=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{SF}/{name}')")
    return con


def rows_of(columns, rows):
    """Rows in a form that two engines share, sorted."""

    def plain(x):
        if isinstance(x, float):
            return round(x, 6)
        if isinstance(x, bool):
            return int(x)
        if isinstance(x, datetime.datetime):
            return x.replace(tzinfo=None).isoformat()
        return x

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in rows], key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query and its SQL give the same rows."""

    def check(query, sql):
        df = query(spark, SF)
        found = df.collect()
        con = duck.execute(sql)
        names = [c[0] for c in con.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, found) == rows_of(names, con.fetchall())

    return check
