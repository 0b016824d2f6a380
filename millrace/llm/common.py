"""What the text operators share: white space, shared storage and column checks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.storage import durable, shared_dir

__all__ = ["durable", "fresh", "join_hot", "let", "normal_space", "parts", "shared_dir", "small", "table", "words"]

#: White space of the text contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
#: Runs that are not already one plain space; replacing them gives what replacing every run would.
UNEVEN_SPACE = rf"[\x09-\x0D]{SPACE}*|\x20{SPACE}+"


def normal_space(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACE, " ")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"{SPACE}+"), lambda w: w != F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body refers to it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parts(batches: Iterable[pa.RecordBatch], most_rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows of batches, few at a time: what is made of long texts then stays small beside the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, most_rows):
            yield batch.slice(at, most_rows)


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df, which must be durable() and narrow, to be broadcast in a join if it has at most most_rows; else as it is."""
    return F.broadcast(df) if df.count() <= most_rows else df


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "inner", hot: int = 1_000_000) -> DataFrame:
    """left.join(right, key, how), where right has one row a key and counts, in `rows`, how many of left have it.

    right must be durable(). Keys of over `hot` rows, one in as many rows of left at most, are joined by
    broadcast, so that their rows stay spread out; the others meet by key.
    """
    few = right.where(F.col(rows) > hot)
    if few.isEmpty():
        return left.join(right, key, how)
    few = small(few)
    return left.join(few.select(key), key, "left_anti").join(right, key, how).unionByName(left.join(few, key))
