"""Exact dedup: local, salted and global combining of equal texts, each on the whole content.

Rows whose text is equal after white space normalisation form a group; the row with
the smallest id stays. The plan never brings a hot group into one task:

1. *local*: a partial aggregate in each map task folds its equal texts to one row;
2. *salted*: those rows meet by (digest, salt), where the salt is the map task's
   number modulo ``salts``, so a group of any size gives at most one row a task;
3. *global*: at most ``salts`` winners of a digest meet by digest.

Every stage has the normalised text itself among its grouping keys: equal digests of
different texts stay apart. A count of digests, which has narrow rows, comes first; through
a bit filter of bounded size it keeps most texts that no other equals out of the exchanges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.common import durable, fresh, join_hot, normal_space, small


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _may_be_in(rows: DataFrame, digests: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """rows whose _digest is in digests, and few others.

    Through a filter of one hash and `bits` bits, in pages of 4 KB, that is broadcast: 4 MB
    at most, whatever the input. Where it fills up, more rows go on; none is lost.
    """
    place = F.pmod(F.xxhash64("_digest"), F.lit(bits))
    at = digests.select(place.alias("_at"))
    pages = at.groupBy(F.expr("bitmap_bucket_number(_at)").alias("_page")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_at))").alias("_bits"))
    placed = rows.withColumn("_at", place).withColumn("_page", F.expr("bitmap_bucket_number(_at)"))
    byte = F.expr("cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_at) div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr("cast(bitmap_bit_position(_at) % 8 as int)")
    return placed.join(F.broadcast(pages), "_page").where(F.getbit(byte, bit) == 1).select(*rows.columns)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex, salts: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept.

    Null texts count as empty and equal each other and blank texts of no characters.
    Of a group, the smallest id stays; null ids count as largest, and keep_id is null only
    where a whole group has null ids. Where rows repeat an id and a text, one of them is
    kept. Ties cannot change a result. Empty tables give no rows; other columns of docs
    are ignored, whatever their names.

    digest: normalised text to a digest column; any function gives the same groups.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normal_space(F.col(text_col)).alias("_text")).withColumn("_digest", digest(F.col("_text")))
    narrow = durable(rows.select("_id", "_digest"))
    smallest = F.min("_id").alias("_id")
    repeated = narrow.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest")

    local = _may_be_in(rows, repeated).withColumn("_salt", F.spark_partition_id() % salts)
    salted = local.groupBy("_digest", "_salt", "_text").agg(smallest, F.count(F.lit(1)).alias("_n"))
    winners = salted.repartition("_digest").groupBy("_digest", "_text").agg(smallest, F.sum("_n").alias("_n"))
    # Different texts under one digest are kept apart by their text; there are none under a sound digest.
    texts = F.count(F.lit(1)).over(Window.partitionBy("_digest"))
    winners = durable(winners.withColumn("_texts", texts).select("_digest", F.when(F.col("_texts") > 1, F.col("_text")).alias("_clash"), F.col("_id").alias("_keep"), "_n"))

    clashing = winners.where(F.col("_clash").isNotNull())
    # A hot group has one digest in all its rows: it is joined where they lie.
    found = join_hot(narrow, winners.where(F.col("_clash").isNull()).drop("_clash"), "_digest", "_n", "left")
    if not clashing.isEmpty():
        apart = rows.join(clashing.withColumnRenamed("_clash", "_text"), ["_digest", "_text"]).select(*found.columns)
        found = found.join(clashing.select("_digest").distinct(), "_digest", "left_anti").unionByName(apart)

    alone = F.col("_n").isNull()
    found = found.select(F.col("_id").alias("doc_id"), F.col("_digest").alias("digest"), F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("_n", F.lit(1)).cast(T.LongType()).alias("group_size"))
    # Repeats of an id within a group: one of them stays. Dealt by id first, so that a hot group stays spread out.
    nth = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("keep_id"))
    return found.repartition("doc_id").withColumn("kept", (nth == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex, salts: int = 16) -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns; one row where id and text repeat.

    Of rows that repeat id and text but differ in other columns, any one stays.
    """
    groups = durable(exact_groups(docs, id_col, text_col, digest, salts))
    again = F.col("keep_id").eqNullSafe(F.col("doc_id"))
    gone, key, mark = (fresh(docs, x) for x in ("gone", "key", "mark"))
    dropped = groups.where(~F.col("kept")).select(F.col("doc_id").alias(gone), F.col("digest").alias(mark), again.alias("again"))
    copies, repeats = (durable(dropped.where(kind).drop("again").distinct()) for kind in ("not again", "again"))
    keyed = docs.withColumn(key, digest(normal_space(F.col(text_col))))
    same = F.col(id_col).eqNullSafe(F.col(gone)) & (F.col(key) == F.col(mark))
    kept = keyed.join(small(copies), same, "left_anti")
    if not repeats.isEmpty():
        kept = kept.join(repeats, same, "left_anti").unionByName(kept.join(repeats, same, "left_semi").dropDuplicates([id_col, key]))
    return kept.drop(key)
