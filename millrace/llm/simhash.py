"""SimHash near-duplicates: fingerprints of word shingles, compared exactly, tile by tile.

Fingerprints are dealt into tiles by the population counts of their four 16-bit quarters.
Two fingerprints differ in at least as many bits as those counts do in sum, so a pair of
tiles whose counts differ beyond the radius is skipped without losing a link. What
remains is compared exactly: numpy exclusive-or and bit counts, a block of a tile against a
block of another. A task returns a spanning forest of the links it finds, never all pairs.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, fresh, join_hot, parts, small
from millrace.llm.components import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
QUARTERS, QUARTER_BITS = 4, 16
#: Hashes whose bits one pass counts, and bytes of a long text that are cut into words at a time.
_HASHES_AT_ONCE = 1 << 17
_BYTES_AT_ONCE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> Iterator[list[int]]:
    """XXH64 of every shingle of a text, repeats included, in lists of bounded size; of the whole sequence where words are few; none without words."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    h = functools.partial(xxhash.xxh64_intdigest, seed=seed)
    at, n, before = 0, len(data), []
    while at < n:
        end = n
        if n - at > _BYTES_AT_ONCE and (space := _SPACE.search(data, at + _BYTES_AT_ONCE)):
            end = space.start()
        words = before + data[at:end].split()
        if len(words) >= width:
            yield list(map(h, map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))))
        elif words and at == 0 and end == n:
            yield [h(b" ".join(words))]
        elif words and end == n and not data[:at].split(None, width)[width - 1 :]:
            yield [h(b" ".join(words))]  # white space fills all but few words of a long text
        before, at = words[1 - width :] if width > 1 else [], end


def fingerprints_of(texts: Iterable[str | None], width: int = 3, seed: int = 42) -> np.ndarray:
    """uint64 fingerprints: a bit is 1 if it is set in over half the hashes; 0 without words."""
    texts = list(texts)
    ones, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[int] = []
    starts: list[int] = []
    owners: list[int] = []

    def count() -> None:
        flat = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.at(ones, owners, np.add.reduceat(flat, starts, axis=0, dtype=np.int32))
        held.clear(), starts.clear(), owners.clear()

    for k, text in enumerate(texts):
        for hashes in shingle_hashes(text, width, seed):
            n[k] += len(hashes)
            starts.append(len(held))
            owners.append(k)
            held += hashes
            if len(held) >= _HASHES_AT_ONCE:
                count()
    if held:
        count()
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the unsigned fingerprint as a signed long) of every row; null texts have no words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts(batches):
            fps = fingerprints_of(rows.column(1).to_pylist(), width, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, "doc_id long, fp long")


def fingerprint_of(text: Column, width: int = 3, seed: int = 42) -> Column:
    """The fingerprint of a text, as fingerprints() gives it."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            each = [fingerprints_of(batch.slice(k, 500).to_pylist(), width, seed) for k in range(0, len(batch), 500)]
            yield pa.array(np.concatenate(each).view(np.int64) if each else [], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")(text)


def _forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between a and b that connect whatever a and b's links within the radius connect."""
    parent = list(range(len(a) if same else len(a) + len(b)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        for x, y in zip((i + at).tolist(), j.tolist(), strict=True):
            if same and x >= y:
                continue
            p, q = root(x), root(y if same else len(a) + y)
            if p != q:
                parent[q] = p
                links.append((x, y))
    found = np.array(links, np.int64).reshape(-1, 2)
    return a[found[:, 0]], b[found[:, 1]]


def _near_tiles(radius: int) -> list[list[int]]:
    """Of each pair of opposite tile offsets within the radius, one; the tile itself first."""
    reach = range(-radius, radius + 1)
    near = [d for d in itertools.product(reach, repeat=QUARTERS) if sum(map(abs, d)) <= radius]
    return [list(d) for d in near if d >= (0,) * QUARTERS]


def dealt_blocks(sizes: DataFrame) -> DataFrame:
    """tile, block of every block of sizes (tile, blocks)."""
    return sizes.select("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))


def links(fps: DataFrame, radius: int, block: int = 8192) -> DataFrame:
    """Links (a, b) between distinct fingerprints of fps (fp) that connect all pairs within the radius.

    A tile is dealt, by hash, into blocks of about `block` fingerprints, so that a hot one spreads over tasks.
    """
    quarter = [F.bit_count(F.shiftrightunsigned("fp", QUARTER_BITS * k).bitwiseAND(0xFFFF)).cast("int") for k in range(QUARTERS)]
    tiled = fps.select("fp", F.array(*quarter).alias("tile"))
    # At most 17 ** 4 tiles: their counts are safe to broadcast.
    sizes = durable(tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))
    dealt = tiled.join(F.broadcast(sizes), "tile").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    blocks = durable(dealt.groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")))

    near = F.array(*[F.array(*[F.lit(x) for x in d]) for d in _near_tiles(radius)])
    # Which blocks meet is decided on their names alone; a block then moves once for each block that it meets.
    offers = dealt_blocks(sizes).withColumn("d", F.explode(near)).withColumn("to", F.zip_with("tile", "d", lambda x, y: x + y))
    offers = offers.join(F.broadcast(sizes.select(F.col("tile").alias("to"), F.col("blocks").alias("to_blocks"))), "to").withColumn("to_block", F.explode(F.sequence(F.lit(0), F.col("to_blocks") - 1)))
    itself = F.col("to") == F.col("tile")
    offers = offers.where(~itself | (F.col("to_block") >= F.col("block"))).select("tile", "block", (itself & (F.col("to_block") == F.col("block"))).alias("same"), "to", "to_block")
    pairs = blocks.withColumnRenamed("fps", "left").join(offers, ["tile", "block"])
    pairs = pairs.join(blocks.select(F.col("tile").alias("to"), F.col("block").alias("to_block"), F.col("fps").alias("right")), ["to", "to_block"])

    def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_forest(np.asarray(x).view(np.uint64), np.asarray(y).view(np.uint64), radius, same) for x, y, same in zip(batch["left"], batch["right"], batch["same"], strict=True)]
            yield pd.DataFrame({k: np.concatenate([f[n] for f in found] or [np.array([], np.uint64)]).view(np.int64) for n, k in enumerate("ab")})

    return pairs.select("left", "right", "same").mapInPandas(compare, "a long, b long")


def near_groups(docs: DataFrame, radius: int = 2, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row: the smallest doc_id reachable over fingerprints within the radius.

    Null, empty and blank texts have fingerprint 0, which links like any other. Null ids get a
    component but never name one, unless all ids of it are null. Rows that repeat are all returned.
    An empty table gives no rows; other columns of docs are ignored.
    """
    found = durable(fingerprints(docs, id_col, text_col, width, seed))
    firsts = durable(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")))
    linked = components(links(firsts.select("fp"), radius)).withColumnRenamed("node", "fp")
    # Only fingerprints that have links move; the rest are components of their own.
    least = linked.join(firsts.drop("rows"), "fp").groupBy("component").agg(F.min("first").alias("component_id"))
    moved = linked.join(least, "component").select("fp", "component_id")
    named = durable(firsts.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "rows"))
    return join_hot(found, named, "fp", "rows").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, radius: int = 2, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id names their component, with all their columns: one document of each group stays.

    A row is dropped by its id and fingerprint, so rows of other texts that share the id stay. Rows that repeat
    the staying id all stay; rows with a null id stay only where all ids of their group are null.
    """
    key, fp, own = fresh(docs, "dropped"), fresh(docs, "dropped_fp"), fresh(docs, "own_fp")
    groups = near_groups(docs, radius, width, seed, id_col, text_col)
    dropped = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key), F.col("fp").alias(fp))
    dropped = small(durable(dropped.distinct()))
    rows = docs.withColumn(own, fingerprint_of(F.col(text_col), width, seed))
    return rows.join(dropped, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(own) == F.col(fp)), "left_anti").select(*docs.columns)
