"""Best-fit packing of documents into training sequences of a fixed number of tokens.

Bounded-space online best-fit: each packing task has a fixed number of open sequences, found
through a bitset keyed by free space; a piece goes where the least space that holds it is
free, and where none is, and all may be open that may, the fullest closes. Pieces arrive
through a bounded look-ahead that hands on its longest first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import durable, parts
from millrace.llm.tokens import word_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Places sizes of 1 to capacity online; at most open_bins bins are open at once.

    The state is bounded: a bitset of the free spaces that open bins have, and for each
    such space the bins that have it. Of equal fits the bin opened last is taken.
    """

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.most = capacity, open_bins
        self.free_bits, self.by_free, self.open, self.next_bin = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.free_bits ^= 1 << free
        return found

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        if fits := self.free_bits >> size:
            free = size + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if size < self.capacity:
                if self.open >= self.most:  # the fullest has the least free space
                    self._take((self.free_bits & -self.free_bits).bit_length() - 1)
                    self.open -= 1
                self.open += 1
            at, free = self.next_bin, self.capacity
            self.next_bin += 1
        if left := free - size:
            self.by_free[left].append(at)
            self.free_bits |= 1 << left
        elif free < self.capacity:
            self.open -= 1
        return at, self.capacity - free


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only more than capacity are cut, and only the first piece may be short."""
    short = n % capacity or capacity if n > capacity else n
    return [(0, short), *((at, capacity) for at in range(short, n, capacity))]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's tokens and its end id."""
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for rows in parts(batches):
            doc_ids, pieces, starts, lengths, sums = [], [], [], [], []
            for doc_id, ids in zip(rows.column(0).to_pylist(), bpe.encode(rows.column(1).to_pylist()), strict=True):
                ids += end
                for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    doc_ids.append(doc_id)
                    pieces.append(k)
                    starts.append(at)
                    lengths.append(n)
                    sums.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
            columns = [pa.array(doc_ids, pa.int64()), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(encode, PIECES)


def pack(pieces: DataFrame, capacity: int, open_bins: int = 4096, look_ahead: int = 16_384, task_pieces: int = 200_000) -> DataFrame:
    """pieces with sequence_id and offset; length is 1 to capacity.

    Pieces are dealt evenly, by a hash of doc_id and piece, to tasks of about task_pieces;
    each packs its own. A task holds look_ahead rows and open_bins numbers.
    """
    tasks = max(1, math.ceil(pieces.count() / task_pieces))

    def packed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, first = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40

        def placed(ahead: list[pd.DataFrame]) -> pd.DataFrame:
            out = pd.concat(ahead).sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
            at = [bins.place(n) for n in out["length"]]
            return out.assign(sequence_id=[first + b for b, _ in at], offset=[o for _, o in at])

        ahead, held = [], 0
        for batch in batches:
            ahead.append(batch)
            held += len(batch)
            if held >= look_ahead:
                yield placed(ahead)
                ahead, held = [], 0
        if held:
            yield placed(ahead)

    # Sorted, so that a task that runs again packs alike.
    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "start", "ids_crc32")).sortWithinPartitions("doc_id", "piece", "ids_crc32")
    return dealt.mapInPandas(packed, T.StructType(pieces.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty: they pack as their end id alone. Rows that repeat, or whose id is
    null, are packed like any other. An empty table gives no rows. Other columns of docs are ignored.
    Sequences fill from offset 0 without gaps; a sequence's tokens past its last piece are padding.
    """
    return pack(durable(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col)), capacity, **options)
