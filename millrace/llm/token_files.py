"""Token-id files: documents' ids in ascending id order, in independently reset, checksummed blocks.

A table of segments is written; each row is one binary segment that can be read alone:

    "MRT4", documents n and blocks m (uint32 each),
    n document ids (int64), n null marks (uint8), n numbers of ids (uint32),
    for each block its number of ids, its number of words and the crc32 of its ids (uint32 each),
    the words of all blocks (uint16), see id_codec,
    the crc32 of all before it (uint32).

All numbers are little-endian. A document lies within one segment, over as many blocks as it needs.
Segments are numbered by (part, segment); within and across them documents ascend.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import id_codec
from millrace.llm.common import parts, shared_dir
from millrace.llm.tokens import word_bpe

MAGIC = b"MRT4"
#: Ids of a block: what is reset, checked and decoded alone. Its own lanes share what it learns.
BLOCK = 1 << 21
#: Blocks that are coded at a time.
LANES = 1
#: Documents that are tokenised at a time, and the room for words that a worker keeps.
_ROWS, _KEPT_BYTES = 2500, 192_000_000
_SEGMENTS = "part long, segment long, n_tokens long, data binary"


class CorruptSegment(ValueError):
    """A segment that is cut short, foreign or fails a checksum."""


def to_segment(doc_ids: list[int | None], ids: list[bytes], block: int = BLOCK) -> bytes:
    """One segment from documents' ids as little-endian uint32 bytes; ids must be below 65,536.

    Beside the segment and its ids, memory is bounded: LANES blocks are coded at a time.
    """
    whole = np.frombuffer(b"".join(ids), "<u4")
    if len(whole) and int(whole.max()) >= 1 << 16:
        raise ValueError("ids of 65,536 and more don't fit this format")
    index, words = [], []
    for first in range(0, len(whole), LANES * block):
        blocks = [whole[at : at + block] for at in range(first, min(len(whole), first + LANES * block), block)]
        coded = id_codec.encode(blocks)
        index += [struct.pack("<III", len(b), len(w), zlib.crc32(b.tobytes())) for b, w in zip(blocks, coded, strict=True)]
        words += [w.astype("<u2").tobytes() for w in coded]
    n = len(doc_ids)
    head = [MAGIC, struct.pack("<II", n, len(index)), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids), np.array([len(x) // 4 for x in ids], "<u4").tobytes()]
    data = b"".join([*head, *index, *words])
    return data + struct.pack("<I", zlib.crc32(data))


def from_segment(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    """(document id, ids as uint32) of a segment, in order; CorruptSegment if a byte of it isn't as written."""
    if data[:4] != MAGIC or len(data) < 16:
        raise CorruptSegment("not a token segment")
    if zlib.crc32(memoryview(data)[:-4]) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        raise CorruptSegment("the segment fails its checksum")
    n, m = struct.unpack_from("<II", data, 4)
    at = 12
    doc_ids = np.frombuffer(data, "<i8", n, at)
    null = np.frombuffer(data, np.uint8, n, at + 8 * n)
    counts = np.frombuffer(data, "<u4", n, at + 9 * n)
    index = np.frombuffer(data, "<u4", 3 * m, at + 13 * n).reshape(m, 3).astype(np.int64)
    words = np.frombuffer(data, "<u2", int(index[:, 1].sum()), at + 13 * n + 12 * m)
    ends = np.cumsum(index[:, 1])
    whole = np.empty(int(index[:, 0].sum()), "<u4")
    at = 0
    for first in range(0, m, LANES):
        chosen = range(first, min(m, first + LANES))
        for k, ids in zip(chosen, id_codec.decode([words[ends[k] - index[k, 1] : ends[k]] for k in chosen], index[first : first + LANES, 0].tolist()), strict=True):
            whole[at : at + len(ids)] = ids
            if zlib.crc32(whole[at : at + len(ids)].tobytes()) != index[k, 2]:
                raise CorruptSegment(f"block {k} fails its checksum")
            at += len(ids)
    if int(counts.sum()) != len(whole):
        raise CorruptSegment("documents and blocks differ in size")
    starts = np.cumsum(counts.astype(np.int64)) - counts
    return [(None if z else int(d), whole[a : a + c]) for d, z, a, c in zip(doc_ids, null, starts.tolist(), counts.tolist(), strict=True)]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, segment_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends end_id and writes segments, of about segment_tokens ids or one document, to path.

    Null texts count as empty. Documents are dealt by ranges of their id and sorted by it;
    null ids come first, and equal ids stand side by side. Every document has its segment's
    place in the order, so parts can be read alone and in parallel.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = word_bpe(vocabulary, _KEPT_BYTES), TaskContext.get().partitionId()
        number, size = 0, 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "segment": [number], "n_tokens": [size], "data": [to_segment(doc_ids, ids)]})

        for rows in parts(batches, _ROWS):
            for doc_id, x in zip(rows.column(0).to_pylist(), bpe.encode(rows.column(1).to_pylist()), strict=True):
                doc_ids.append(doc_id)
                ids.append(x + end)
                size += len(x) // 4 + 1
                if size >= segment_tokens:
                    yield made()
                    number, size, doc_ids, ids = number + 1, 0, [], []
        if doc_ids:
            yield made()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows.repartitionByRange("_id").sortWithinPartitions("_id").mapInArrow(run, _SEGMENTS).write.parquet(path)


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, decoded from a table of segments."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, segment, data in zip(batch["part"], batch["segment"], batch["data"], strict=True):
                found = from_segment(bytes(data))
                n = np.array([len(x) for _, x in found], np.int64)
                yield pd.DataFrame({
                    "part": part, "segment": segment, "doc_id": pd.array([d for d, _ in found], "Int64"),
                    "at": np.cumsum(n) - n, "n_tokens": n, "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for _, x in found],
                })

    # One narrow row a segment, of millions of ids each: their running sum is one small task.
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = segments.select("part", "segment", before.alias("before"))
    found = segments.mapInPandas(run, "part long, segment long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "segment"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def through_files(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None, **options) -> DataFrame:
    """Writes docs' tokens to path, by default a new folder in the shared one, and reads them back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4()}"
    write_tokens(docs, path, vocabulary, end_id, **options)
    return read_tokens(spark.read.schema(_SEGMENTS).parquet(path))
