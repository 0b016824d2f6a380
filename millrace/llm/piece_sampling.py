"""SentencePiece encoding by sampled segmentation, and lossless decoding.

A text is cut into units where no piece of the model could lie across: before spaces, and
between characters that stand side by side in no piece. Its piece lattice is that of its units, one
after another. Forward filtering sums the weight of all segmentations up to every place
of a unit, once a different unit; backward sampling then draws, from a unit's end, the piece that ends
there. Draws come from the row's key, the unit's number and the step alone: a row is
segmented alike wherever it runs.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = "▁"  # how pieces write a space
_NOT_A_PIECE = "\x00"  # stands for a text's own U+2581, which only byte pieces may encode
_UNITS = re.compile(" *[^ ]+| +")
_AT_ONCE = 1_500_000
#: New edges that wait in lists, at some 100 bytes each.
_NEW_EDGES = 200_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's output function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PieceSampler:
    """Lattices of a model's pieces. The weight of a piece is exp(alpha * score); scores are minus ranks, and ranks past
    the number of pieces, which mark pieces that merging never makes, count as that.

    limit bounds the edges of lattices that are kept: beyond it new ones are dropped after use, and
    collecting starts anew after as many again were dropped.
    """

    def __init__(self, path: str, alpha: float = 0.001, limit: int = 16_000_000) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = {i for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.ids = {model.id_to_piece(i): (i, math.exp(alpha * max(model.get_score(i), -n))) for i in range(n) if i not in special}
        self.longest = max(map(len, self.ids))
        self.roots = self._trie()
        self.joined = {x[k : k + 2].replace(_SPACE, " ") for x in self.ids for k in range(len(x) - 1)}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.bytes) < 256 or (_SPACE not in self.ids):
            raise ValueError(f"{path} can't encode every text: it lacks byte pieces or the space")
        self.byte_weight = math.exp(-alpha * n)
        # What each piece decodes to; control pieces to nothing.
        self.decoded = [b"" if i in special else model.id_to_piece(i).replace(_SPACE, " ").encode() for i in range(n)]
        for b, i in self.bytes.items():
            self.decoded[i] = bytes([b])
        self.lengths = np.array([len(model.id_to_piece(i)) for i in range(n)])
        self.limit = limit
        self._clear()

    def _trie(self) -> dict:
        """Of a piece's first characters: by the next one (a dictionary alike or None, id or None, weight)."""
        roots: dict = {}
        for x, (i, w) in sorted(self.ids.items(), reverse=True):  # longer ones come first, so that what begins so is known
            kids = roots
            for c in x[:-1]:
                if c not in kids:
                    kids[c] = ({}, None, 0.0)
                kids = kids[c][0]
            kids[x[-1]] = (kids[x[-1]][0] if x[-1] in kids else None, i, w)
        return roots

    def _clear(self) -> None:
        self.words: dict[str, tuple[int, ...]] = {}  # units' ends of a stretch of text, which goes without its first space here
        self.units: dict[str, int] = {}  # the node at a unit's end; its start is a node without edges
        self.edge_start, self.edge_share, self.edge_from, self.edge_piece = array("i"), array("d"), array("i"), array("i")
        self.runs: list[list[int]] = []  # pieces that only stand together: a character's bytes
        self._settled()
        self.new: list[tuple[dict, str]] = []
        self.dropped = 0

    def _ends(self, word: str) -> tuple[int, ...]:
        joined = self.joined
        cuts = [k for k, pair in enumerate(map(str.__add__, word, word[1:]), 1) if pair not in joined]
        ends = []
        for i, j in zip([0, *cuts], [*cuts, len(word)], strict=True):
            unit = word[i:j]
            if (end := self.units.get(unit)) is None:
                end = self._add(unit)
                self.units[unit] = end
                self.new.append((self.units, unit))
            ends.append(end)
        self.words[word[1:]] = found = tuple(ends)
        self.new.append((self.words, word[1:]))
        return found

    def _settled(self) -> None:
        """No edges are new: nodes counts all, and the lists of new edges and of new nodes' weights are empty."""
        self.nodes = len(self.edge_start)
        self.new_weight: list[float] = []
        self.new_piece: list[int] = []
        self.new_into: list[int] = []
        self.new_total: list[float] = []

    def _add(self, unit: str) -> int:
        """The node at the end of the unit's lattice, after filtering forward; _settle() makes its edges ready."""
        text = unit.replace(_SPACE, _NOT_A_PIECE).replace(" ", _SPACE)
        n, roots, base, already = len(text), self.roots, self.nodes, len(self.new_weight)
        weigh, name, into = self.new_weight.append, self.new_piece.append, self.new_into.append
        total = [1.0] + [0.0] * n
        open_edges = self.longest * (self.longest + 1)  # no more of the last ones can lead to a place that is open
        for i in range(n):
            at = total[i]
            if at < 1e-150:  # long units: only ratios at one place count, so what is open is scaled up
                for j in range(i, min(n, i + self.longest) + 1):
                    total[j] *= 1e150
                for k in range(max(already, len(self.new_weight) - open_edges), len(self.new_weight)):
                    if self.new_into[k] >= base + i:
                        self.new_weight[k] *= 1e150
                at = total[i]
            alone, kids, j = False, roots, i
            while kids and j < n and (found := kids.get(text[j])):
                j += 1
                kids, piece, weight = found
                if piece is not None:
                    w = at * weight
                    weigh(w)
                    name(piece)
                    into(base + j)
                    total[j] += w
                    alone = alone or j == i + 1
            if not alone:
                raw = [self.bytes[b] for b in unit[i].encode("utf-8", "surrogatepass")]
                w = at * self.byte_weight ** len(raw)
                weigh(w)
                name(-1 - len(self.runs))
                into(base + i + 1)
                total[i + 1] += w
                self.runs.append(raw)
        self.new_total += total
        self.nodes += n + 1
        if len(self.new_weight) > _NEW_EDGES:
            self._settle()
        return base + n

    def _settle(self) -> None:
        """Puts new edges in the order of the nodes they lead to, then of those they come from, with running shares at each node."""
        first = len(self.edge_start)
        if self.nodes == first:
            return
        into = np.array(self.new_into) - first
        order = np.argsort(into, kind="stable")
        into, piece = into[order], np.array(self.new_piece)[order]
        share = np.array(self.new_weight)[order] / np.array(self.new_total)[into]
        counts = np.bincount(into, minlength=self.nodes - first)
        start = np.cumsum(counts) - counts
        for k in range(1, int(counts.max())):
            at = start[counts > k] + k
            share[at] += share[at - 1]
        share[(start + counts - 1)[counts > 0]] = 2.0
        source = into + first - np.where(piece < 0, 1, self.lengths[np.maximum(piece, 0)])
        self.edge_start.frombytes((start + len(self.edge_share)).astype(np.int32).tobytes())
        self.edge_share.frombytes(share.tobytes())
        self.edge_from.frombytes(source.astype(np.int32).tobytes())
        self.edge_piece.frombytes(piece.astype(np.int32).tobytes())
        self._settled()

    def encode(self, keys: Iterable[int | None], texts: Iterable[str | None], seed: int) -> Iterator[np.ndarray]:
        """The piece ids of every text, in order; none for null and empty ones. Texts are taken together as long as they are short."""
        held_keys, held, size = [], [], 0
        for key, text in zip(keys, texts, strict=True):
            held_keys.append(0 if key is None else key)
            held.append(text or "")
            size += len(held[-1])
            if size >= _AT_ONCE:
                yield from self._encode(held_keys, held, seed)
                held_keys, held, size = [], [], 0
        if held:
            yield from self._encode(held_keys, held, seed)

    def _encode(self, keys: list[int], texts: list[str], seed: int) -> Iterator[np.ndarray]:
        if self.dropped > self.limit:
            self._clear()
        sizes = [len(x) for x in (self.edge_start, self.edge_share, self.runs)]
        ends, counts = array("i"), []
        get = self.words.get
        for text in texts:
            if not text:
                counts.append(0)
                continue
            units = text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " else [x[1:] for x in _UNITS.findall(f" {text}")]
            found = list(map(get, units))
            if None in found:
                found = [get(u) or self._ends(f" {u}") if e is None else e for u, e in zip(units, found, strict=True)]
            before = len(ends)
            ends.extend(itertools.chain.from_iterable(found))
            counts.append(len(ends) - before)
        self._settle()
        start, share, source, piece = (np.frombuffer(a, t) if len(a) else np.zeros(0, t) for a, t in ((self.edge_start, np.int32), (self.edge_share, np.float64), (self.edge_from, np.int32), (self.edge_piece, np.int32)))
        n = np.array(counts)
        node = np.frombuffer(ends, np.int32) if len(ends) else np.zeros(0, np.int32)
        key = _mix((np.array([k & (2**64 - 1) for k in keys], np.uint64) + np.uint64(seed)) * _GOLDEN)
        number = (np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
        state = _mix(np.repeat(key, n) + number * _GOLDEN)
        live = np.argsort(node, kind="stable")  # equal units side by side: look-ups stay in the cache
        node, state = node.take(live), state.take(live)
        lengths = np.zeros(len(node), np.int32)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        with np.errstate(over="ignore"):
            while len(live):
                state = state + _GOLDEN
                u = (_mix(state) >> np.uint64(11)) * 2.0**-53
                edge = start.take(node)
                behind = np.nonzero(share.take(edge) < u)[0]
                while len(behind):
                    edge[behind] = on = edge.take(behind) + np.int32(1)
                    behind = behind[share.take(on) < u.take(behind)]
                drawn.append((live, piece.take(edge)))
                lengths[live] += 1
                node = source.take(edge)
                # A unit's first node has no edges: its start is that of the next node.
                on = np.nonzero(start.take(node) != start.take(node + 1))[0]
                live, node, state = live.take(on), node.take(on), state.take(on)
        place = np.cumsum(lengths) - 1
        out = np.empty(int(lengths.sum()), np.int32)
        for k, (at, pieces) in enumerate(drawn):
            out[place[at] - k] = pieces
        per_text = np.add.reduceat(np.append(lengths, 0), np.minimum(np.cumsum(n) - n, len(lengths))) * (n > 0) if len(lengths) else n * 0
        del start, share, source, piece  # the arrays can't grow or shrink while they are looked into
        at = 0
        for m in per_text.tolist():
            ids = out[at : at + m]
            at += m
            if m and ids.min() < 0:
                ids = np.array([x for i in ids.tolist() for x in (self.runs[-1 - i] if i < 0 else (i,))], np.int32)
            yield ids
        if len(self.edge_share) > self.limit:
            self.dropped += len(self.edge_share) - sizes[1]
            for known, x in self.new:
                del known[x]
            del self.edge_start[sizes[0] :], self.runs[sizes[2] :]
            for kept in (self.edge_share, self.edge_from, self.edge_piece):
                del kept[sizes[1] :]
            self._settled()
        self.new = []

    def decode(self, ids: np.ndarray) -> str:
        """The text that was encoded, whatever the segmentation."""
        return b"".join(map(self.decoded.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


@functools.cache
def _sampler(path: str, alpha: float) -> PieceSampler:
    """One a worker process and model."""
    return PieceSampler(path, alpha)


def sampled_pieces(docs: DataFrame, model_path: str, seed: int = 0, alpha: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every row: a segmentation drawn by the row's id.

    Null and empty texts have no pieces. Null ids are drawn like id 0; rows that repeat an id and a text are segmented
    alike. An empty table gives no rows; other columns of docs are ignored.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = _sampler(model_path, alpha)
        for batch in batches:
            keys = batch["_id"].astype("Int64")
            ids = list(sampler.encode((None if k is pd.NA else int(k) for k in keys), batch["_text"], seed))
            yield pd.DataFrame({"doc_id": keys, "ids": ids})

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, "doc_id long, ids array<int>")


def decoded(encoded: DataFrame, model_path: str, alpha: float = 0.001) -> DataFrame:
    """doc_id, text of every row of sampled_pieces(); "" where there are no pieces."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = _sampler(model_path, alpha)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": [sampler.decode(np.asarray(x)) for x in batch["ids"]]})

    return encoded.mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, seed: int = 0, alpha: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32, lossless: encoding and decoding in one pass, so that ids needn't move. Rows as in sampled_pieces()."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = _sampler(model_path, alpha)
        for batch in batches:
            keys = batch["_id"].astype("Int64")
            rows = []
            for text, ids in zip(batch["_text"], sampler.encode((None if k is pd.NA else int(k) for k in keys), batch["_text"], seed), strict=True):
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), sampler.decode(ids) == (text or "")))
            out = pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "lossless"])
            out.insert(0, "doc_id", keys.array)
            yield out

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
