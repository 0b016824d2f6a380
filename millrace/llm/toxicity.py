"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

Both dictionaries hold what is common in ordinary text; the toxic one ends with what toxic
text has besides. A window is a word, in lower case and without marks around it, between
spaces and three times over: then a word that a dictionary knows costs one reference, and a word it doesn't know
costs its letters once. The two compressed lengths of a window and its own place it in a cell, the compressed ones
alone in a wider cell; how often labelled toxic and ordinary documents reach a cell calibrates the threshold on it.
What tells is learnt whole, up to a parameter far above what a sample of fit()'s size gives; ordinary text needs no more than
what is common in it, as a word that neither dictionary knows costs the same under both.
A document's score is the calibrated share of toxic documents at its most telling window.
"""

from __future__ import annotations

import dataclasses
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh

_MARKS = b".,!?;:\"'()[]{}*#$%&|<>-_"
_TIMES = 3
#: Bytes of the part that both dictionaries share; a large one makes references dear and matches by chance likely.
_SHARED_BYTES = 2048
#: Level of zstandard; higher ones skip the references in windows as short as these.
_LEVEL = 6
#: A worker keeps the verdict on so many different words.
_KEPT_WORDS = 200_000


def windows(text: str | None) -> set[bytes]:
    """The different windows of a whole text."""
    found = {w.strip(_MARKS) for w in (text or "").lower().encode("utf-8", "surrogatepass").split()}
    found.discard(b"")
    return found


def _grams(word: bytes) -> set[bytes]:
    """What may tell in a word: its parts of 5 and 6 bytes, and longer beginnings."""
    word = b" %b " % word
    return {word[k : k + n] for n in (5, 6) for k in range(len(word) - n + 1)} | {word[:n] for n in range(7, min(13, len(word)) + 1)}


def _distinct(texts: list[set[bytes]]) -> list[set[bytes]]:
    """Texts without those that share half of a sketch of eight words with an earlier one: copies count once."""
    seen: dict[int, int] = {}
    kept = []
    for k, words in enumerate(texts):
        sketch = sorted(map(zlib.crc32, words))[:8]
        shared = Counter(seen[s] for s in sketch if s in seen)
        if not sketch or (shared and 2 * shared.most_common(1)[0][1] >= len(sketch)):
            continue
        kept.append(words)
        for s in sketch:
            seen.setdefault(s, k)
    return kept


def _content(words: Iterable[bytes], size: int) -> bytes:
    """Words until size, the first at the end, where references are short."""
    out, n = [], 0
    for w in words:
        n += len(w) + 2
        if n > size:
            break
        out.append(b" %b " % w)
    return b"".join(reversed(out))


@dataclasses.dataclass
class Model:
    """toxic, ordinary: dictionary contents. cells: (toxic length, gain, own length), or the first two, to log odds. steps: log odds to score, rising."""

    toxic: bytes
    ordinary: bytes
    cells: dict[tuple[int, ...], float] = dataclasses.field(default_factory=dict)
    steps: list[tuple[float, float]] = dataclasses.field(default_factory=list)
    prior: float = 0.1

    def __post_init__(self) -> None:
        self._ready = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_ready": None}

    def _lengths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self._ready is None:
            made = []
            for content in (self.toxic, self.ordinary):
                params = zstandard.ZstdCompressionParameters.from_level(_LEVEL, source_size=64, dict_size=len(content), min_match=4, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0)
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                made.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params))
            self._ready = made
        repeated = [b" %b " % w * _TIMES for w in words]
        out = []
        for c in self._ready:
            found = c.multi_compress_to_buffer(repeated)
            out.append(np.fromiter(map(len, found), np.int64, len(words)))
        return out[0], out[1]

    def places(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        toxic, ordinary = self._lengths(words)
        return list(zip(toxic.tolist(), (ordinary - toxic).tolist(), map(len, words), strict=True))

    def odds(self, words: list[bytes]) -> list[float]:
        if not words:
            return []
        return [self.cells.get(x, self.cells.get(x[:2], -9.0)) for x in self.places(words)]

    def score(self, most: float) -> float:
        """Of a document whose most telling window has these log odds."""
        at = self.prior
        for odds, share in self.steps:
            if most < odds:
                break
            at = share
        return at


def train(toxic_texts: list[str | None], ordinary_texts: list[str | None], most_bytes: int = 65_536) -> Model:
    """Two thirds of the texts, as they come and without copies, make the dictionaries; the rest confirm and calibrate.

    Without toxic or without ordinary texts the model scores all documents alike, by the share of toxic ones.
    """
    toxic, ordinary = ([windows(t) for t in texts] for texts in (toxic_texts, ordinary_texts))
    prior = (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1)
    if not toxic or not ordinary:
        return Model(b"", b"", prior=prior)
    toxic, ordinary = _distinct(toxic), _distinct(ordinary)
    split = lambda x: (x[: math.ceil(len(x) * 2 / 3)], x[math.ceil(len(x) * 2 / 3) :] or x)
    (toxic, toxic_held), (ordinary, ordinary_held) = split(toxic), split(ordinary)
    n, m = max(1, len(toxic)), max(1, len(ordinary))

    in_toxic, in_ordinary = Counter(w for x in toxic for w in x), Counter(w for x in ordinary for w in x)
    toxic_grams: Counter = Counter()
    for x in toxic:
        toxic_grams.update(set().union(*map(_grams, x)) if x else ())
    ordinary_grams: Counter = Counter()
    for w, c in in_ordinary.items():
        for g in _grams(w) & toxic_grams.keys():
            ordinary_grams[g] += c
    # What tells is common in toxic documents, rare in ordinary ones, and so in documents that it wasn't found in.
    telling = {g for g, c in toxic_grams.items() if c >= max(3, 0.02 * n) and c / n >= 25 * (ordinary_grams[g] + 0.5) / m}
    confirmed = Counter(g for x in toxic_held for g in set().union(*map(_grams, x)) & telling)
    telling = {g for g in telling if confirmed[g] >= max(1, 0.02 * len(toxic_held))}
    words = sorted(((-c, w) for w, c in in_toxic.items() if _grams(w) & telling))
    extra = _content((w for _, w in words), most_bytes)
    common = [w for _, w in sorted((-c, w) for w, c in in_ordinary.items())]
    base = _content(common, _SHARED_BYTES)
    end = b"\n" * 16  # zstandard doesn't look up what begins in a dictionary's last bytes
    model = Model(base + extra + end, _content(common, _SHARED_BYTES + len(extra)) + end, prior=prior)

    def reached(texts: list[set[bytes]]) -> tuple[Counter, list[set[tuple[int, ...]]]]:
        each = [set(model.places(sorted(x))) if x else set() for x in texts]
        return Counter(p for x in each for p in x), each

    of_toxic, each_toxic = reached(toxic_held)
    of_ordinary, each_ordinary = reached(ordinary_held)
    a, b = len(each_toxic), len(each_ordinary)
    for x in (*each_toxic, *each_ordinary):
        x |= {p[:2] for p in x}
    for found, each in ((of_toxic, each_toxic), (of_ordinary, each_ordinary)):
        found.update(Counter(p for x in each for p in x if len(p) == 2))
    # A cell that few toxic documents reach tells nothing, however few ordinary ones do.
    model.cells = {p: math.log((c + 0.1) / (a + 1)) - math.log((of_ordinary[p] + 0.5) / (b + 1)) for p, c in of_toxic.items() if c >= 2 and p[1] > 0}

    most = lambda x: max((model.cells.get(p, model.cells.get(p[:2], -9.0)) for p in x if len(p) == 3), default=-9.0)
    pool = [[o, y, 1.0] for o, y in sorted([(most(x), 1.0) for x in each_toxic] + [(most(x), 0.0) for x in each_ordinary])]
    steps: list[list[float]] = []  # lowest odds, toxic, all; pooled until shares rise
    for o, y, w in pool:
        if steps and steps[-1][0] == o:
            steps[-1][1] += y
            steps[-1][2] += w
        else:
            steps.append([o, y, w])
    rising: list[list[float]] = []
    for step in steps:
        rising.append(step)
        while len(rising) > 1 and rising[-2][1] * rising[-1][2] >= rising[-1][1] * rising[-2][2]:
            last = rising.pop()
            rising[-1] = [rising[-1][0], rising[-1][1] + last[1], rising[-1][2] + last[2]]
    model.steps = [(o, (y + 0.25 * prior) / (w + 0.25)) for o, y, w in rising]
    return model


def score_of(text: Column, model: Model) -> Column:
    """The score, 0 to 1, of every whole text. Null, empty and blank texts score like texts without telling windows."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept: dict[bytes, float] = {}
        for batch in batches:
            scores = []
            for at in range(0, len(batch), 500):
                for text in batch.slice(at, 500).to_pylist():
                    words = windows(text)
                    if missing := [w for w in words if w not in kept]:
                        if len(kept) + len(missing) > _KEPT_WORDS:
                            kept, missing = {}, list(words)
                        kept.update(zip(missing, model.odds(missing), strict=True))
                    scores.append(model.score(max(map(kept.__getitem__, words), default=-9.0)))
            yield pa.array(scores, pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text)


def trainable(doc_id: str = "doc_id") -> Column:
    """Rows that labels may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 1000, most_ordinary: int = 2000, most_chars: int = 40_000_000, most_bytes: int = 65_536, seed: int = 7) -> Model:
    """A model from a bounded sample of labelled rows: at most most_toxic and most_ordinary documents.

    The sample is drawn by a hash of the id, from rows that trainable() allows, and ends
    early at most_chars characters of either kind. most_bytes bounds what the toxic dictionary holds of telling words. Labels that are null, or that contradict
    each other for one id, teach nothing; repeated rows teach once.
    """
    known = labels.where(trainable()).groupBy("doc_id").agg(F.min("toxic").alias("least"), F.max("toxic").alias("toxic")).where("least = toxic and toxic in (0, 1)")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    chosen = [known.where(F.col("toxic") == kind).orderBy(order, "doc_id").limit(most) for kind, most in ((1, most_toxic), (0, most_ordinary))]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("_id"), "toxic"))  # at most most_toxic + most_ordinary rows
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(ids, "_id").dropDuplicates(["_id"]).orderBy(F.xxhash64(F.lit(seed), F.col("_id")), "_id")
    left = {0: most_chars, 1: most_chars}
    texts = {0: [], 1: []}
    for row in rows.toLocalIterator():
        if (size := len(row._text or "")) <= left[row.toxic]:
            left[row.toxic] -= size
            texts[row.toxic].append(row._text)
    return train(texts[1], texts[0], most_bytes)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below threshold, with all their columns."""
    key = fresh(docs, "score")
    return docs.withColumn(key, score_of(F.col(text_col), model)).where(F.col(key) < threshold).drop(key)
