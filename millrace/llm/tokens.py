"""Byte-level BPE ids through the tokenizers library, one call a distinct word.

A boundary of the pre-tokenizer lies before every single space between two characters
that aren't white space, so the ids of a text are those of its stretches between such
spaces, one after another. Stretches repeat; their ids are kept, in a bounded cache.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import os
import re
import string
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
from tokenizers import Tokenizer  # noqa: E402

#: White space of any kind beside a plain space, in RE2's words: such texts are split with more care.
_SPACES = r"[ \t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WIDE = f" {_SPACES}|{_SPACES} "
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: Stretches longer than this are not kept.
_KEPT_CHARS = 64
#: Characters of texts that are split at a time.
_AT_ONCE = 8_000_000
#: Texts of one call of the library, whose results are large beside their ids.
_CALL = 250
#: Letters, then marks, and maybe both again after a line end: what any Unicode version takes for words and runs of marks, the
#: parts of such a stretch, as is the line end. In RE2's words.
_MARKS = string.punctuation.replace("'", "")
_PAIR = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}]+[!-&(-/:-@\[-`{-~]*"
_SIMPLE = rf"\A{_PAIR}(?:\n{_PAIR})?\z"
#: What a kept stretch takes beside its characters and ids: two objects and its place in the dictionary.
_ENTRY_BYTES = 170
#: Bits of hash that tell whether a stretch was missed before.
_MISSED_BITS = 20


def _byte_letters() -> dict[int, int]:
    """How byte-level models write each byte: visible ones of Latin-1 as themselves, the rest from U+0100 on, in order."""
    others = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
    return {b: 256 + k for k, b in enumerate(others)}


def _joined(data: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen ones, side by side, of the runs of these lengths that make up data, and where each ends."""
    starts = np.cumsum(lengths) - lengths
    size = lengths.take(chosen)
    ends = np.cumsum(size)
    place = np.repeat(starts.take(chosen) - (ends - size), size)
    place += np.arange(len(place))
    return data.take(place), ends


class WordBpe:
    """ids of whole texts as little-endian uint32 bytes, equal to Tokenizer.encode(text, add_special_tokens=False).

    Strings of special tokens get their own id, as in that call: texts are split at them first.
    limit_bytes bounds the stretches kept. A stretch is kept when it is missed the second time, as most are
    seen once; once the room is used up no more are added, and after ten times as many misses collecting starts anew.
    """

    def __init__(self, path: str, limit_bytes: int = 64_000_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        # Tokens that take white space along, or stand alone only, can't be split off by their string.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        parts = json.loads(self.tokenizer.to_str())
        cut = parts["pre_tokenizer"] or {}
        # Simple stretches go straight to the model, past the steps whose result is known.
        self.direct = parts["normalizer"] is None and parts["post_processor"] is None and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.limit_bytes = limit_bytes
        self._clear()

    def _clear(self) -> None:
        self.kept: dict[str, bytes] = {}  # of parts, see _parts
        self.used = self.missed = 0
        self.before = bytearray(1 << _MISSED_BITS)

    def _direct(self, texts: list[str]) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # what is made here holds no cycles
        try:
            parts = [texts[k : k + _CALL] for k in range(0, len(texts), _CALL)]
            return [array("I", x.ids).tobytes() for part in parts for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        finally:
            if collecting:
                gc.enable()

    def _parts(self, parts: list[str]) -> list[bytes]:
        """The ids of parts: a word with a space before it, a line end and a word, marks, or a whole stretch written with its space."""
        out, others, tokenize = [], [], self.model.tokenize
        for x in parts:
            if not x or x[0] == " ":
                if x:
                    others.append(x)
                out.append(b"")
                continue
            ids = []
            if x[0] == "\n":
                word, lead, ids = x[1:], "", [t.id for t in tokenize("\u010a")]
            else:
                word, lead = x, "" if x[0] in _MARKS else "\u0120"
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in tokenize(lead + word)]
            out.append(array("I", ids).tobytes())
        rest = iter(self._direct(others))
        return [ids or (next(rest) if x else ids) for x, ids in zip(parts, out, strict=True)]

    def _split(self, stretches: pa.LargeStringArray) -> tuple[list[str], np.ndarray]:
        """Different parts, of which the first is empty, and four of them, by number, for each stretch."""
        simple = pc.match_substring_regex(stretches, _SIMPLE).to_numpy(zero_copy_only=False) & self.direct
        chosen = stretches.filter(pa.array(simple))
        n, data = len(chosen), chosen.buffers()[2]
        cells = np.zeros((len(stretches), 4), np.int64)
        parts = [""]
        if n:
            # Lines, then words and marks, are neighbours in the same bytes: only where they end is new.
            at = np.frombuffer(chosen.buffers()[1], np.int64)[: n + 1]
            lined = pc.find_substring(chosen, "\n").to_numpy()
            line_at = np.append(np.stack([at[:-1], np.where(lined < 0, at[1:], at[:-1] + lined)], axis=1), at[-1])
            lines = pa.LargeStringArray.from_buffers(2 * n, pa.py_buffer(line_at), data)
            word = pc.binary_length(pc.ascii_rtrim(lines, characters=_MARKS)).to_numpy()
            part_at = np.append(np.stack([line_at[:-1], line_at[:-1] + word], axis=1), at[-1])
            coded = pa.LargeStringArray.from_buffers(4 * n, pa.py_buffer(part_at), data).dictionary_encode()
            parts += coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            cells[simple] = coded.indices.to_numpy().reshape(n, 4) + 1
        others = stretches.filter(pa.array(~simple)).to_numpy(zero_copy_only=False).tolist()
        cells[~simple, 0] = np.arange(len(parts), len(parts) + len(others))
        return parts + [f" {x}" for x in others], cells

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """One result per text, in order; b"" for null and empty texts."""
        held: list[str] = []
        shape: list[tuple[int, list[bytes]]] = []  # of each text, how many of held are its, and the special ids between them
        size = 0
        for text in texts:
            text = text or ""
            parts = self.specials.split(text) if self.specials else [text]
            if len(parts) > 1 and not self.plain:
                shape.append((0, self._direct([text])))
            else:
                held += parts[::2]
                shape.append((len(parts[::2]), [self.special[x] for x in parts[1::2]]))
            size += len(text)
            if size >= _AT_ONCE:
                yield from self._shaped(held, shape)
                held, shape, size = [], [], 0
        yield from self._shaped(held, shape)

    def _shaped(self, held: list[str], shape: list[tuple[int, list[bytes]]]) -> Iterator[bytes]:
        found = self._bounded(held)
        for n, special in shape:
            parts = [next(found) for _ in range(n)]
            yield b"".join(x for pair in itertools.zip_longest(parts, special, fillvalue=b"") for x in pair) if special else parts[0]

    def _bounded(self, texts: list[str]) -> Iterator[bytes]:
        """As _encode; long texts are cut between stretches, so that what is made beside their ids stays small."""
        short: list[str] = []
        for text in texts:
            if len(text) <= _AT_ONCE:
                short.append(text)
                continue
            yield from self._encode(short)
            short, ids, at = [], [], 0
            while at < len(text):
                cut = _BEFORE_SPACE.search(text, at + _AT_ONCE)
                end = cut.start() if cut else len(text)
                ids += self._encode([text[at:end]])
                at = end
            yield b"".join(ids)
        yield from self._encode(short)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        if not texts:
            return
        whole = pa.array(texts, pa.large_string())
        wide = pc.match_substring_regex(whole, _WIDE).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(whole.filter(pa.array(~wide)), " ")
        careful = [[x[1:] if k else x for k, x in enumerate(_BEFORE_SPACE.split(texts[k]))] for k in np.nonzero(wide)[0]]
        values = pa.concat_arrays([split.values, pa.array(itertools.chain.from_iterable(careful), pa.large_string())])
        # Stretches lie text by text, those of wide texts last; the first of a text is the only one without a space before it.
        order = np.concatenate([np.nonzero(~wide)[0], np.nonzero(wide)[0]])
        sizes = np.concatenate([np.diff(split.offsets.to_numpy()), np.fromiter(map(len, careful), np.int64, len(careful))])
        ends = np.cumsum(sizes)
        first = ends - sizes
        coded = values.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        later = np.ones(len(code), bool)
        later[first] = False
        used = np.bincount(code[later], minlength=len(coded.dictionary)) > 0
        parts, cells = self._split(coded.dictionary.filter(pa.array(used)))
        ids = list(map(self.kept.get, parts))
        missing = [x for x, known in zip(parts, ids, strict=True) if known is None]
        fresh = dict(zip(missing, self._parts(missing), strict=True))
        ids = [fresh[x] if known is None else known for x, known in zip(parts, ids, strict=True)]
        ids += self._direct(values.take(pa.array(first)).to_pylist())
        code = np.cumsum(used)[code] - 1
        code[first] = np.arange(len(cells), len(cells) + len(texts))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        data = np.frombuffer(b"".join(ids), np.uint32)
        cells = np.concatenate([cells.ravel(), np.arange(len(parts), len(ids))])
        data, cell_ends = _joined(data, lengths, cells)
        of_cells = np.diff(cell_ends, prepend=0)
        lengths = np.concatenate([of_cells[: -len(texts)].reshape(-1, 4).sum(axis=1), of_cells[-len(texts) :]])
        data, after = _joined(data, lengths, code)
        found = data.tobytes()
        bounds = np.empty((len(texts), 2), np.int64)
        bounds[order] = 4 * np.stack([after[first] - lengths[code[first]], after[ends - 1]], axis=1)
        for a, b in bounds.tolist():
            yield found[a:b]
        self._keep(fresh)

    def _keep(self, fresh: dict[str, bytes]) -> None:
        self.missed += len(fresh)
        if self.missed * _ENTRY_BYTES > 10 * self.limit_bytes:
            self._clear()
        before, mask = self.before, (1 << _MISSED_BITS) - 1
        for x, ids in fresh.items():
            if self.used >= self.limit_bytes:
                break
            at = hash(x) & mask
            if not before[at]:
                before[at] = 1
            elif len(x) <= _KEPT_CHARS:
                self.kept[x] = ids
                self.used += _ENTRY_BYTES + len(x) * (1 if x.isascii() else 3) + len(ids)


@functools.cache
def word_bpe(path: str, limit_bytes: int = 64_000_000) -> WordBpe:
    """One a worker process and vocabulary: what tasks keep from each other is bounded, see WordBpe."""
    return WordBpe(path, limit_bytes)
