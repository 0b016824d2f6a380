"""Adaptive context-mixing range coder for token ids.

Every block starts from fresh models and is coded alone. Its ids are cut into lanes of equal length, coded side by
side: step k codes the k-th id of each, and all lanes learn from it before the next. An id is coded as what order 2
(the two ids before it) or else order 1 predicts, or as neither; adaptive counts under the confidences of both weigh the
three, renewed every fourth step. Only ids of the third kind are coded themselves, by order 0: adaptive counts of such ids, renewed whenever the steps
have doubled. A range coder with 48-bit state and carries writes 16-bit words,
a stream a lane, behind the streams' lengths. States are whole numbers below 2^53 in float64, which numpy divides exactly.
"""

from __future__ import annotations

import numpy as np

#: A block has at most so many lanes, and lanes at least so many ids where the block has them.
_LANES, _SHORTEST = 8192, 128
_BITS = 12  # frequencies of a symbol's alternatives add up to 2^12
_PAIRS = 1 << 18  # slots of order 2's predictions, the highest bits of a 32-bit hash
_SURE = 7  # highest confidence
_ID_BITS = 20  # frequencies of ids add up to 2^20
_WHOLE, _LOW, _TOP, _WORD, _PART, _ID_PART = 2.0**48, 2.0**32, 2.0**-32, 2.0**16, 2.0**-_BITS, 2.0**-_ID_BITS


def _shape(n: int) -> tuple[int, int]:
    """Steps and lanes of a block of n ids."""
    steps = -(-n // min(_LANES, max(1, n // _SHORTEST)))
    return steps, -(-n // steps)


def _judged(sure: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a prediction's confidence gains, and whether the id that came takes its place."""
    return np.where(right, sure < _SURE, -(sure >> 1)).astype(np.int32), ~right & (sure <= 1)


#: Of both predictions, by the place of a kind: confidence of order 2, of order 1, whether they agree, and which came.
_two, _one, _same, _came = np.indices((_SURE + 1, _SURE + 1, 2, 3)).reshape(4, -1)
_GAIN_TWO, _FRESH_TWO = _judged(_two, _came == 0)
_GAIN_ONE, _FRESH_ONE = _judged(_one, (_came == 1) | (_came == 0) & (_same == 1))


class _Models:
    """The models of a block. Predictions are ids times 8 plus a confidence, 0 before the first."""

    def __init__(self, lanes: int) -> None:
        self.one, self.two = np.zeros(1 << 16, np.int32), np.zeros(_PAIRS, np.int32)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.kinds = np.ones((2 * (_SURE + 1) ** 2, 3))
        self.seen = np.zeros(1 << 16, np.int64)
        self.held: list[np.ndarray] = []
        self.came: list[np.ndarray] = []
        self.steps, self.due = 0, 1
        self._weigh()
        self.renewed()

    def _weigh(self) -> None:
        ends = np.cumsum(self.kinds, axis=1)
        self.ends = np.zeros((len(ends), 4))
        self.ends[:, 1:] = np.floor(ends * ((2**_BITS - 3) / ends[:, 2:])) + np.arange(1, 4)
        self.first, self.second = self.ends[:, 1].repeat(3), self.ends[:, 2].repeat(3)
        self.kind_start, self.kind_size = self.ends[:, :3].ravel(), np.diff(self.ends, axis=1).ravel()

    def renew_at(self, step: int) -> bool:
        """Renews the counts of ids if this step is due for it."""
        if step < self.due:
            return False
        self.renewed()
        self.due = 2 * step
        return True

    def renewed(self) -> None:
        """Frequencies of ids from those so far that nothing predicted: starts and sizes. Every id has one."""
        if self.held:
            self.seen += np.bincount(np.concatenate(self.held), minlength=1 << 16)
            self.held = []
        ends = np.cumsum(self.seen) if self.seen.any() else np.arange(1, (1 << 16) + 1)
        whole = np.zeros((1 << 16) + 1, np.int64)
        whole[1:] = ends * (2**_ID_BITS - 2**16) // ends[-1] + np.arange(1, (1 << 16) + 1)
        self.starts, self.sizes = whole[:-1].astype(np.float32), np.diff(whole).astype(np.float32)

    def table(self) -> np.ndarray:
        """For decoding: the id of every frequency."""
        return np.repeat(np.arange(1 << 16, dtype=np.uint16), self.sizes.astype(np.int64))

    def predict(self) -> None:
        """Both predictions for the next id of every lane, and the place of its context in the table of kinds."""
        self.slot = ((self.last.astype(np.uint32) * np.uint32(0x9E3779B1) ^ self.before.astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(14)).astype(np.int64)
        self.by_one, self.by_two = self.one.take(self.last), self.two.take(self.slot)
        self.guess_one, self.guess_two = self.by_one >> 3, self.by_two >> 3
        kind = ((self.by_two & _SURE) << 4) + ((self.by_one & _SURE) << 1) + (self.guess_one == self.guess_two)
        self.place = (kind * np.int32(3)).astype(np.int64)

    def learn(self, ids: np.ndarray, at: np.ndarray) -> None:
        """ids follow in every lane; at are their kinds' places. Of lanes that share a prediction the last one counts."""
        fresh = (ids << 3) + 1
        self.one[self.last] = np.where(_FRESH_ONE.take(at), fresh, self.by_one + _GAIN_ONE.take(at))
        self.two[self.slot] = np.where(_FRESH_TWO.take(at), fresh, self.by_two + _GAIN_TWO.take(at))
        self.last, self.before = ids.astype(np.int64), self.last
        self.came.append(at)
        self.steps += 1
        if self.steps < 16 or self.steps % 4 == 0:
            self.kinds += np.bincount(np.concatenate(self.came), minlength=self.kinds.size).reshape(self.kinds.shape)
            self.came = []
            self._weigh()


def _encode(ids: np.ndarray) -> np.ndarray:
    steps, lanes = _shape(len(ids))
    if steps > 8192:
        raise ValueError("a block has 2^26 ids at most")  # words of a lane are counted in 16 bits
    grid = np.zeros(steps * lanes, np.uint16)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    models = _Models(lanes)
    every = np.arange(lanes, dtype=np.uint16)
    places: list[np.ndarray] = []
    moves: list[np.ndarray] = []  # words, which may hold a carry above 16 bits
    low, width = np.zeros(lanes), np.full(lanes, _WHOLE)

    def moved(low: np.ndarray, width: np.ndarray, lane: np.ndarray) -> None:
        narrow = np.nonzero(width < _LOW)[0]
        while narrow.size:
            a = low.take(narrow)
            word = np.floor(a * _TOP)
            places.append(lane.take(narrow))
            moves.append(word.astype(np.int32))
            low[narrow] = (a - word * _LOW) * _WORD
            width[narrow] = b = width.take(narrow) * _WORD
            narrow = narrow[b < _LOW]

    for step in range(steps):
        now = grid[step].astype(np.int32)
        models.predict()
        missed = now != models.guess_two
        neither = missed & (now != models.guess_one)
        at = models.place + missed
        at += neither
        part = np.floor(width * _PART)
        low += models.kind_start.take(at) * part
        width = models.kind_size.take(at) * part
        moved(low, width, every)
        rest = np.nonzero(neither)[0]
        if rest.size:
            models.renew_at(step)
            x = now.take(rest)
            models.held.append(x)
            a, b, lane = low.take(rest), width.take(rest), every.take(rest)
            part = np.floor(b * _ID_PART)
            a += models.starts.take(x) * part
            b = models.sizes.take(x) * part
            moved(a, b, lane)
            low[rest], width[rest] = a, b
        models.learn(now, at)
    end = np.ceil(low / _WORD)  # whatever follows these two words lies within the last width
    word = np.floor(end / _WORD)
    lane = np.concatenate([*places, every, every])
    words = np.concatenate([*moves, word, end - word * _WORD]).astype(np.int32)[np.argsort(lane, kind="stable")]
    while (carry := words >> 16).any():
        words &= 0xFFFF
        words[:-1] += carry[1:]
    return np.concatenate([np.bincount(lane, minlength=lanes), words]).astype(np.uint16)


def _decode(words: np.ndarray, n: int) -> np.ndarray:
    steps, lanes = _shape(n)
    used = words[:lanes].astype(np.int64)
    data = np.concatenate([words[lanes:], np.zeros(4, np.uint16)])
    place = np.cumsum(used) - used
    code = (data[place] * _WORD + data[place + 1]) * _WORD + data[place + 2]
    place += 3
    width = np.full(lanes, _WHOLE)
    models = _Models(lanes)
    table = models.table()
    grid = np.zeros((steps, lanes), np.uint16)

    def moved(code: np.ndarray, width: np.ndarray, place: np.ndarray) -> None:
        narrow = np.nonzero(width < _LOW)[0]
        while narrow.size:
            at = place.take(narrow)
            code[narrow] = code.take(narrow) * _WORD + data.take(at, mode="clip")
            place[narrow] = at + 1
            width[narrow] = b = width.take(narrow) * _WORD
            narrow = narrow[b < _LOW]

    for step in range(steps):
        models.predict()
        part = np.floor(width * _PART)
        value = code / part
        at = models.place
        missed, neither = value >= models.first.take(at), value >= models.second.take(at)
        at = at + missed
        at += neither
        code -= models.kind_start.take(at) * part
        width = models.kind_size.take(at) * part
        moved(code, width, place)
        now = np.where(missed, models.guess_one, models.guess_two)
        rest = np.nonzero(neither)[0]
        if rest.size:
            if models.renew_at(step):
                table = models.table()
            a, b, c = code.take(rest), width.take(rest), place.take(rest)
            part = np.floor(b * _ID_PART)
            x = table.take((a / part).astype(np.int64), mode="clip")
            a -= models.starts.take(x) * part
            b = models.sizes.take(x) * part
            moved(a, b, c)
            code[rest], width[rest], place[rest] = a, b, c
            now[rest] = x
            models.held.append(x)
        models.learn(now, at)
        grid[step] = now
    return grid.T.reshape(-1)[:n]


def encode(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """The words, uint16, of every block of ids below 65,536."""
    return [_encode(b) if len(b) else np.zeros(0, np.uint16) for b in blocks]


def decode(words: list[np.ndarray], lengths: list[int]) -> list[np.ndarray]:
    """The ids of every block, from its words and the number of its ids."""
    return [_decode(w, n) if n else np.zeros(0, np.int64) for w, n in zip(words, lengths, strict=True)]
