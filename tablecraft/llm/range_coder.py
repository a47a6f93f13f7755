"""Adaptive context-mixing range coder for token ids.

A block of ids is coded from nothing. For each id three orders predict: the id that last followed the two ids before
(order 2), the id that last followed the one before (order 1), and the counts of all ids so far (order 0). The
prediction of the highest order that has one is the candidate; the three orders' evidence for it is mixed in the
logistic domain, with weights learned from the errors made. Whether the candidate is right is coded with that
probability; an id that is not predicted is coded by its count of order 0, and an id not seen so far by its number.

Blocks are independent, so many are coded side by side, one id of each per step, with one numpy operation for all. The
model of a block learns at fixed places (``places``), from the ids before them alone; between two of them it stands
still. Everything is in whole numbers, so that coder and decoder agree on every machine.

Arithmetic: a range of up to 48 bits is narrowed by each decision; after each id, 16 bits leave it as long as it is below
32. Carries are added when a block is closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Ids of a block, and blocks side by side.
BLOCK = 2048
LANES = 1024
# Places of the tables of orders 0 (counts of candidates only), 1 and 2 of a block.
ORDER_0, ORDER_1, ORDER_2 = 1 << 10, 1 << 10, 1 << 11
# The weights learn from every so many steps.
TAUGHT = 4
# Inputs are in sixteenths of a natural logarithm, weights in 64ths, probabilities of 16 bits.
UNIT, WEIGHT, ONE = 16, 64, 1 << 16
LEAST = 64
TOP, LOW = 48, 32
# Steps whose predictions are made at once where all ids are known.
AT_ONCE = 64

_LOG = np.round(UNIT * np.log(np.arange(2 * BLOCK + 2) + 0.4)).astype(np.int64)
_EDGE = 2047
_SQUASH = np.clip(np.round(ONE / (1 + np.exp(-np.arange(-_EDGE, _EDGE + 1) / 256))), LEAST, ONE - LEAST).astype(np.int64)


def places(steps: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the stretches between which a model learns; each is half of all before it."""
    at, to = 0, 32
    while at < steps:
        to = min(to, steps)
        yield at, to
        at, to = to, to + max(32, to // 2)


class Model:
    """The models of some blocks side by side."""

    def __init__(self, lanes: int, vocabulary: int):
        self.lanes, self.vocabulary = lanes, vocabulary
        self._lane = np.arange(lanes)
        self._at_0, self._at_1, self._at_2 = self._lane * ORDER_0, self._lane * ORDER_1, self._lane * ORDER_2
        # Order 1 and 2: the id, how often it was right and how often the place was looked at.
        self._one, self._two = np.zeros(lanes * ORDER_1, np.int64), np.zeros(lanes * ORDER_2, np.int64)
        # Order 0: counts by hash for the candidates; for all ids so far, sorted: id, its first place and its count.
        self._counts = np.zeros(lanes * ORDER_0, np.int32)
        self.sorted = np.zeros((lanes, 1), np.int64)
        self.ids = self.spans = np.empty(0, np.int64)
        self.seen = np.zeros(lanes, np.int64)
        self.total = np.ones(lanes, np.int64)
        # Weights of order 2, 1, 0 and of a constant, by what the orders say: both the same, different ids, order 1 alone.
        start = np.array([[WEIGHT // 2, WEIGHT // 2, 8, 0], [WEIGHT // 2, 0, 8, -16], [0, WEIGHT, 8, -8]])
        self._weights = np.repeat(start.T[:, :, None], lanes, 2).reshape(4, 3 * lanes)

    def predict(self, before: np.ndarray, earlier: np.ndarray):
        """Candidate (-1: none), its probability, and what the mixing saw, for ids (..., lanes) before each place."""
        one = self._one[self._at_1 + ((before * 40503 >> 4) & (ORDER_1 - 1))]
        two = self._two[self._at_2 + ((before * 1000003 + earlier * 40503 >> 5) & (ORDER_2 - 1))]
        id_1, id_2 = (one >> 32) - 1, (two >> 32) - 1
        known = id_2 >= 0
        candidate = np.where(known, id_2, id_1)
        same = id_1 == candidate
        case = np.where(known, np.where(same, 0, 1), 2) * self.lanes + self._lane
        good_1, good_2 = (one >> 16) & 0xFFFF, (two >> 16) & 0xFFFF
        count = self._counts[self._at_0 + (candidate & (ORDER_0 - 1))]
        inputs = (
            _LOG[good_2] - _LOG[(two & 0xFFFF) - good_2],
            np.where(same, _LOG[good_1] - _LOG[(one & 0xFFFF) - good_1], 0),
            _LOG[count] - _LOG[self.seen - count],
        )
        w = self._weights
        mixed = w[0][case] * inputs[0] + w[1][case] * inputs[1] + w[2][case] * inputs[2] + w[3][case] * UNIT
        share = _SQUASH[np.minimum(np.maximum(mixed >> 2, -_EDGE), _EDGE) + _EDGE]
        return candidate, np.where(candidate >= 0, share, 0), case, *inputs

    def learn(self, ids: np.ndarray, start: int, saw: list[np.ndarray]) -> None:
        """Learn from the ids (steps, lanes) from ``start`` on, and what ``predict`` gave there."""
        candidate, share, case, *inputs = (v[::TAUGHT] for v in saw)
        flat = case.ravel()
        miss = np.where(candidate >= 0, np.where(candidate == ids[start::TAUGHT], ONE, 0) - share, 0).astype(float)
        for n, value in enumerate((*inputs, None)):
            # Sums stay far below 2^53, so the floats of bincount are whole numbers.
            value = np.full(case.shape, UNIT) if value is None else value
            slope = np.bincount(flat, (miss * value).ravel(), 3 * self.lanes).astype(np.int64)
            bend = np.bincount(flat, (value * value).ravel(), 3 * self.lanes).astype(np.int64)
            own = self._weights[n]
            own[:] = np.clip(own + slope // (40 * (bend + 32 * UNIT * UNIT)), -8 * WEIGHT, 8 * WEIGHT)
        before, earlier = _before(ids, start, len(ids))
        new = ids[start:].ravel()
        self._remember(self._one, (self._at_1 + ((before * 40503 >> 4) & (ORDER_1 - 1))).ravel(), new)
        self._remember(self._two, (self._at_2 + ((before * 1000003 + earlier * 40503 >> 5) & (ORDER_2 - 1))).ravel(), new)
        self._counts += np.bincount((self._at_0 + (ids[start:] & (ORDER_0 - 1))).ravel(), minlength=len(self._counts)).astype(np.int32)
        self._count(ids)

    @staticmethod
    def _remember(table: np.ndarray, place: np.ndarray, ids: np.ndarray) -> None:
        # Of several ids that meet at one place in a stretch, the last one counts.
        known = table[place]
        table[place] = (known & 0xFFFFFFFF) + np.where(known >> 32 == ids + 1, (1 << 16) + 1, 1) | (ids + 1) << 32

    def find(self, ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """First place and count of the ``wanted`` ones of ids (steps, lanes) among those so far; 0 for ids not seen."""
        out = np.zeros(ids.shape, np.int64)
        if len(self.ids):
            lane, step = np.nonzero(wanted.T)
            own = lane * self.vocabulary + ids[step, lane]
            at = np.minimum(np.searchsorted(self.ids, own), len(self.ids) - 1)
            out[step, lane] = np.where(self.ids[at] == own, self.spans[at], 0)
        return out

    def _count(self, ids: np.ndarray) -> None:
        seen = len(ids)
        ordered = np.sort(np.ascontiguousarray(ids.T).astype(np.uint32), axis=1)
        first = np.ones((self.lanes, seen), bool)
        first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        begins = np.flatnonzero(first)
        counts = np.diff(begins, append=first.size)
        lane, place = begins // seen, begins % seen
        own = ordered.ravel()[begins].astype(np.int64)
        # For the decoder: the id of each place; for the encoder: the place of each id.
        self.sorted = np.repeat(own << 32 | place << 16 | counts, counts).reshape(self.lanes, seen)
        self.ids, self.spans = lane * self.vocabulary + own, place << 16 | counts
        self.seen[:] = seen
        # Unseen ids get as many chances as ids were seen for the first time.
        self.total = seen + np.bincount(lane, minlength=self.lanes)


def _before(ids: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids one and two places before those from ``at`` to ``to``; zeros before the first."""
    own = ids[max(at - 2, 0) : to - 1]
    own = np.concatenate([np.zeros((to - at + 1 - len(own), ids.shape[1]), ids.dtype), own])
    return own[1:], own[:-1]


class _Writer:
    def __init__(self, lanes: int, steps: int):
        self._low, self._range = np.zeros(lanes, np.int64), np.full(lanes, 1 << TOP, np.int64)
        self._lanes, self._words = lanes, np.zeros((3 * steps + 8) * lanes, np.int32)
        # Where each block's next word goes, in rows of one word of each block.
        self._next = np.arange(lanes)

    def chance(self, begin: np.ndarray, size: np.ndarray) -> None:
        share = self._range >> 16
        self._low += share * begin
        self._range = share * size

    def count(self, begin: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        share = self._range // total
        self._low += share * begin
        self._range = share * size
        while len(need := np.flatnonzero(self._range < 1 << LOW)):
            self._shift(need)

    def _shift(self, need: np.ndarray) -> None:
        low = self._low[need]
        place = self._next[need]
        self._words[place] = low >> LOW
        self._next[need] = place + self._lanes
        self._low[need] = (low & ((1 << LOW) - 1)) << 16
        self._range[need] <<= 16

    def close(self) -> list[bytes]:
        for _ in range(3):
            self._shift(np.arange(self._lanes))
        counts = self._next // self._lanes
        rows = self._words.reshape(-1, self._lanes)[: counts.max()]
        carry = np.zeros(self._lanes, np.int32)
        for word in rows[::-1]:
            word += carry
            carry = word >> 16
            word &= 0xFFFF
        words = np.ascontiguousarray(rows.T).astype("<u2")
        return [own[:n].tobytes() for own, n in zip(words, counts.tolist(), strict=True)]


class _Reader:
    def __init__(self, coded: list[bytes], steps: int):
        lanes = len(coded)
        # A block that has ended is read on as zeros while others run.
        words = np.zeros((max(max(len(c) // 2 for c in coded), 4 * steps) + 8, lanes), np.int64)
        for lane, own in enumerate(coded):
            words[: len(own) // 2, lane] = np.frombuffer(own, "<u2")
        self._lanes, self._words, self._next = lanes, words.ravel(), np.arange(lanes) + 3 * lanes
        self._code = words[0] << 32 | words[1] << 16 | words[2]
        self._range = np.full(lanes, 1 << TOP, np.int64)

    def chance(self, size: np.ndarray) -> np.ndarray:
        """Whether the event of chance ``size`` of 2^16 happened."""
        share = self._range >> 16
        bound = share * size
        hit = self._code < bound
        self._code = np.where(hit, self._code, self._code - bound)
        self._range = np.where(hit, bound, share * (ONE - size))
        return hit

    def place(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place out of ``total`` that comes next, and the size of one place, for ``count``."""
        share = self._range // total
        return np.minimum(np.maximum(self._code // share, 0), total - 1), share

    def count(self, begin: np.ndarray, size: np.ndarray, share: np.ndarray) -> None:
        self._code = self._code - share * begin
        self._range = share * size
        while len(need := np.flatnonzero(self._range < 1 << LOW)):
            place = self._next[need]
            self._code[need] = self._code[need] << 16 | self._words[place]
            self._next[need] = place + self._lanes
            self._range[need] <<= 16


def encode(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """Code blocks side by side: ids (steps, blocks), each below ``vocabulary``."""
    steps, lanes = ids.shape
    ids = ids.astype(np.int64)
    model, out = Model(lanes, vocabulary), _Writer(lanes, steps)
    one = np.ones(lanes, np.int64)
    for start, end in places(steps):
        seen = []
        for at in range(start, end, AT_ONCE):
            to = min(at + AT_ONCE, end)
            own = ids[at:to]
            saw = model.predict(*_before(ids, at, to))
            seen.append(saw)
            candidate, share = saw[:2]
            hit = candidate == own
            begin, size = np.where(hit, 0, share), np.where(hit, share, ONE - share)
            span = model.find(own, ~hit)
            new = ~hit & (span == 0)
            total = np.where(hit, 1, model.total)
            place = np.where(hit, 0, np.where(new, model.seen, span >> 16))
            count = np.where(hit, 1, np.where(new, model.total - model.seen, span & 0xFFFF))
            some_new = new.any(1)
            for t in range(to - at):
                out.chance(begin[t], size[t])
                out.count(place[t], count[t], total[t])
                if some_new[t]:
                    out.count(np.where(new[t], own[t], 0), one, np.where(new[t], vocabulary, 1))
        if end < steps:
            model.learn(ids[:end], start, [np.concatenate(v) for v in zip(*seen, strict=True)])
    return out.close()


def decode(coded: list[bytes], steps: int, vocabulary: int) -> np.ndarray:
    """The first ``steps`` ids of blocks, (steps, blocks); a block of fewer ids has any ids at its end."""
    lanes = len(coded)
    ids = np.zeros((steps, lanes), np.int64)
    model, src = Model(lanes, vocabulary), _Reader(coded, steps)
    lane, one = np.arange(lanes), np.ones(lanes, np.int64)
    nothing = np.zeros(lanes, np.int64)
    for start, end in places(steps):
        seen = [np.empty((end - start, lanes), np.int32) for _ in range(6)]
        for t in range(start, end):
            saw = model.predict(ids[t - 1] if t else nothing, ids[t - 2] if t > 1 else nothing)
            for rows, value in zip(seen, saw, strict=True):
                rows[t - start] = value
            hit = src.chance(saw[1])
            total = np.where(hit, 1, model.total)
            place, part = src.place(total)
            span = model.sorted[lane, np.minimum(place, np.maximum(model.seen, 1) - 1)]
            new = ~hit & (place >= model.seen)
            begin = np.where(hit, 0, np.where(new, model.seen, (span >> 16) & 0xFFFF))
            size = np.where(hit, 1, np.where(new, model.total - model.seen, span & 0xFFFF))
            src.count(begin, size, part)
            own = np.where(hit, saw[0], span >> 32)
            if new.any():
                number, part = src.place(np.where(new, vocabulary, 1))
                src.count(number, one, part)
                own = np.where(new, number, own)
            ids[t] = own
        if end < steps:
            model.learn(ids[:end], start, seen)
    return ids
