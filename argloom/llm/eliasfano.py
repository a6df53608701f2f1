"""Elias-Fano coded sequences, searched for many values at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
CHUNK = 1 << 15  # values that are searched together, so that the arrays between stay in the processor's cache
_EACH, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
# Place of the n-th set bit of every byte, at n * 256 + byte.
_IN_BYTE = np.zeros(2048, dtype=np.uint64)
for _byte in range(256):
    for _n, _place in enumerate(i for i in range(8) if _byte >> i & 1):
        _IN_BYTE[_n * 256 + _byte] = _place


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits side by side in 64-bit words."""
    words = np.zeros(-(-len(values) * width // 64) + 2, dtype=np.uint64)
    step = 64 * 4096  # whole words, whatever the width
    for at in range(0, len(values), step):
        part = values[at : at + step]
        bits = (part[:, None] >> np.arange(width, dtype=np.uint64)) & _U(1)
        packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        packed = np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)
        words[at * width // 64 : at * width // 64 + len(packed)] |= packed
    return words


def _window(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits from a bit position on."""
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    upper = words[word + 1] << ((_U(64) - shift) & _U(63))
    return (words[word] >> shift) | np.where(shift == 0, _U(0), upper)


def _nth_set(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of the n-th set bit (from 0) of each word: running sums of its bytes, then a table of bytes."""
    ones = word - ((word >> _U(1)) & _U(0x5555555555555555))
    ones = (ones & _U(0x3333333333333333)) + ((ones >> _U(2)) & _U(0x3333333333333333))
    ones = ((ones + (ones >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH
    n = n.astype(np.uint64)
    # The upper bit of each byte says that the set bits up to that byte are not more than n.
    passed = ((n * _EACH | _TOPS) - ones) & _TOPS
    place = np.minimum(np.bitwise_count(passed), 7).astype(np.uint64) << _U(3)
    rank = n - ((ones << _U(8)) >> place & _U(255))
    return (place + _IN_BYTE[(rank << _U(8) | (word >> place & _U(255))) & _U(2047)]).astype(np.int64)


class EliasFano:
    """A sorted sequence of numbers below ``universe``: low bits as they are, high bits in unary."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.width, self.low, self.high, self.before = n, width, low, high, before

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, (universe // max(1, n)).bit_length() - 1)
        high = (values >> _U(width)).astype(np.int64)
        last = int(universe >> width) + 1
        bits = np.zeros((-(-(n + last + 1) // 64) + 2) * 64, dtype=bool)
        bits[high + np.arange(n)] = True
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        before = np.cumsum(64 - np.bitwise_count(words).astype(np.int64))
        before = np.concatenate([[0], before[:-1]])  # zeros before each word
        low = _pack(values & _U((1 << width) - 1), width) if width else np.zeros(2, np.uint64)
        return EliasFano(n, width, low, words, before)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many elements have a smaller high part: the ones before that many zeros.

        The word with the last of these zeros is found in the directory, so long
        runs of ones, the successors of a frequent word, cost nothing.
        """
        word = np.maximum(np.searchsorted(self.before, high, side="left") - 1, 0)
        left = high - self.before[word]
        place = _nth_set(~self.high[word], np.maximum(left - 1, 0)) + 1
        return word * 64 + np.where(left > 0, place, 0) - high

    def _equal_high(self, high: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The end of the elements with each high part, given where they start."""
        ones = _window(self.high, first + high)
        run = np.bitwise_count((~ones & (ones + _U(1))) - _U(1)).astype(np.int64)
        long = np.flatnonzero(run >= 64)
        end = first + run
        end[long] = self._below(high[long] + 1)
        return end

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), dtype=np.uint64)
        return _window(self.low, at * self.width) & _U((1 << self.width) - 1)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first element not below each value, and whether it equals the value."""
        values = values.astype(np.uint64)
        place, equal = np.empty(len(values), dtype=np.int64), np.empty(len(values), dtype=bool)
        for at in range(0, len(values), CHUNK):
            place[at : at + CHUNK], equal[at : at + CHUNK] = self._successor(values[at : at + CHUNK])
        return place, equal

    def _successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = (values >> _U(self.width)).astype(np.int64)
        place = self._below(high)
        end = self._equal_high(high, place)
        low = values & _U((1 << self.width) - 1)
        equal = np.zeros(len(values), dtype=bool)
        # Most runs of one high part are short: their first element decides.
        some = np.flatnonzero(place < end)
        head = self._low(place[some])
        equal[some] = head == low[some]
        below = head < low[some]
        further, head = some[below], head[below]
        place[further] += 1
        more = place[further] < end[further]
        row, under = further[more], head[more].astype(np.float64)
        # Within a long run the elements lie about evenly, so a value tells where to look.
        begin, last, target = place[row], end[row], low[row]
        over = np.full(len(row), float(1 << self.width))
        turn = 0
        while len(row):
            turn += 1
            size = last - begin
            part = 0.5 if turn > 4 else (target - under) / (over - under)
            middle = begin + np.clip((part * size).astype(np.int64), 0, size - 1)
            value = self._low(middle)
            hit, less = value == target, value < target
            begin, last = np.where(less, middle + 1, begin), np.where(less, last, middle)
            under, over = np.where(less, value, under), np.where(less, over, value)
            done = hit | (begin >= last)
            place[row[done]] = np.where(hit, middle, begin)[done]
            equal[row[hit]] = True
            go = ~done
            row, begin, last, target, under, over = row[go], begin[go], last[go], target[go], under[go], over[go]
        return place, equal

    def decode(self) -> np.ndarray:
        """All elements in order."""
        bits = np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little")
        high = np.flatnonzero(bits)[: self.n] - np.arange(self.n)
        return (high.astype(np.uint64) << _U(self.width)) | self._low(np.arange(self.n))
