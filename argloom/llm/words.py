"""Words and code points of a batch of texts as numpy arrays.

A word is a run of bytes other than blank and ``\\x09``-``\\x0D``. All words of
a batch are hashed in a few array steps, so there is no loop over words. The
hash is a polynomial modulo 2**64 over a random value per byte, mixed at the
end: equal words have equal hashes in every task, and two different words
collide with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads every bit over all others."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE), _powers(_BASE_INVERSE)
_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    first = int(bounds[0])
    return np.frombuffer(data, dtype=np.uint8)[first : int(bounds[-1])], bounds - first


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set within each row's range."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each row's range of values; empty ranges give 0.

    Each range is summed by itself, so a row's result does not depend on the
    rows that happen to stand before it in the batch.
    """
    out = np.zeros(len(bounds) - 1, dtype=values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full])
    return out


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, one place of each, and the number of each value among them."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(values), dtype=np.int64)
    inverse[order] = np.cumsum(first) - 1
    return ordered[first], order[first], inverse


@dataclass
class Words:
    """``hashes``, ``starts`` and ``ends`` (bytes) of all words, and each row's range of words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def hash_runs(data: np.ndarray, inside: np.ndarray, bounds: np.ndarray, fold: bool) -> Words:
    """Hash every maximal run of ``inside`` bytes; runs end where a row ends.

    Bytes are taken in blocks of a fixed size, so memory beside the result stays
    bounded however long one text or one word is.
    """
    n = len(data)
    table = _FOLDED if fold else _EXACT
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    starts, ends, raw = [], [], []
    open_at, open_sum = -1, 0  # a run that reaches the end of the block before
    for at in range(0, n, BLOCK):
        to = min(at + BLOCK, n)
        here, row = inside[at:to], first[at:to]
        begin = here.copy()
        begin[1:] &= ~here[:-1] | row[1:]
        stop = here.copy()
        stop[:-1] &= ~here[1:] | row[1:]
        b, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        total = np.zeros(to - at + 1, dtype=np.uint64)
        np.cumsum(table[data[at:to]] * _UP[: to - at], out=total[1:])
        h = (total[e] - total[b]) * _DOWN[b]
        b, e = b + at, e + at
        if open_at >= 0:
            if len(b) and b[0] == at and not first[at]:
                shift = pow(_BASE, int(at - open_at), 1 << 64)
                h[0] = np.uint64((open_sum + int(h[0]) * shift) & _MASK)
                b[0] = open_at
            else:
                starts.append(np.array([open_at]))
                ends.append(np.array([at]))
                raw.append(np.array([open_sum], dtype=np.uint64))
            open_at = -1
        if len(e) and e[-1] == to and to < n:
            open_at, open_sum = int(b[-1]), int(h[-1])
            b, e, h = b[:-1], e[:-1], h[:-1]
        starts.append(b)
        ends.append(e)
        raw.append(h)
    starts = np.concatenate(starts or [np.zeros(0, np.int64)]).astype(np.int64)
    ends = np.concatenate(ends or [np.zeros(0, np.int64)]).astype(np.int64)
    raw = np.concatenate(raw or [np.zeros(0, np.uint64)])
    hashes = mix(raw + mix((ends - starts).astype(np.uint64)))
    return Words(hashes, starts, ends, np.searchsorted(starts, bounds))


def words(data: np.ndarray, bounds: np.ndarray, fold: bool = False) -> Words:
    """All words of the rows; ``fold`` lower-cases A-Z first."""
    return hash_runs(data, ~_SEPARATOR[data], bounds, fold)


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside a row, and each row's range of them."""
    counts = np.maximum(np.diff(found.bounds) - size + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    h = found.hashes
    if len(h) < size:
        return np.zeros(0, np.uint64), bounds
    rolled = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(_BASE) + h[k : len(h) - size + 1 + k]
    at = np.repeat(found.bounds[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    return mix(rolled[at]), bounds


def row_groups(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` elements each; one long row is a range by itself."""
    at, rows = 0, len(bounds) - 1
    while at < rows:
        to = int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, to
        at = to


def code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and each row's range of them."""
    lead = (data & 0xC0) != 0x80
    counts = per_row(lead, bounds)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return points, np.concatenate([[0], np.cumsum(counts)])
