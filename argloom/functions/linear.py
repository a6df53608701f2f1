"""Sums of per-word weights, computed inside the row.

Word lists travel as Arrow arrays; the work in the task is whole-array NumPy.
Each function makes one pass over the words, however many models it applies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

MOST = 1 << 19  # words that are looked up at once


def word_hashes(words: Sequence[str] | np.ndarray | pa.Array) -> np.ndarray:
    """A signed 64-bit hash per word, the same in every task; null hashes as the empty word.

    Works on the bytes of all words at once, eight at a time; no word becomes a Python string.
    """
    if not isinstance(words, pa.Array):
        words = pa.array(words, type=pa.large_string(), from_pandas=True)
    words = words.cast(pa.large_binary()) if words.type != pa.large_binary() else words
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64, offset=8 * words.offset, count=len(words) + 1) if len(words) else np.zeros(1, dtype=np.int64)
    start, left = ends[:-1] - ends[0], np.diff(ends)
    used = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, dtype=np.uint8)
    padded = np.concatenate([used, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray(len(used) + 1, dtype="<u8", buffer=padded, strides=(1,))  # those that begin at each byte
    hashes = _mixed(left.astype(np.uint64))
    for i in np.flatnonzero(left > _LONG):
        digest = blake2b(used[start[i] : start[i] + left[i]], digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    todo = np.flatnonzero((left > 0) & (left <= _LONG))
    start, left = start[todo], left[todo]
    while len(todo):
        piece = eights[start] & _MASKS[np.minimum(left, 8)]
        hashes[todo] = _mixed(hashes[todo] ^ piece)
        more = left > 8
        todo, start, left = todo[more], start[more] + 8, left[more] - 8
    return hashes.view(np.int64)


def list_hashes() -> Callable[[Column], Column]:
    """``array<string>`` to the hashes of its words."""

    @arrow_udf("array<bigint>")
    def hashes(words: pa.Array) -> pa.Array:
        sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(word_hashes(words.flatten())), mask=words.is_null())

    return hashes


_LONG = 256  # bytes; longer words are hashed one by one
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of SplitMix64: every bit of the result depends on every bit of ``x``."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _matches(hashes: np.ndarray, weights: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Weights of hashes in a sorted table, one or a row of them each; 0 for those that it does not hold."""
    if len(hashes) == 0:
        return np.zeros((len(own), *weights.shape[1:]), dtype=np.int64)
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    found = weights[at]
    found[hashes[at] != own] = 0
    return found


class WeightTable(Protocol):
    """What tasks look weights up in."""

    def find(self, own: np.ndarray) -> np.ndarray:
        """Weights of word hashes; unknown words weigh nothing."""


@dataclass(frozen=True)
class BroadcastTable:
    """Hashes in order and their weights, one or a row of them a word, broadcast as a whole."""

    arrays: Broadcast

    def find(self, own: np.ndarray) -> np.ndarray:
        return _matches(*self.arrays.value, own)


@dataclass(frozen=True)
class TableFile:
    """One range of a sorted table: its first and last hash and the paths of its two arrays."""

    first: int
    last: int
    hashes: str
    weights: str


@lru_cache(maxsize=4096)
def _mapped(place: str) -> np.ndarray:
    return np.asarray(np.memmap(place, dtype=np.int64, mode="r"))


def _array(path: str) -> np.ndarray:
    """An array in the shared folder: mapped where the folder is mounted, else read and let go again."""
    system, place = FileSystem.from_uri(path)
    if isinstance(system, LocalFileSystem):
        return _mapped(place)
    with system.open_input_stream(place) as file:
        return np.frombuffer(file.read(), dtype=np.int64)


@dataclass(frozen=True)
class SharedTable:
    """A table of any size as files sorted by hash, in a folder that all tasks can reach.

    Only the ranges in which a batch has words are looked at, and of a mapped
    file only the pages that a search touches. With ``columns``, a word has a row of weights.
    """

    files: tuple[TableFile, ...]
    columns: int | None = None

    def find(self, own: np.ndarray) -> np.ndarray:
        order = np.argsort(own)
        ordered = own[order]
        shape = () if self.columns is None else (self.columns,)
        found = np.zeros((len(own), *shape), dtype=np.int64)
        for file in self.files:
            a, z = np.searchsorted(ordered, file.first), np.searchsorted(ordered, file.last, side="right")
            if a < z:
                found[order[a:z]] = _matches(_array(file.hashes), _array(file.weights).reshape(-1, *shape), ordered[a:z])
        return found


Scorer = tuple[WeightTable, int]  # a table and a bias


def _sum_lists(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    running = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(values)])
    return running[offsets[1:]] - running[offsets[:-1]]


def _offsets(lists: pa.ListArray) -> np.ndarray:
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return offsets - offsets[0]


def _in_parts(lists: pa.ListArray, work: Callable[[pa.ListArray], pa.Array]) -> pa.Array:
    """``work`` on runs of lists with some :data:`MOST` words each, so that what it holds is bounded, not by the batch."""
    offsets, parts, at = _offsets(lists), [], 0
    if not len(lists) or offsets[-1] <= MOST:
        return work(lists)
    while at < len(lists):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + MOST, side="right")) - 1)
        parts.append(work(lists.slice(at, end - at)))
        at = end
    return pa.concat_arrays(parts)


def _margins(lists: pa.ListArray, first: Scorer, second: Scorer | None) -> tuple[pa.Array, pa.Array | None]:
    """Margins of word lists under one model and, where that one's is positive, under another.

    The second table is asked only for words of lists that the first one chose.
    """
    words, offsets = lists.flatten().dictionary_encode(), _offsets(lists)
    hashes = word_hashes(words.dictionary)
    at = words.indices.to_numpy(zero_copy_only=False)
    table, bias = first
    margins = _sum_lists(table.find(hashes)[at], offsets) + bias
    if second is None:
        return pa.array(margins), None
    table, bias = second
    chosen = margins > 0
    inside = np.repeat(chosen, np.diff(offsets))
    used = np.unique(at[inside])
    weights = np.zeros(len(hashes), dtype=np.int64)
    weights[used] = table.find(hashes[used])
    more = _sum_lists(np.where(inside, weights[at], 0), offsets) + bias
    return pa.array(margins), pa.array(more, mask=~chosen)


def _nested(documents: pa.ListArray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_offsets(documents), type=pa.int32()), values)


def list_margin(model: Scorer) -> Callable[[Column], Column]:
    """``array<string>`` to the sum of its words' weights."""

    @arrow_udf("bigint")
    def margin(words: pa.Array) -> pa.Array:
        return _in_parts(words, lambda part: _margins(part, model, None)[0])

    return margin


def nested_margins(model: Scorer) -> Callable[[Column], Column]:
    """``array<array<string>>`` to one sum of weights per inner list."""

    @arrow_udf("array<bigint>")
    def margins(documents: pa.Array) -> pa.Array:
        return _nested(documents, _in_parts(documents.flatten(), lambda part: _margins(part, model, None)[0]))

    return margins


def _pair(lists: pa.ListArray, first: Scorer, second: Scorer) -> pa.Array:
    def pair(part: pa.ListArray) -> pa.Array:
        return pa.StructArray.from_arrays(list(_margins(part, first, second)), names=["first", "second"])

    return _in_parts(lists, pair)


def list_cascade(first: Scorer, second: Scorer) -> Callable[[Column], Column]:
    """``array<string>`` to ``first, second``: two margins, the second one null unless the first is positive."""

    @arrow_udf("struct<first:bigint,second:bigint>")
    def margins(words: pa.Array) -> pa.Array:
        return _pair(words, first, second)

    return margins


def nested_cascade(first: Scorer, second: Scorer) -> Callable[[Column], Column]:
    """The same for ``array<array<string>>``, one pair of margins per inner list."""

    @arrow_udf("array<struct<first:bigint,second:bigint>>")
    def margins(documents: pa.Array) -> pa.Array:
        return _nested(documents, _pair(documents.flatten(), first, second))

    return margins


def _class_margins(lists: pa.ListArray, models: Sequence[Scorer]) -> pa.ListArray:
    words, offsets = lists.flatten().dictionary_encode(), _offsets(lists)
    hashes = word_hashes(words.dictionary)
    at = words.indices.to_numpy(zero_copy_only=False)
    sums = [_sum_lists(table.find(hashes)[at], offsets) + bias for table, bias in models]
    ends = np.arange(len(lists) + 1, dtype=np.int32) * len(models)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.stack(sums, axis=1).ravel()))


def list_class_margins(models: Sequence[Scorer]) -> Callable[[Column], Column]:
    """``array<string>`` to an array with one margin per model, in one pass."""

    @arrow_udf("array<bigint>")
    def margins(words: pa.Array) -> pa.Array:
        return _in_parts(words, lambda part: _class_margins(part, models))

    return margins


def nested_class_margins(models: Sequence[Scorer]) -> Callable[[Column], Column]:
    """The same for ``array<array<string>>``, one array of margins per inner list."""

    @arrow_udf("array<array<bigint>>")
    def margins(documents: pa.Array) -> pa.Array:
        return _nested(documents, _in_parts(documents.flatten(), lambda part: _class_margins(part, models)))

    return margins
