"""Packing documents into as few fixed-size sequences as possible.

Only lengths matter for packing, and there are at most ``capacity`` of them. So
the plan is made from the counts per length: first the Martello-Toth reduction
fixes sets that dominate all alternatives, then best-fit decreasing places what
is left. Both treat equal sequences as one group, so the plan's size depends on
the capacity, never on the number of documents. Spark tokenizes, counts, numbers
the pieces of each length and looks their places up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from argloom.llm.bpe import load
from argloom.session import materialize

Pattern = tuple[tuple[int, int], ...]  # (length, copies), in the order they stand in a sequence


class _Stock:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int]):
        self.left = {length: n for length, n in counts.items() if n > 0}
        self.lengths = sorted(self.left)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.lengths.remove(length)

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest pieces, one of length ``without`` set aside."""
        out: list[int] = []
        for length in self.lengths:
            out += [length] * min(n, self.left[length] - (length == without))
            if len(out) >= n:
                break
        return out[:n]

    def largest_within(self, room: int, without: tuple[int, ...]) -> int | None:
        for k in range(bisect_left(self.lengths, room + 1) - 1, -1, -1):
            if self.left[self.lengths[k]] > without.count(self.lengths[k]):
                return self.lengths[k]
        return None

    def smallest_above(self, length: int, without: tuple[int, ...]) -> list[int]:
        """The two smallest pieces longer than ``length``."""
        out: list[int] = []
        for other in self.lengths[bisect_left(self.lengths, length + 1) :]:
            out += [other] * min(2, max(0, self.left[other] - without.count(other)))
            if len(out) >= 2:
                break
        return out[:2]


def _best_pair(stock: _Stock, first: int, room: int) -> tuple[int, int] | None:
    best = None
    for a in reversed(stock.lengths):
        if a >= room or stock.left[a] <= (a == first):
            continue
        b = stock.largest_within(min(room - a, a), (first, a))
        if b is not None and (best is None or a + b > sum(best)):
            best = (a, b)
    return best


def _dominating(stock: _Stock, first: int, capacity: int) -> tuple[int, ...] | None:
    """A set with the piece ``first`` that no other set with it can beat, if one is known."""
    room = capacity - first
    few = stock.smallest(3, first)
    if not few or few[0] > room:
        return (first,)
    partner = stock.largest_within(room, (first,))
    if partner == room or len(few) < 2 or few[0] + few[1] > room:
        return (first, partner)
    if len(few) == 3 and sum(few) <= room:
        return None
    a, b = _best_pair(stock, first, room)
    if partner >= a + b:
        return (first, partner)
    if partner == a:
        between = stock.smallest_above(b, (first, a))
        if len(between) < 2 or sum(between) > room:
            return (first, a, b)
    return None


def reduce_counts(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Martello-Toth reduction: (pattern, sequences) that are fixed for good, and the counts left.

    Pieces are taken from the longest down. A piece alone, with a partner or
    with two more is fixed when no other set that holds the piece could fill a
    sequence better; the remaining instance then still has an optimal packing.
    """
    stock, fixed = _Stock(counts), []
    again = True
    while again:
        again = False
        for first in sorted(stock.left, reverse=True):
            while stock.left.get(first) and (chosen := _dominating(stock, first, capacity)):
                parts = tuple((x, chosen.count(x)) for x in dict.fromkeys(chosen))
                # Taking pieces away only makes the smallest ones larger, so the reason holds for all of them.
                times = min(stock.left[x] // n for x, n in parts)
                for x, n in parts:
                    stock.take(x, n * times)
                fixed.append((parts, times))
                again = True
    return fixed, dict(stock.left)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts: (pattern, sequences).

    A piece goes where the least room is left; equal pieces go on filling the
    same sequence. Sequences that look alike are kept as one group.
    """
    open_groups: dict[int, list[tuple[Pattern, int]]] = {capacity: []}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        changed: dict[int, list[tuple[Pattern, int]]] = {}
        while left:
            rooms = [r for r, groups in open_groups.items() if groups and r >= length]
            if rooms:
                room = min(rooms)
                pattern, n = open_groups[room].pop()
            else:
                room, pattern, n = capacity, (), -(-left // (capacity // length))
            fits = room // length
            full = min(n, left // fits)
            rest = min(left - full * fits, fits - 1) if full < n else 0
            if full:
                changed.setdefault(room - fits * length, []).append((pattern + ((length, fits),), full))
            if rest:
                changed.setdefault(room - rest * length, []).append((pattern + ((length, rest),), 1))
            if n - full - bool(rest):
                open_groups.setdefault(room, []).append((pattern, n - full - bool(rest)))
            left -= full * fits + rest
        for room, groups in changed.items():
            open_groups.setdefault(room, []).extend(groups)
    return [group for groups in open_groups.values() for group in groups if group[0]]


def plan_slots(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Places as rows ``length, first rank, first sequence, copies, offset``, sorted.

    The piece of a length with rank r, in the last row whose first rank is not
    above r, goes to sequence ``first + (r - first rank) // copies``.
    """
    fixed, rest = reduce_counts(counts, capacity)
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for pattern, n in fixed + best_fit(rest, capacity):
        offset = 0
        for length, copies in pattern:
            slots.append((length, used.get(length, 0), sequence, copies, offset))
            used[length] = used.get(length, 0) + n * copies
            offset += length * copies
        sequence += n
    return np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)


def piece_bounds(size: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of a document's pieces: only the first may be short."""
    at, take = 0, size % capacity or min(size, capacity)
    while at < size:
        yield at, take
        at, take = at + take, capacity


def pack_documents(
    df: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    with_ids: bool = False,
) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A document is its ids followed by ``end_id``; longer ones are cut into
    pieces of ``capacity`` ids. ``with_ids`` adds the ids themselves. Null text
    counts as empty and is the end id alone. Rows with equal keys are separate
    documents; an empty table gives an empty one; other columns are not read.

    The pieces are written to the shared folder once: their numbering within a
    task must not change when a lost executor's work is repeated.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [key, "piece", "start", "length", "ids_crc32", "task", "local"] + ["ids"] * with_ids
    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, local bigint"
    schema += ", ids array<bigint>" * with_ids

    def cut(batches):
        bpe = load(path)
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            ids, bounds = bpe.encode(["" if t is None else t for t in batch.column(1).to_pylist()])
            rows, out, lists = [], [], []
            for row in range(batch.num_rows):
                own = np.append(ids[bounds[row] : bounds[row + 1]], np.uint32(end_id)).astype("<u4")
                for number, (at, size) in enumerate(piece_bounds(len(own), capacity)):
                    part = own[at : at + size]
                    out.append((number, at, size, zlib.crc32(part.tobytes()), task, seen.get(size, 0)))
                    seen[size] = seen.get(size, 0) + 1
                    rows.append(row)
                    if with_ids:
                        lists.append(part.astype(np.int64))
            columns = np.array(out, dtype=np.int64).reshape(-1, 6).T
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))]
            arrays += [pa.array(c, pa.int32() if k in (0, 4) else pa.int64()) for k, c in enumerate(columns)]
            if with_ids:
                arrays.append(pa.array(lists, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    pieces = materialize(
        df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(cut, schema), "pieces"
    )
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task")
    bases = materialize(
        counts.withColumn("base", F.sum("n").over(before) - F.col("n")), "piece-counts"
    )
    by_length = bases.groupBy("length").agg(F.sum("n").alias("n")).collect()  # one row per length
    slots = plan_slots({row["length"]: row["n"] for row in by_length}, capacity)
    # Ranks of one length stay below 2**48, lengths below 2**15.
    starts = slots[:, 0] << 48 | slots[:, 1]

    out_names = names[:5] + ["sequence_id", "offset"] + ["ids"] * with_ids
    out_schema = schema.replace("task int, local bigint", "sequence_id bigint, offset bigint")

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = slots[np.searchsorted(starts, length << 48 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * length
            columns = [batch.column(name) for name in names[:5]]
            columns += [pa.array(sequence), pa.array(offset)]
            if with_ids:
                columns.append(batch.column("ids"))
            yield pa.RecordBatch.from_arrays(columns, names=out_names)

    ranked = pieces.join(bases.drop("n"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("local"))
    return ranked.select(*names[:5], "rank", *["ids"] * with_ids).mapInArrow(place, out_schema)
