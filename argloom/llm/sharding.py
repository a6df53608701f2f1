"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has many points on a ring of hashes. A key belongs to the next point
clockwise; where that point's shard is full, the key walks on to the first point
whose shard has room. All keys between two points walk the same way, so the walk
is worked out for counts of keys per arc, and the plan's size depends on the
number of points alone. Rows are put in ring order once, as narrow rows, and take
their places from the plan by their number.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from argloom.session import materialize

VIRTUAL = 256
OVERHEAD = 16  # bytes that a row counts beside its text


class Ring:
    """Points of all shards in ring order; the points of a shard depend on its number alone."""

    def __init__(self, shards: int, virtual: int = VIRTUAL):
        places = sorted(
            (struct.unpack(">q", sha256(f"{shard}/{copy}".encode()).digest()[:8])[0], shard)
            for shard in range(shards)
            for copy in range(virtual)
        )
        self.shards = shards
        self.points = np.array([point for point, _ in places], dtype=np.int64)
        self.owners = np.array([shard for _, shard in places], dtype=np.int64)

    def arcs(self, hashes: np.ndarray) -> np.ndarray:
        """The arc of every hash: the number of the next point clockwise. After the last one comes the first."""
        return np.searchsorted(self.points, hashes, side="left") % len(self.points)


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most keys of every shard. Without slack they are all taken, and differ by one at most."""
    if slack <= 0:
        return [total // shards + (shard < total % shards) for shard in range(shards)]
    return [-int(-total * (1 + slack) // shards)] * shards


def pour(counts: Sequence[int], owners: Sequence[int], room: Sequence[int]) -> list[list[tuple[int, int]]]:
    """For every arc, the shards that take its keys and how many, in the order of the keys.

    All keys try the shard of their own point first, then all that are left try
    the next point, and so on around the ring: a key is displaced only by keys
    that walked no further than it did.
    """
    room, n = list(room), len(counts)
    taken: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    left = [(arc, int(count)) for arc, count in enumerate(counts) if count]
    distance = 0
    while left:
        after = []
        for arc, count in left:
            shard = owners[(arc + distance) % n]
            take = min(count, room[shard])
            if take:
                room[shard] -= take
                taken[arc].append((shard, take))
            if take < count:
                after.append((arc, count - take))
        left, distance = after, distance + 1
        if left and distance > n:
            raise ValueError("the shards have less room than there are keys")
    return taken


class Plan:
    """Intervals of row numbers in ring order, each going to one shard from one slot on."""

    def __init__(self, counts: np.ndarray, ring: Ring, slack: float = 0.0):
        limits = capacities(int(counts.sum()), ring.shards, slack)
        starts, shards, slots = [], [], []
        filled, at = [0] * ring.shards, 0
        for parts in pour(counts.tolist(), ring.owners.tolist(), limits):
            for shard, count in parts:
                starts.append(at)
                shards.append(shard)
                slots.append(filled[shard])
                filled[shard] += count
                at += count
        self.starts, self.shards, self.slots = (np.array(x, dtype=np.int64) for x in (starts, shards, slots))

    def place(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of rows by their numbers."""
        at = np.searchsorted(self.starts, numbers, side="right") - 1
        return self.shards[at], self.slots[at] + numbers - self.starts[at]


def _number(ring: Ring, width: int):
    """Adds part, number within the part, and arc, to rows in ring order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            arcs = ring.arcs(batch.column("_h").to_numpy())
            columns = [batch.column(i) for i in range(width)]
            own = [np.full(n, part, np.int64), np.arange(at, at + n), arcs]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, own)], names=[*batch.schema.names[:width], "_part", "_at", "_arc"])
            at += n

    return run


def shard_rows(
    df: DataFrame,
    shards: int,
    key: Column,
    order: Sequence[str] = (),
    virtual: int = VIRTUAL,
    slack: float = 0.0,
) -> DataFrame:
    """All columns of ``df`` with ``shard`` and ``slot``, its gapless number there from 0.

    ``key`` is what is hashed onto the ring; rows of equal keys lie together and are
    parted only where a shard is full. ``order`` names columns that order them.
    Without ``slack`` the shards' row counts differ by at most one; with it, a shard
    takes at most ``(1 + slack)`` times its share, and fewer rows move when a shard
    is added.

    A row is moved once, so leave out what can be joined later. Repeated rows are
    rows of their own, told apart by a number written down with them; a key on a
    third of all rows spreads over many tasks. A null key is the key ``''``. An
    empty table gives an empty one.
    """
    ring = Ring(shards, virtual)
    names = df.columns
    clash = {"shard", "slot", "_h", "_row", "_part", "_at", "_arc"} & set(names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    # Written first: the order below is read twice, and must find the same numbers each time.
    rows = df.withColumn("_h", F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "keys")
    # Hashes beyond the last point belong to the first one's arc: they come first, so that every arc is one run of rows.
    wrapped = F.col("_h") <= F.lit(int(ring.points[-1]))
    by = [wrapped, F.col("_h"), *[F.asc_nulls_first(c) for c in order], F.col("_row")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*names, "_h")
    schema = f"{fields}, _part bigint, _at bigint, _arc bigint"
    numbered = materialize(ranged.mapInArrow(_number(ring, len(names)), schema), "ring")

    # Both are bounded: one row per task of the sort, and one per point of the ring.
    parts = {r["_part"]: r["n"] for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(len(ring.points), np.int64)
    for r in numbered.groupBy("_arc").agg(F.count("*").alias("n")).collect():
        counts[r["_arc"]] = r["n"]
    before = np.zeros(max(parts, default=0) + 2, np.int64)
    for part, n in parts.items():
        before[part + 1] = n
    before = np.cumsum(before)
    plan = df.sparkSession.sparkContext.broadcast((before, Plan(counts, ring, slack)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, steps = plan.value
        for batch in batches:
            numbers = before[batch.column("_part").to_numpy()] + batch.column("_at").to_numpy()
            shard, slot = steps.place(numbers) if batch.num_rows else (numbers, numbers)
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shard.astype(np.int32)), pa.array(slot)], names=[*names, "shard", "slot"])

    return numbered.drop("_arc").mapInArrow(place, f"{fields}, shard int, slot bigint")


def shard_documents(df: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", slack: float = 0.0) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` of every document.

    Equal texts are one key of the ring. ``size`` is the bytes of the text and
    :data:`OVERHEAD`; the law is ``rows``, shards whose counts differ by one at
    most, so there is no ``grown_shard``. Null text counts as empty. Other columns
    are not read. See :func:`shard_rows` for the rest.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.xxhash64(content).cast("string").alias("content"),
    )
    found = shard_rows(rows, shards, F.col("content"), ["content", "doc_id"], slack=slack)
    return found.select(
        F.col("doc_id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, shards: int, key: Column, order: Sequence[str] = (), slack: float = 0.0) -> None:
    """All rows as parquet in folders ``shard=...``, in order of their slots within every file."""
    found = shard_rows(df, shards, key, order, slack=slack)
    found.hint("rebalance", "shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
