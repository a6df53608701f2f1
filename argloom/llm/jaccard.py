"""Near-duplicate groups: all documents linked by a Jaccard similarity of word shingles.

Documents with equal shingle sets are one node. Each node has a count vector:
its shingles are hashed into groups and counted. The sum over groups of the
smaller count bounds the overlap of two sets from above. Count vectors are
indexed in R-trees whose boxes keep the largest count per group; what survives
the bound is verified on the sets.

A tree holds the nodes of one cell: those that share one of their rarest
shingles. Two sets that link must share one among the rarest quarter of each, so
no link is lost by looking inside cells only. How many documents hold a shingle is
counted over all of them, in files of sorted hashes that tasks map; a shingle that
only one document holds is the rarest, and makes no cell.

A cell of a thousand near copies has half a million links, and one component. So
links are found in three steps, each of which skips pairs that are connected
already: within each node's largest cell, between one member of each component
in a cell, and last all pairs that are still apart. For the last step cells in
which the same component is the largest are put together, since the pairs in
them are mostly the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, functions as F

from argloom.functions.linear import SharedTable, TableFile
from argloom.llm.components import components
from argloom.llm.lmtrie import _from_planes, _merged, _planes
from argloom.llm.words import BLOCK, buffers, mix, row_groups, windows, words
from argloom.session import materialize, scratch_path

SHINGLE = 5
SHARED_BITS = 48  # of a hash, by which documents that hold a shingle are counted
HELD = 1 << 21  # shingles that a task holds before it hands them on
SHINGLES_PER_RANGE = 1 << 21
CELL_CHUNK = 4096  # members of a cell that are compared at once; larger cells are split
CHUNK_SHINGLES = 1 << 22  # and all shingles of one chunk
SLOT_BITS = 22
LEAF = 16


def doc_sets(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of every text."""
    found = words(data, bounds, fold=True)
    keys, of_row = windows(found, SHINGLE)
    for row in range(len(bounds) - 1):
        own = keys[of_row[row] : of_row[row + 1]]
        few = found.hashes[found.bounds[row] : found.bounds[row + 1]]
        if len(own):
            own = np.sort(own)
            yield own[np.append(True, own[1:] != own[:-1])]
        elif len(few):  # fewer words than a shingle: the whole sequence is the only one
            rolled = np.array([len(few)], dtype=np.uint64)
            for h in few:
                rolled = mix(rolled ^ h)
            yield rolled
        else:
            yield own


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    data, bounds = buffers(column)
    for a, z in row_groups(bounds, BLOCK):
        own = bounds[a : z + 1]
        yield from doc_sets(data[own[0] : own[-1]], own - own[0])


def node_of(shingles: np.ndarray) -> int:
    """One number for a set: equal sets have equal numbers."""
    total = int(mix(shingles).sum(dtype=np.uint64)) + len(shingles)
    return int(mix(np.array([total & ((1 << 64) - 1)], dtype=np.uint64)).view(np.int64)[0])


def groups_for(size: int) -> int:
    """Groups of a count vector: a power of two of at least a quarter of the set, so that counts stay small."""
    return max(16, 1 << max(0, (size - 1) // 4).bit_length())


def count_vector(shingles: np.ndarray) -> np.ndarray:
    groups = groups_for(len(shingles))
    low = (shingles & np.uint64(groups - 1)).astype(np.int64)
    return np.bincount(low, minlength=groups).astype(np.uint8)


def fold(vectors: np.ndarray, groups: int) -> np.ndarray:
    """Count vectors with fewer groups."""
    while vectors.shape[-1] > groups:
        half = vectors.shape[-1] // 2
        vectors = vectors[..., :half] + vectors[..., half:]
    return vectors


class CountTree:
    """An R-tree over count vectors with the same number of groups.

    Points are ordered by size and a few coarse counts, and packed into nodes of
    ``LEAF`` entries. A node keeps the largest count per group and the range of
    sizes below it.
    """

    def __init__(self, vectors: np.ndarray, totals: np.ndarray):
        coarse = fold(vectors.astype(np.int64), 4)
        self.order = np.lexsort((*coarse.T, totals))
        high, least, most = vectors[self.order], totals[self.order], totals[self.order]
        self.levels = [(high, least, most)]
        while len(high) > LEAF:
            starts = np.arange(0, len(high), LEAF)
            high = np.maximum.reduceat(high, starts, axis=0)
            least, most = np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)
            self.levels.append((high, least, most))

    def search(self, vector: np.ndarray, total: int) -> np.ndarray:
        """Points no larger than ``total`` whose overlap may reach three quarters of the union."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most = self.levels[depth]
            at = at[(least[at] <= total) & (4 * most[at] >= 3 * total)]
            bound = np.minimum(high[at], vector).sum(axis=1, dtype=np.int64)
            at = at[7 * bound >= 3 * (total + least[at])]
            if depth:
                below = len(self.levels[depth - 1][0])
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < below]
        return self.order[at]


def surviving(vectors: list[np.ndarray], totals: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each member, the earlier ones in order of (size, place) that survive the bound."""
    groups = np.array([len(v) for v in vectors])
    place = np.empty(len(totals), dtype=np.int64)
    place[np.argsort(totals, kind="stable")] = np.arange(len(totals))
    trees = {}
    for g in set(groups.tolist()):
        rows = np.flatnonzero(groups == g)
        trees[g] = (rows, CountTree(np.stack([vectors[r] for r in rows]), totals[rows]))
    for i in np.argsort(place):
        hits = []
        # A set of at least three quarters of the size has as many groups, or half as many.
        for g in (groups[i], groups[i] // 2):
            if g in trees:
                rows, tree = trees[g]
                hits.append(rows[tree.search(fold(vectors[i], g), totals[i])])
        hits = np.concatenate(hits)
        yield int(i), hits[place[hits] < place[i]]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 times the intersection reaches 75 times the union."""
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 75 * (len(a) + len(b) - common)


def _linked_to(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """:func:`linked` for many sets at once."""
    sizes = np.array([len(b) for b in others])
    flat = np.concatenate(others)
    place = np.minimum(np.searchsorted(a, flat), len(a) - 1)
    common = np.add.reduceat(a[place] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 100 * common >= 75 * (len(a) + sizes - common)


def local_links(
    sets: list[np.ndarray], labels: np.ndarray, chunks: np.ndarray | None = None, first_tries: int = 6
) -> list[tuple[int, int]]:
    """Enough links to connect whatever the members connect; equal labels are connected already.

    With ``chunks``, only pairs from different chunks are looked at.
    """
    totals = np.array([len(s) for s in sets])
    label = np.unique(labels, return_inverse=True)[1]
    out = []
    for i, hits in surviving([count_vector(s) for s in sets], totals):
        if chunks is not None:
            hits = hits[chunks[hits] != chunks[i]]
        # Near sizes first: they are the likeliest to link.
        left = hits[np.argsort(-totals[hits], kind="stable")]
        for tries in range(first_tries + 1):
            left = left[label[left] != label[i]]
            if not len(left):
                break
            tried = left[:1] if tries < first_tries else left
            found = tried[_linked_to(sets[i], [sets[j] for j in tried])]
            for j in found:
                if label[j] != label[i]:
                    out.append((i, int(j)))
                    label[label == label[j]] = label[i]
            left = left[len(tried) :]
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys, from batches sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = np.stack([table[k].to_numpy() for k in keys], axis=1)
        change = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        bounds = [0, *change.tolist(), len(values)]
        for a, z in zip(bounds[:-1], bounds[1:]):
            if held and not np.array_equal(last, values[a]):
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, z - a))
            last = values[a]
    if held:
        yield pa.concat_tables(held)


def _numbers(column) -> np.ndarray:
    return np.frombuffer(column, dtype=np.uint64)


def fixed_table(df: DataFrame, slots_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """How often each of ``size`` slots is met by the arrays that ``slots_of`` yields for a batch.

    Tasks send the slots that they met, in parts, and Spark adds up each part;
    what reaches the driver has the fixed size, whatever the input.
    """
    parts = min(64, size)
    step = size // parts
    schema = "part int, slots binary, counts binary"

    def rows(table: dict[int, np.ndarray]) -> pa.RecordBatch:
        met = {k: np.flatnonzero(v) for k, v in table.items()}
        columns = [
            pa.array(list(met), pa.int32()),
            pa.array([v.astype("<i4").tobytes() for v in met.values()], pa.binary()),
            pa.array([table[k][v].astype("<i8").tobytes() for k, v in met.items()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["part", "slots", "counts"])

    def count(batches):
        total = np.zeros(size, dtype=np.int32)
        for batch in batches:
            for slots in slots_of(batch):
                np.add.at(total, slots, 1)
        for k in range(parts):
            own = total[k * step : (k + 1) * step]
            if own.any():
                yield rows({k: own})

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, slots, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own = total.setdefault(part, np.zeros(step, dtype=np.int64))
                own[np.frombuffer(slots.as_buffer(), "<i4")] += np.frombuffer(counts.as_buffer(), "<i8")
        yield rows(total)

    merged = df.mapInArrow(count, schema).repartition(parts, "part").mapInArrow(merge, schema)
    table = np.zeros(size, dtype=np.int64)
    for row in merged.collect():
        at = np.frombuffer(row["slots"], "<i4").astype(np.int64) + row["part"] * step
        table[at] += np.frombuffer(row["counts"], "<i8")
    return table


def _short(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SHARED_BITS)).astype(np.int64)


def _counted(held: list[np.ndarray], width: int) -> pa.RecordBatch:
    """How many of the sets hold each shingle, one row for each range of hashes; empties the list.

    Works in place where it can: a worker has room for a few arrays of this length, not for many.
    """
    keys = np.concatenate(held)
    held.clear()
    keys >>= np.uint64(64 - SHARED_BITS)
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.diff(np.append(first, len(keys))).astype("<u4")
    keys = keys[first]
    del first
    at = (keys >> np.uint64(width)).astype(np.int32)
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    ends = np.append(starts[1:], len(at))
    columns = [
        pa.array(at[starts]),
        pa.array((_planes(keys[a:z]) for a, z in zip(starts, ends)), pa.binary(), size=len(starts)),
        pa.array((counts[a:z].tobytes() for a, z in zip(starts, ends)), pa.binary(), size=len(starts)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["range", "keys", "counts"])


def shared_shingles(texts: DataFrame, ranges: int) -> SharedTable:
    """How many sets hold each shingle, of those that several hold.

    Shingles are known by the first :data:`SHARED_BITS` bits of their hashes. Two
    that agree in them count as one, which costs time and never a link. They
    travel as differences of sorted numbers, one array for each range and task;
    equal sets within a task count once. Each range of hashes is a file.
    """
    root = scratch_path(texts.sparkSession, "shingles")
    bits = max(1, (ranges - 1).bit_length())
    width = SHARED_BITS - bits

    def emit(batches):
        held, size = [], 0
        seen: set[int] = set()

        for batch in batches:
            for shingles in _sets(batch.column(0)):
                if not len(shingles) or (node := node_of(shingles)) in seen:
                    continue
                seen.add(node)
                held.append(shingles)
                size += len(shingles)
                if size >= HELD:
                    yield _counted(held, width)
                    seen.clear()
                    size = 0
        if size:
            yield _counted(held, width)

    def merge(batches):
        parts: dict[int, list] = {}  # of the one range that the task gets
        waiting = 0
        for batch in batches:
            for k, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own = (_from_planes(keys.as_buffer()), np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64))
                parts.setdefault(k, []).append(own)
                waiting += len(own[0])
                if waiting >= HELD // 4:
                    parts[k], waiting = [_merged(parts[k])], 0
        system, place = FileSystem.from_uri(root)
        system.create_dir(place, recursive=True)
        rows = []
        for k in sorted(parts):
            keys, counts = _merged(parts.pop(k))
            keys, counts = keys[counts > 1].astype(np.int64), counts[counts > 1]
            if not len(keys):
                continue
            name = f"{k}-{uuid.uuid4().hex}"  # a repeated task writes files of its own
            for kind, values in (("hashes", keys), ("weights", counts)):
                with system.open_output_stream(f"{place}/{name}.{kind}") as file:
                    file.write(values.tobytes())
            rows.append((int(keys[0]), int(keys[-1]), name))
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("first", "last", "name"), map(list, zip(*rows)))))

    packed = texts.select("text").mapInArrow(emit, "range int, keys binary, counts binary")
    # By number, not by hash: no task holds two ranges.
    ranged = packed.repartitionById(1 << bits, F.col("range"))
    found = ranged.mapInArrow(merge, "first bigint, last bigint, name string").collect()
    files = [TableFile(r["first"], r["last"], f"{root}/{r['name']}.hashes", f"{root}/{r['name']}.weights") for r in sorted(found)]
    return SharedTable(tuple(files))  # one row a range


def wanted_slots(nodes: DataFrame) -> np.ndarray:
    """A table of fixed size that is true at the slot of every wanted node, and at few others."""

    def slots(batch):
        yield (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    return fixed_table(nodes.select("node"), slots, 1 << SLOT_BITS) > 0


def rarest(shingles: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Places of the shingles of which a set must share one with whatever it links to: the rarest quarter and one.

    ``seen`` tells how many sets hold each; equal numbers go in order of the hashes.
    """
    keep = len(shingles) - -(-3 * len(shingles) // 4) + 1
    return np.argsort(seen, kind="stable")[:keep]


def find_cells(texts: DataFrame, shared: SharedTable, ranges: int) -> DataFrame:
    """``cell, node``: groups of two or more nodes that share one of their rarest shingles.

    Cells with the same nodes are one cell. Shingles that no other document holds
    do not travel; the others go as packed arrays, one for each range of hashes
    and task.
    """

    def emit(batches):
        keys, nodes, size = [], [], 0
        seen: set[int] = set()
        waiting: list[tuple[int, np.ndarray]] = []

        def look_up():
            """Of the sets that wait, those of the rarest shingles that others hold too."""
            counts = shared.find(_short(np.concatenate([own for _, own in waiting])))
            at = 0
            for node, own in waiting:
                held = counts[at : at + len(own)]
                at += len(own)
                places = rarest(own, held)
                places = places[held[places] > 1]
                if len(places):
                    keys.append(own[places])
                    nodes.append(np.full(len(places), node, dtype=np.int64))
            waiting.clear()
            return sum(map(len, keys))

        def out():
            k, n = np.concatenate(keys), np.concatenate(nodes)
            at = (k % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            k, n, at = k[order], n[order], at[order]
            firsts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            ends = np.append(firsts[1:], len(at))
            # Nodes as places in a short list: they repeat, and small numbers take little room.
            lists = [np.unique(n[a:z], return_inverse=True) for a, z in zip(firsts, ends)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(at[firsts], pa.int32()),
                    pa.array([k[a:z].tobytes() for a, z in zip(firsts, ends)], pa.binary()),
                    pa.array([own.tobytes() for own, _ in lists], pa.binary()),
                    pa.array([place.astype("<i4").tobytes() for _, place in lists], pa.binary()),
                ],
                names=["range", "keys", "nodes", "places"],
            )

        for batch in batches:
            for shingles in _sets(batch.column(0)):
                if not len(shingles):
                    continue
                node = node_of(shingles)
                if node in seen:
                    continue
                seen.add(node)
                waiting.append((node, shingles))
                size += len(shingles)
                if size < HELD // 4:
                    continue
                size = 0
                if look_up() > 1 << 20:
                    yield out()
                    keys, nodes = [], []
                    seen.clear()
        if waiting:
            look_up()
        if keys:
            yield out()

    def meet(batches):
        keys: dict[int, list] = {}
        for batch in batches:
            for r, *blobs in zip(batch.column(0).to_pylist(), *(batch.column(c) for c in (1, 2, 3))):
                k, n, place = (np.frombuffer(b.as_buffer(), kind) for b, kind in zip(blobs, (np.uint64, np.int64, "<i4")))
                keys.setdefault(r, []).append((k, n[place]))
        for r in list(keys):
            k, n = (np.concatenate(x) for x in zip(*keys.pop(r)))
            order = np.lexsort((n, k))
            k, n = k[order], n[order]
            once = np.append(True, (k[1:] != k[:-1]) | (n[1:] != n[:-1]))
            k, n = k[once], n[once]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            sizes = np.diff(np.append(first, len(k)))
            sums = np.add.reduceat(mix(n.view(np.uint64)), first)
            cell = mix(sums + sizes.astype(np.uint64))
            _, kept = np.unique(cell, return_index=True)
            kept = kept[sizes[kept] > 1]
            if len(kept):
                rows = np.concatenate([np.arange(first[g], first[g] + sizes[g]) for g in kept])
                cells = np.repeat(cell[kept], sizes[kept]).view(np.int64)
                for at in range(0, len(rows), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(cells[part]), pa.array(n[rows[part]])], names=["cell", "node"])

    packed = texts.select("text").mapInArrow(emit, "range int, keys binary, nodes binary, places binary")
    met = packed.repartitionById(ranges, F.col("range")).mapInArrow(meet, "cell bigint, node bigint")
    return met.distinct()


def describe(df: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, node, vector`` of every row of ``doc_id, text``."""

    def run(batches):
        for batch in batches:
            sizes, nodes, vectors = [], [], []
            for shingles in _sets(batch.column(1)):
                sizes.append(len(shingles))
                nodes.append(node_of(shingles) if len(shingles) else None)
                vectors.append(count_vector(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(vectors, pa.binary())],
                names=["doc_id", "n_shingles", "node", "vector"],
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, node bigint, vector binary")


def _sorted_cells(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, "node")


def _vectors(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.uint8) for chunk in table["vector"].chunks for v in chunk]


def _split(cells: DataFrame) -> DataFrame:
    """Add ``size``, ``chunks`` and ``chunk``: large cells are dealt over several chunks."""
    sizes = cells.groupBy("cell").agg(
        F.count("*").alias("size"),
        F.greatest(F.ceil(F.count("*") / CELL_CHUNK), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)).alias("chunks"),
    )
    return cells.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("node", "cell"), F.col("chunks")))


def alive_members(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """``cell, node, n_shingles`` of the members for which some other member survives the bound.

    Members of a cell of several chunks all stay: the steps to come connect
    them first, and only what is left apart is compared across chunks.
    """

    def run(batches):
        for table in runs(batches, ["cell"]):
            seen = np.zeros(table.num_rows, dtype=bool)
            for i, hits in surviving(_vectors(table), table["n_shingles"].to_numpy()):
                if len(hits):
                    seen[i] = True
                    seen[hits] = True
            if seen.any():
                kept = table.select(["cell", "node", "n_shingles"]).filter(pa.array(seen)).combine_chunks()
                yield from kept.to_batches()

    # Cells are split before the vectors join them, so that vectors travel to their cells once.
    split = materialize(_split(cells.join(nodes.select("node", "n_shingles"), "node")), "split")
    schema = "cell bigint, node bigint, n_shingles bigint"
    small = split.where("chunks = 1").select("cell", "node").join(nodes, "node")
    small = _sorted_cells(small.select("cell", "node", "n_shingles", "vector"), "cell")
    large = split.where("chunks > 1").select("cell", "node", "n_shingles")
    return small.mapInArrow(run, schema).unionByName(large)


def _links(rows: DataFrame, keys: list[str], across: bool) -> DataFrame:
    """Links ``a, b`` among the members ``node, shingles, root`` with equal keys.

    With ``across`` the keys end in two chunks, and of members from both only
    pairs from one to the other are looked at.
    """
    columns = [*keys, "node", "root", "shingles"] + ["chunk"] * across

    def run(batches):
        for table in runs(batches, keys):
            nodes = table["node"].to_numpy()
            sets = [_numbers(s.as_buffer()) for chunk in table["shingles"].chunks for s in chunk]
            chunks = table["chunk"].to_numpy() if across and table["left"][0] != table["right"][0] else None
            pairs = np.array(local_links(sets, table["root"].to_numpy(), chunks), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], names=["a", "b"])

    return _sorted_cells(rows.select(*columns), *keys).mapInArrow(run, "a bigint, b bigint")


def links_within(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect the members ``node, root`` of each ``cell, chunk``."""
    return _links(rows.join(sets, "node"), ["cell", "chunk"], across=False)


def links_across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect what is apart in each cell of ``cell, node, n_shingles, root``.

    Every pair of chunks of a large cell is compared.
    """
    rows = _split(members)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    rows = rows.withColumn("left", F.least("chunk", "other")).withColumn("right", F.greatest("chunk", "other"))
    return _links(rows.join(sets, "node"), ["cell", "left", "right"], across=True)


def together(members: DataFrame) -> DataFrame:
    """Cells in which the same root has the most members as one cell of all their members."""
    counts = members.groupBy("cell", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("_main"))
    joined = members.join(main, "cell").select(F.col("_main").alias("cell"), "node", "n_shingles", "root")
    return joined.distinct()


def sets_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles`` of the wanted nodes, made from the texts again.

    The table of slots keeps most unwanted sets from being sent; the join drops the rest.
    """
    shared = texts.sparkSession.sparkContext.broadcast(wanted_slots(nodes))

    def run(batches):
        wanted = shared.value
        seen: set[int] = set()
        for batch in batches:
            out = []
            for shingles in _sets(batch.column(0)):
                if not len(shingles):
                    continue
                node = node_of(shingles)
                if wanted[(node & ((1 << 64) - 1)) >> (64 - SLOT_BITS)] and node not in seen:
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(node)
                    out.append((node, shingles.tobytes()))
            columns = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles"])

    made = texts.select("text").mapInArrow(run, "node bigint, shingles binary")
    return made.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    return df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id`` of every row: the smallest id reachable by links.

    Texts without words, and null texts, have no shingles and are their own
    component, and so are rows without an id, whose component is null. Rows
    that repeat an id stay separate; their components meet in that id. An empty
    table gives an empty result. Other columns are not read.
    """
    texts = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    named = texts.where(F.col("doc_id").isNotNull())
    docs = materialize(describe(texts), "described")
    size = docs.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    ranges = max(8, -(-size // SHINGLES_PER_RANGE))
    cells = materialize(find_cells(named, shared_shingles(named, ranges), ranges), "cells")
    known = docs.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = materialize(
        known.join(cells.select("node").distinct(), "node", "left_semi")
        .select("node", "n_shingles", "vector")
        .dropDuplicates(["node"]),
        "nodes",
    )
    alive = materialize(alive_members(cells, nodes), "alive")
    sets = materialize(sets_of(named, alive.select("node").distinct()), "sets")

    # First step: every node in its largest cell.
    best = _split(alive).groupBy("node").agg(F.max_by(F.struct("cell", "chunk"), F.struct("size", "cell")).alias("best"))
    first = best.select("node", "best.*", F.col("node").alias("root"))
    links = materialize(links_within(first, sets), "links1")
    roots = components(links)

    def apart(df):
        """Members with their roots, of the cells that hold several."""
        df = materialize(_rooted(df, roots), "rooted")
        mixed = df.groupBy("cell").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).where("_l <> _h")
        return df.join(mixed.select("cell"), "cell", "left_semi")

    # Second step: one member of each component in a cell.
    one = apart(alive).groupBy("cell", "root").agg(
        F.min_by(F.struct("node", "n_shingles"), F.xxhash64("node", "cell")).alias("one")
    )
    second = _split(one.select("cell", "root", "one.*")).select("cell", "chunk", "node", "root")
    links = links.unionByName(materialize(links_within(second, sets), "links2"))
    roots = components(links)

    # Third step: all pairs that are still apart.
    links = links.unionByName(materialize(links_across(together(apart(alive)), sets), "links3"))
    roots = components(links)

    smallest = _rooted(known.groupBy("node").agg(F.min("doc_id").alias("_doc")), roots)
    lowest = smallest.groupBy("root").agg(F.min("_doc").alias("component_id"))
    by_node = smallest.join(lowest, "root").select("node", "component_id")
    linked_docs = known.select("doc_id", "n_shingles", "node").join(by_node, "node").drop("node")
    alone = docs.where(F.col("node").isNull() | F.col("doc_id").isNull())
    alone = alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked_docs.unionByName(alone).withColumnRenamed("doc_id", key)
