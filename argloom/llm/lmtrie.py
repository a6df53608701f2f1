"""Language-model scores from an n-gram trie in memory-mapped levels.

Level 1 is the vocabulary: hashes of words in order, the place of a word being
its id. Level k holds, for every n-gram of k words, its last word under the node
of the words before it. Nodes are numbered in order, so the successors of a node
stand together, and their positions are monotone. All sequences are Elias-Fano
coded. From level 3 on, a word is not written by its id but by its place among
the successors of the shorter context, which takes fewer bits.

Probabilities are smoothed by the number of distinct successors (Witten-Bell),
interpolated with the shorter context, and kept in one byte each. The trie is
counted over all training texts and cut into shards of bounded size by node
ranges; a frequent context may span shards. Shards are files in the shared
folder; tasks map them into memory and search for the distinct n-grams of a
block of text at once.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from argloom.llm.eliasfano import EliasFano
from argloom.llm.words import buffers, distinct, mix, row_groups, sums, words
from argloom.session import scratch_path

BLOCK = 1 << 22
HELD = 1 << 21  # distinct n-grams that a task holds before it hands them on
SHARD = 1 << 22  # about so many n-grams, as tasks hand them on, make one shard
END = int(mix(np.array([0x656E64], dtype=np.uint64))[0])  # the end of a text, a token like any other
_U = np.uint64


# ---- files in the shared folder -------------------------------------------------------------


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _write(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file with all arrays; written aside and renamed, so a repeated task does no harm."""
    store, place = _store(path)
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    aside = f"{place}.{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as out:
        head = "".join(f"{k},{v.dtype.str},{len(v)};" for k, v in arrays.items()).encode()
        out.write(head.ljust(1024))
        for v in arrays.values():
            raw = v.tobytes()
            out.write(raw + b"\0" * (-len(raw) % 64))
    store.move(aside, place)


@lru_cache(maxsize=4096)
def _read(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory where the shared folder allows."""
    store, place = _store(path)
    if isinstance(store, fs.LocalFileSystem):
        raw = np.asarray(np.memmap(place, dtype=np.uint8, mode="r"))
    else:
        with store.open_input_file(place) as file:
            raw = np.frombuffer(file.read(), dtype=np.uint8)
    out, at = {}, 1024
    for entry in raw[:1024].tobytes().decode().strip().rstrip(";").split(";"):
        name, kind, size = entry.split(",")
        end = at + int(size) * np.dtype(kind).itemsize
        out[name] = raw[at:end].view(kind)
        at = end + -(end - at) % 64
    return out


# ---- the trie -------------------------------------------------------------------------------


def quantise(log10: np.ndarray, floor: float) -> np.ndarray:
    """One byte for a log10 probability between ``floor`` and 0."""
    return np.rint(np.clip(log10 / floor, 0, 1) * 255).astype(np.uint8)


def restore(code: np.ndarray, floor: float) -> np.ndarray:
    return code * (floor / 255)


@dataclass
class Level:
    """Shards of one level: where they are, the first key of each, and the node it starts with."""

    paths: list[str]
    firsts: np.ndarray
    bases: np.ndarray  # one more than shards: the last is the number of nodes
    universe: int  # keys of one context
    total: int  # tokens counted

    @property
    def n(self) -> int:
        return int(self.bases[-1])

    def _each(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The rows of each shard; sorted shards need no search."""
        order = slice(None) if (np.diff(shard) >= 0).all() else np.argsort(shard, kind="stable")
        rows = np.arange(len(shard))[order]
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for own in np.split(rows, cuts) if len(rows) else []:
            yield int(shard[own[0]]), own

    def _sequence(self, k: int) -> EliasFano:
        a = _read(self.paths[k])
        n, width = int(a["shape"][0]), int(a["shape"][1])
        return EliasFano(n, width, a["low"], a["high"], a["before"])

    def search(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first node whose key is not below each key, and whether the key is there."""
        node, found = np.full(len(keys), self.n, dtype=np.int64), np.zeros(len(keys), dtype=bool)
        if not self.paths or not len(keys):
            return node, found
        shard = np.maximum(np.searchsorted(self.firsts, keys, side="right") - 1, 0)
        for k, rows in self._each(shard):
            own = keys[rows]
            sequence = self._sequence(k)
            last = int(_read(self.paths[k])["shape"][2])
            inside = (own >= self.firsts[k]) & (own <= _U(last))
            place = np.where(own < self.firsts[k], 0, sequence.n)
            hit = np.zeros(len(own), dtype=bool)
            place[inside], hit[inside] = sequence.successor(own[inside] - self.firsts[k])
            node[rows], found[rows] = self.bases[k] + place, hit
        return node, found

    def first_of(self, context: np.ndarray) -> np.ndarray:
        """The pointer of a context: the node where its successors start."""
        return self.search(context.astype(np.uint64) * _U(self.universe))[0]

    def of_nodes(self, nodes: np.ndarray, get: Callable[[dict, np.ndarray], np.ndarray], kind) -> np.ndarray:
        out = np.zeros(len(nodes), dtype=kind)
        shard = np.searchsorted(self.bases, nodes, side="right") - 1
        for k, rows in self._each(shard):
            out[rows] = get(k, nodes[rows] - self.bases[k])
        return out

    def counts(self, nodes: np.ndarray) -> np.ndarray:
        def get(k, at):
            a = _read(self.paths[k])
            out = a["count"][at].astype(np.int64)
            large = np.flatnonzero(out == 255)
            out[large] = a["large_count"][np.searchsorted(a["large_at"], at[large])]
            return out

        return self.of_nodes(nodes, get, np.int64)

    def log_probs(self, nodes: np.ndarray, floor: float) -> np.ndarray:
        def get(k, at):
            return restore(_read(self.paths[k] + ".prob")["code"][at].astype(np.float64), floor)

        return self.of_nodes(nodes, get, np.float64)


@dataclass
class Trie:
    levels: list[Level] = field(default_factory=list)

    @property
    def vocabulary(self) -> Level:
        return self.levels[0]

    @property
    def floor(self) -> float:
        """log10 of the least probability an n-gram of any level can have.

        It occurs at least once, and its context occurs at most as often as there
        are tokens, before at most as many words as there are. So no probability
        is cut off, however large the corpus.
        """
        return -math.log10(max(2, self.vocabulary.total + self.vocabulary.n))

    def _unknown(self) -> float:
        """log10 probability of the one word that stands for all unknown ones."""
        n, v = self.vocabulary.total, self.vocabulary.n
        return math.log10(v / (n + v)) if v else 0.0

    def _find(self, keys: np.ndarray, level: Level) -> np.ndarray:
        """Nodes of keys, -1 where there is none; equal keys are searched once, in order."""
        own, _, inverse = distinct(keys)
        node, found = level.search(own)
        return np.where(found, node, -1)[inverse]

    def nodes(self, hashes: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
        """The node of every n-gram that ends at each token, one array a level; -1 where it was never seen.

        ``start`` marks the tokens before the first word of a text.
        """
        out = [self._find(hashes, self.vocabulary)]
        relative = out[0]
        for k, level in enumerate(self.levels[1:], 2):
            context = np.full(len(hashes), -1, dtype=np.int64)
            context[1:] = out[-1][:-1]
            ok = (context >= 0) & (relative >= 0) & ~start
            node = np.full(len(hashes), -1, dtype=np.int64)
            node[ok] = self._find(context[ok].astype(np.uint64) * _U(level.universe) + relative[ok].astype(np.uint64), level)
            if k < len(self.levels):
                # The next level writes a word by its place among the successors of this one's context.
                relative = np.where(node >= 0, node - self._pointers(context, node >= 0, level), -1)
            out.append(node)
        return out

    def _pointers(self, context: np.ndarray, ok: np.ndarray, level: Level) -> np.ndarray:
        out = np.zeros(len(context), dtype=np.int64)
        own, _, inverse = distinct(context[ok])
        out[ok] = level.first_of(own)[inverse]
        return out

    def score(self, hashes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of every token (0 at the starts), and the vocabulary's counts (0: unknown)."""
        nodes = self.nodes(hashes, start)
        counts = np.zeros(len(hashes), dtype=np.int64)
        known = np.flatnonzero(nodes[0] >= 0)
        counts[known] = self.vocabulary.counts(nodes[0][known])
        log10, floor = np.zeros(len(hashes)), self.floor
        left = np.flatnonzero(~start)
        # From the longest n-grams down: only tokens that are not found go on, with their context's weight.
        for k in range(len(self.levels) - 1, -1, -1):
            level, node = self.levels[k], nodes[k][left]
            hit = left[node >= 0]
            log10[hit] += level.log_probs(nodes[k][hit], floor)
            left = left[node < 0]
            if not k:
                log10[left] += self._unknown()
                break
            context = nodes[k - 1][left - 1]
            # A start is a context of one word and of no more.
            seen = (context >= 0) & ((k == 1) | ~start[left - 1])
            own, _, inverse = distinct(context[seen])
            types = level.first_of(own + 1) - level.first_of(own)
            total = self.levels[k - 1].counts(own)
            # A context that only ends texts has no successors, and leaves the shorter one as it is.
            weight = np.where(types > 0, types / np.maximum(total + types, 1), 1.0)
            log10[left[seen]] += np.log10(weight)[inverse]
        return log10, counts


# ---- building -------------------------------------------------------------------------------


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a start mark, the words and the end of every text; where the starts are; each row's range."""
    found = words(data, bounds, fold=True)
    rows = len(bounds) - 1
    at = found.bounds + 2 * np.arange(rows + 1)
    hashes = np.full(int(at[-1]), END, dtype=np.uint64)
    start = np.zeros(int(at[-1]), dtype=bool)
    start[at[:-1]] = True
    inner = np.ones(int(at[-1]), dtype=bool)
    inner[at[:-1]] = False
    inner[at[1:] - 1] = False
    hashes[inner] = found.hashes
    return hashes, start, at


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, bounds = buffers(column)
    for a, z in row_groups(bounds, BLOCK):
        own = bounds[a : z + 1]
        yield a, z, *_tokens(data[own[0] : own[-1]], own - own[0])


def _planes(keys: np.ndarray) -> bytes:
    """Differences of sorted keys, byte by byte: the upper bytes are zeros, which compress away."""
    steps = np.diff(keys, prepend=_U(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _count(texts: DataFrame, keys_of: Callable, firsts: np.ndarray, path: str) -> list:
    """Count the keys of all texts and write one file of sorted keys and counts per shard.

    ``firsts`` are the first keys of the shards. Returns (shard, nodes, last key,
    tokens) of the shards that are not empty, in order.
    """

    def emit(batches):
        held: list = []
        size = 0

        def out(keys, counts):
            shard = np.searchsorted(firsts, keys, side="right") - 1
            at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            ends = np.append(at[1:], len(keys))
            columns = [
                pa.array(shard[at], pa.int32()),
                pa.array([_planes(keys[a:z]) for a, z in zip(at, ends)], pa.binary()),
                pa.array([counts[a:z].astype(np.uint32).tobytes() for a, z in zip(at, ends)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "keys", "counts"])

        for batch in batches:
            for _, _, hashes, start, _ in _blocks(batch.column(0)):
                keys = np.sort(keys_of(hashes, start))
                if not len(keys):
                    continue
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                held.append((keys[first], np.diff(np.append(first, len(keys)))))
                size += len(first)
                if size > HELD:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield out(*held[0])
                        held, size = [], 0
        if size:
            yield out(*_merged(held))

    def build(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            for k, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own = (_from_planes(keys.as_buffer()), np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64))
                parts.setdefault(k, []).append(own)
                if len(parts[k]) >= 16:
                    parts[k] = [_merged(parts[k])]
        rows = []
        for k in sorted(parts):
            keys, counts = _merged(parts.pop(k))
            # Shards that follow each other start where the one before ends, so this is their range.
            reach = int(keys[-1] - firsts[k]) + 1
            code = EliasFano.encode(keys - firsts[k], reach)
            large = np.flatnonzero(counts >= 255)
            arrays = {
                "shape": np.array([len(keys), code.width, keys[-1]], dtype=np.uint64),
                "low": code.low, "high": code.high, "before": code.before,
                "count": np.minimum(counts, 255).astype(np.uint8),
                "large_at": large.astype(np.int64), "large_count": counts[large].astype(np.int64),
            }
            _write(f"{path}/{k}", arrays)
            rows.append((k, len(keys), int(counts.sum())))
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "n", "total"])

    packed = texts.select("text").mapInArrow(emit, "shard int, keys binary, counts binary")
    # By number, not by hash: no task gets two shards.
    built = packed.repartitionById(len(firsts), F.col("shard")).mapInArrow(build, "shard bigint, n bigint, total bigint")
    return sorted((r["shard"], r["n"], r["total"]) for r in built.collect())  # one row a shard


def _level(found: list, firsts: np.ndarray, path: str, universe: int) -> Level:
    bases = np.concatenate([[0], np.cumsum([n for _, n, _ in found])]).astype(np.int64)
    own = firsts[[k for k, _, _ in found]] if found else np.zeros(0, np.uint64)
    return Level([f"{path}/{k}" for k, _, _ in found], own, bases, universe, sum(t for _, _, t in found))


def _on_shards(spark, level: Level, work: Callable[[int], list[tuple]], schema: str) -> list:
    """Run ``work`` once per shard, in tasks; returns its rows, a bounded number per shard."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        for batch in batches:
            rows = [row for k in batch.column(0).to_pylist() for row in work(k)]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    shards = spark.range(len(level.paths)).repartitionById(max(1, len(level.paths)), F.col("id").cast("int"))
    return shards.mapInArrow(run, schema).collect()


def _write_probs(spark, trie: Trie) -> int:
    """Give every node of the last level its probability; returns the most successors of a context."""
    level, floor = trie.levels[-1], trie.floor
    order = len(trie.levels)

    def work(k: int) -> list[tuple]:
        keys = level._sequence(k).decode() + level.firsts[k]
        nodes = np.arange(len(keys)) + level.bases[k]
        counts = level.counts(nodes)
        if order == 1:
            n, v = level.total, level.n
            _write(level.paths[k] + ".prob", {"code": quantise(np.log10(counts / (n + v)), floor)})
            return [(0,)]
        context = (keys // _U(level.universe)).astype(np.int64)
        relative = (keys % _U(level.universe)).astype(np.int64)
        # Successors of a context stand together, so its pointer and its number of them show in the shard itself.
        fresh = np.append(True, context[1:] != context[:-1])
        begins = np.flatnonzero(fresh)
        own, at = context[begins], np.cumsum(fresh) - 1
        types = np.diff(np.append(begins, len(keys)))
        # Only the first and the last one may go on in other shards: pointers are numbers of nodes over all shards.
        ends = np.unique([0, len(own) - 1])
        types[ends] = level.first_of(own[ends] + 1) - level.first_of(own[ends])
        total = trie.levels[-2].counts(own)
        shorter = relative
        if order == 3:  # the last word of the context leads to the shorter n-gram
            middle = trie.levels[1]
            last = middle.of_nodes(own, lambda s, places: _keys_at(middle, s, places) % _U(middle.universe), np.uint64)
            words, _, inverse = distinct(last)
            shorter = middle.first_of(words)[inverse][at] + relative
        lower = 10.0 ** trie.levels[order - 2].log_probs(shorter, floor)
        p = (counts + types[at] * lower) / (total + types)[at]
        _write(level.paths[k] + ".prob", {"code": quantise(np.log10(p), floor)})
        return [(int(types.max()),)]

    return max((r["types"] for r in _on_shards(spark, level, work, "types bigint")), default=0)


def _keys_at(level: Level, shard: int, places: np.ndarray) -> np.ndarray:
    return level._sequence(shard).decode()[places] + level.firsts[shard]


def _cuts(spark, trie: Trie, universe: int) -> np.ndarray:
    """First keys of the next level's shards, so that each gets about as many tokens.

    A node of the last level has about as many successor tokens as it has
    tokens. One that has more than a shard's share is cut between its words.
    """
    level = trie.levels[-1]
    shards = -(-level.total // SHARD)
    share = max(1, -(-level.total // max(1, shards)))
    totals = {r["shard"]: r["total"] for r in _on_shards(spark, level, lambda k: [(k, int(level.counts(np.arange(level.bases[k], level.bases[k + 1])).sum()))], "shard bigint, total bigint")}
    before = np.concatenate([[0], np.cumsum([totals[k] for k in range(len(level.paths))])])

    def work(k: int) -> list[tuple]:
        counts = level.counts(np.arange(level.bases[k], level.bases[k + 1]))
        ends = before[k] + np.cumsum(counts)
        out = []
        for cut in range(int(-(-before[k] // share)) * share, int(ends[-1]), share):
            node = int(np.searchsorted(ends, cut, side="right"))
            part = (cut - (ends[node] - counts[node])) / counts[node]
            out.append(((int(level.bases[k]) + node), int(part * universe)))
        return out

    found = _on_shards(spark, level, work, "node bigint, word bigint")
    keys = sorted({r["node"] * universe + r["word"] for r in found} | {0})
    return np.array(keys, dtype=np.uint64)


def build(df: DataFrame, text: str = "text", order: int = 2) -> Trie:
    """The trie of all texts of a table, with n-grams of up to ``order`` (1 to 3) words.

    Null text counts as empty: a start and an end. An empty table gives a trie
    without nodes. Only the text is read.
    """
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    root = scratch_path(spark, "trie")
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = 1 << max(0, (size // (16 * SHARD)).bit_length())  # few words are new: far fewer than one in 16 bytes
    firsts = (np.arange(shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)
    found = _count(texts, lambda hashes, start: hashes[~start], firsts, f"{root}/1")
    trie = Trie([_level(found, firsts, f"{root}/1", 1 << 64)])
    universe = max(1, trie.vocabulary.n)
    _write_probs(spark, trie)
    for k in range(2, order + 1):
        if not trie.levels[-1].paths:
            break
        firsts = _cuts(spark, trie, universe)
        so_far = Trie(list(trie.levels))

        def keys_of(hashes, start, so_far=so_far, universe=universe):
            last = so_far.nodes(hashes, start)
            context = np.full(len(hashes), -1, dtype=np.int64)
            context[1:] = last[-1][:-1]
            relative = last[0]
            if len(last) == 2:
                middle = so_far.levels[1]
                words = np.full(len(hashes), -1, dtype=np.int64)
                words[1:] = last[0][:-1]
                relative = last[1] - so_far._pointers(words, last[1] >= 0, middle)
            ok = (context >= 0) & (last[-1] >= 0) & ~start
            return context[ok].astype(np.uint64) * _U(universe) + relative[ok].astype(np.uint64)

        found = _count(texts, keys_of, firsts, f"{root}/{k}")
        trie.levels.append(_level(found, firsts, f"{root}/{k}", universe))
        universe = max(1, _write_probs(spark, trie))
    return trie


def held_out(key: Column, folds: int = 10) -> Column:
    """Whether a key is in the fold that training never sees; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def score(df: DataFrame, trie: Trie, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``score`` is the trie's log10 probability of the words and the end of the
    text; ``base_score`` that of single words with 0.1 added to each count. Null
    text counts as empty and has the end as its only token. Rows with equal keys
    are scored one by one; an empty table gives an empty result.
    """
    names = ["_key", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        n, v = trie.vocabulary.total, trie.vocabulary.n
        for batch in batches:
            out = [np.zeros(batch.num_rows, dtype=kind) for kind in (np.int64, np.int64, np.int64, np.float64, np.float64)]
            for a, z, hashes, start, at in _blocks(batch.column(1)):
                log10, counts = trie.score(hashes, start)
                base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
                base[start] = 0.0
                known = (counts > 0) & ~start
                out[0][a:z] = np.diff(at) - 1
                out[1][a:z] = sums(known.astype(np.int64), at)
                out[2][a:z] = n
                out[3][a:z], out[4][a:z] = sums(base, at), sums(log10, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"_key {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return rows.withColumnRenamed("_key", key)


def language_model_scores(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """Scores of all rows under a trie built from the rows that are not held out."""
    trie = build(df.where(~held_out(F.col(key))), text, order)
    return score(df, trie, key, text).withColumn("held_out", held_out(F.col(key)))
