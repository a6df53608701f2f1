"""Exact top-k search by inner product, block at a time.

Components are whole numbers and play the part of terms. Vectors are laid out in
blocks of neighbouring rows of a similarity order; a block keeps the maximum and
minimum of each term and a forward index, the matrix of its vectors. For a query
the blocks are ordered by the sum over terms of the best product that the block
could offer, and scored in that order until the bound falls below the k-th score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from argloom.session import materialize

BLOCK_ROWS = 256
GROUP_ROWS = 1 << 14  # vectors that meet one chunk of queries in one task
CHUNK_QUERIES = 1 << 11
_CODE_BITS = 16


def whole_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v``: rows with an id whose vector has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))
    return df.where(good).select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")
    )


def _similar() -> Column:
    """A short code that near vectors often share: the signs of sums over fixed sets of components."""
    bits = F.lit(0)
    for bit in range(_CODE_BITS):
        signed = F.transform(
            "v", lambda x, i: F.when(F.pmod(F.xxhash64(i, F.lit(bit)), F.lit(2)) == 0, x).otherwise(-x)
        )
        total = F.aggregate(signed, F.lit(0.0), lambda a, x: a + x)
        bits = bits * 2 + (total > 0).cast("int")
    return bits


def _scaled(vectors: list, scale: float) -> np.ndarray:
    """Whole-number rows, shorter vectors padded with zeros; beyond 64 bits as Python integers."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for row, v in enumerate(vectors):
        out[row, : len(v)] = v
    out = np.floor(scale * out)
    if not out.size or np.abs(out).max() < 2.0**62:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out], dtype=object)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b; scores stay within 64 bits."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    largest = int(np.abs(a).max()) * int(np.abs(b).max()) * width
    if largest < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    limit = (1 << 63) - 1
    return np.array([[max(-limit, min(limit, x)) for x in row] for row in exact], dtype=np.int64)


def build_blocks(vectors: DataFrame, scale: float, groups: int) -> DataFrame:
    """``group, ids, v``: blocks of up to ``BLOCK_ROWS`` similar vectors, dealt over the groups."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids, rows = [], []

        def block():
            nonlocal number
            group = (task * 1000003 + number) % groups
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([group], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([rows], pa.list_(pa.list_(pa.float64())))],
                names=["group", "ids", "v"],
            )

        for batch in batches:
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(key)
                rows.append([float(np.floor(scale * x)) for x in v])
                if len(ids) == BLOCK_ROWS:
                    yield block()
                    ids, rows = [], []
        if ids:
            yield block()

    ordered = vectors.withColumn("_code", _similar()).repartitionByRange("_code", "id")
    ordered = ordered.sortWithinPartitions("_code", "id").select("id", "v")
    return ordered.mapInArrow(run, "group bigint, ids array<bigint>, v array<array<double>>")


def search_blocks(queries: np.ndarray, query_ids: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[list, int]:
    """Best k of the blocks for each query as (query id, vector id, score), and vectors scored."""
    width = max([queries.shape[1], *(m.shape[1] for _, m in blocks)], default=0)

    def wide(m):
        return np.pad(m, ((0, 0), (0, width - m.shape[1])))

    queries = wide(queries)
    high = np.stack([wide(m).max(axis=0) for _, m in blocks])
    low = np.stack([wide(m).min(axis=0) for _, m in blocks])
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = _products(positive, high) + _products(negative, low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    kth = np.full(len(queries), np.iinfo(np.int64).min)
    active = np.arange(len(queries))
    scores = [np.zeros(0, np.int64) for _ in queries]
    found = [np.zeros(0, np.int64) for _ in queries]
    scored = 0
    for step in range(len(blocks)):
        nth = order[active, step]
        # Equal bounds may still bring a tie with a smaller id.
        active_now = bounds[active, nth] >= kth[active]
        active, nth = active[active_now], nth[active_now]
        for b in np.unique(nth):
            ids, matrix = blocks[b]
            asking = active[nth == b]
            products = _products(queries[asking], matrix)
            scored += products.size
            for row, q in enumerate(asking):
                other = ids != query_ids[q]
                s = np.concatenate([scores[q], products[row][other]])
                i = np.concatenate([found[q], ids[other]])
                if len(s) > k:
                    cut = np.partition(s, len(s) - k)[len(s) - k]
                    keep = s >= cut
                    s, i = s[keep], i[keep]
                top = np.lexsort((i, -s))[:k]
                scores[q], found[q] = s[top], i[top]
                if len(top) == k:
                    kth[q] = scores[q][-1]
    rows = [(int(query_ids[q]), int(i), int(s)) for q in range(len(queries)) for i, s in zip(found[q], scores[q])]
    return rows, scored


def top_k(
    df: DataFrame,
    asks: Callable[[Column], Column],
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    scale: float = 1024.0,
) -> DataFrame:
    """``query_id, rank, <key>, score``: the k best other rows of every row whose id ``asks``.

    Vectors are scaled and rounded down; the score is the inner product, ties go
    to the smaller id. Rows without id, or whose vector is null or holds a null
    or infinite component, take no part. Shorter vectors count as padded with
    zeros. Rows with the id of the query are its own and no candidates; of
    several rows with one id the one with the smallest vector asks, and all are
    candidates of other queries. Fewer than k candidates give fewer rows, an
    empty table none. Other columns are not read.
    """
    vectors = materialize(whole_vectors(df, key, vector).withColumn("asks", asks(F.col("id"))), "vectors")
    sizes = vectors.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("q")).first()
    groups = max(1, -(-sizes["n"] // GROUP_ROWS))
    chunks = max(1, -(-(sizes["q"] or 0) // CHUNK_QUERIES))
    blocks = materialize(build_blocks(vectors.select("id", "v"), scale, groups), "blocks")

    def copies(df, n, name):
        return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))

    queries = vectors.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    queries = copies(queries.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))), groups, "group")
    blocks = copies(blocks, chunks, "chunk")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}, dtype="int64")
        pairs = [(np.array(i, dtype=np.int64), _scaled(list(v), 1.0)) for i, v in zip(right["ids"], right["v"])]
        rows, _ = search_blocks(_scaled(list(left["v"]), scale), left["id"].to_numpy(), pairs, k)
        return pd.DataFrame(rows, columns=["query_id", "id", "score"]).astype("int64")

    found = (
        queries.groupBy("group", "chunk")
        .cogroup(blocks.groupBy("group", "chunk"))
        .applyInPandas(run, "query_id bigint, id bigint, score bigint")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(key), "score"
    )

