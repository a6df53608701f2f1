"""Applying models to sentences."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from argloom.functions import text as T
from argloom.functions.arrays import once
from argloom.functions.linear import (
    BroadcastTable,
    Scorer,
    WeightTable,
    list_cascade,
    list_margin,
    nested_margins,
    word_hashes,
)
from argloom.functions.probability import argmax, label_of, sigmoid, softmax
from argloom.operators.training import MICRO
from argloom.schemas import COMPONENT_LABELS
from argloom.session import materialize
from argloom.sources.weights import share_weights

# Most bytes of one broadcast lookup table and of one shared file, and the bytes of one entry.
# Every Python worker holds its own copy of a broadcast table; mapped files they share.
MAX_BROADCAST = 16 << 20
MAX_FILE = 64 << 20
_ENTRY = 16


def _shards(size: int, max_broadcast: int) -> int:
    """Parts that a table of ``size`` bytes comes in: one that is broadcast, or several shared files."""
    return 1 if size <= max_broadcast else max(2, -(-size // min(max_broadcast, MAX_FILE)))


def _broadcast(weights: DataFrame, values: Callable[[pa.Table], np.ndarray]) -> BroadcastTable:
    table = weights.toArrow()
    if "hash" in table.column_names:
        hashes = table["hash"].to_numpy().astype(np.int64)
    else:
        hashes = word_hashes(table["token"].combine_chunks())
    order = np.argsort(hashes)
    return BroadcastTable(weights.sparkSession.sparkContext.broadcast((hashes[order], values(table)[order])))


def class_table(weights: DataFrame, columns: Sequence[str], max_broadcast: int = MAX_BROADCAST) -> WeightTable:
    """The weights of several classes in one table that tells all those of a word at once.

    ``weights`` has ``token`` or ``hash`` and the ``columns``. Broadcast or shared by its size, as of a :class:`LinearModel`.
    """
    weights = weights.select("hash" if "hash" in weights.columns else "token", *[F.col(c).cast("bigint").alias(c) for c in columns])
    shards = _shards(weights.count() * _ENTRY // 2 * (1 + len(columns)), max_broadcast)
    if shards > 1:
        return share_weights(weights, shards, columns)
    return _broadcast(weights, lambda table: np.stack([table[c].to_numpy().astype(np.int64) for c in columns], axis=1))


class LinearModel:
    """A two-class model: one whole-number weight per word, in millionths, and a bias.

    ``weights`` has columns ``token`` and ``weight``. Its size is measured first.
    A table of at most ``max_broadcast`` bytes is broadcast. A larger one is
    written once to the shared folder, as files sorted by hash that tasks map into
    memory. Either way scoring is one pass over the sentences.
    """

    def __init__(self, weights: DataFrame, bias: int = 0, max_broadcast: int = MAX_BROADCAST):
        self.weights = weights.select("token", F.col("weight").cast("bigint").alias("weight"))
        self.bias = bias
        self.max_broadcast = max_broadcast

    @cached_property
    def _bytes(self) -> int:
        return self.weights.count() * _ENTRY

    @property
    def n_shards(self) -> int:
        """Parts that the table comes in: one that is broadcast, or several shared files."""
        return _shards(self._bytes, self.max_broadcast)

    @cached_property
    def table(self) -> WeightTable:
        if self.n_shards > 1:
            return share_weights(self.weights, self.n_shards)
        return _broadcast(self.weights, lambda table: table["weight"].to_numpy().astype(np.int64))

    @property
    def scorer(self) -> Scorer:
        """What the functions of :mod:`argloom.functions.linear` take."""
        return self.table, self.bias


def add_margin(df: DataFrame, words: Column, model: LinearModel, out: str) -> DataFrame:
    """Add ``bias + sum of word weights`` for a column of word lists, in millionths."""
    return once(df, list_margin(model.scorer)(words), out)


def add_nested_margins(df: DataFrame, words: Column, model: LinearModel, out: str) -> DataFrame:
    """The same for one list of word lists per row: an array with one margin per list."""
    return once(df, nested_margins(model.scorer)(words), out)


def margin_prob(margin: Column) -> Column:
    """P(class 1) of a margin in millionths."""
    return sigmoid(margin / MICRO)


def score_linear(
    df: DataFrame,
    key: Sequence[str],
    weights: DataFrame,
    tokens: str = "tokens",
    frequent: int = 10_000,
    salts: int = 32,
) -> DataFrame:
    """Sum of word weights per key, as a join: ``key..., score, n_known``.

    Every row is kept: without a known word its score is 0.

    Works for weight tables of any size. The most frequent words, which would
    make hot join keys, are a table of at most ``frequent`` rows and are
    broadcast; a sentence's sum over them is one row before the first shuffle.
    The long tail is joined on (word, salt), both sides sorted: its size is known
    before it is repeated for every salt, so left to itself Spark would broadcast
    a table many times the bound. ``weights`` needs ``token``, ``weight``,
    ``n_pos`` and ``n_neg``.
    """
    seen = F.col("n_pos") + F.col("n_neg")
    head = weights.orderBy(F.desc(seen), "token").limit(frequent)
    head = materialize(head.select("token", F.col("weight").alias("head")), "head")
    tail = (
        weights.join(F.broadcast(head.select("token")), "token", "left_anti")
        .select("token", "weight", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        .withColumn("salt", F.col("salt").cast("bigint"))
    )
    rare = F.col("head").isNull()
    spot = F.xxhash64(*key)
    words = df.select(*key, F.explode_outer(tokens).alias("token"))
    words = words.join(F.broadcast(head), "token", "left")
    counted = (
        words.select(
            *key,
            "head",
            F.when(rare, F.col("token")).alias("token"),
            F.when(rare, F.pmod(spot, F.lit(salts))).otherwise(spot).alias("salt"),
        )
        .groupBy(*key, "token", "salt")
        .agg(F.sum("head").alias("head"), F.count("*").alias("n"))
    )
    weight = F.coalesce(F.col("head"), F.col("weight") * F.col("n"))
    return (
        counted.join(tail.hint("merge"), ["token", "salt"], "left")
        .select(*key, weight.alias("weight"), F.when(weight.isNotNull(), F.col("n")).alias("n"))
        .groupBy(*key)
        .agg(
            F.coalesce(F.sum("weight"), F.lit(0)).alias("score"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_known"),
        )
    )


def detect_sentences(
    df: DataFrame, model: LinearModel | PipelineModel, text: str = "text"
) -> DataFrame:
    """Add ``is_arg`` (0/1) and ``arg_prob``, the probability of class 1, to every sentence."""
    if isinstance(model, LinearModel):
        scored = add_margin(df, T.tokens(F.col(text)), model, "_margin")
        return (
            scored.withColumn("is_arg", (F.col("_margin") > 0).cast("int"))
            .withColumn("arg_prob", margin_prob(F.col("_margin")))
            .drop("_margin")
        )
    scored = model.transform(df.withColumn("tokens", T.tokens(F.col(text))))
    return scored.select(
        *df.columns,
        F.col("prediction").cast("int").alias("is_arg"),
        vector_to_array("probability")[1].alias("arg_prob"),
    )


def filter_argumentative(df: DataFrame) -> DataFrame:
    """Sentences predicted argumentative, with their positions."""
    return df.where(F.col("is_arg") == 1)


def classify_components(
    df: DataFrame,
    model: LinearModel,
    text: str = "text",
    labels: Sequence[str] = COMPONENT_LABELS,
) -> DataFrame:
    """Add ``component`` and ``component_prob``, null for non-argumentative sentences.

    Words of other sentences are never looked at: their list is left empty.
    """
    argumentative = F.col("is_arg") == 1
    words = F.when(argumentative, T.tokens(F.col(text))).otherwise(F.array().cast("array<string>"))
    scored = add_margin(df, words, model, "_margin")
    return (
        scored.withColumn(
            "component",
            F.when(argumentative, label_of((F.col("_margin") > 0).cast("int"), labels)),
        )
        .withColumn("component_prob", F.when(argumentative, margin_prob(F.col("_margin"))))
        .drop("_margin")
    )


def classify_sentences(
    df: DataFrame,
    detector: LinearModel,
    components: LinearModel,
    text: str = "text",
    labels: Sequence[str] = COMPONENT_LABELS,
) -> DataFrame:
    """Add ``is_arg, arg_prob, component, component_prob`` in one pass over the words.

    The same columns as :func:`detect_sentences` and :func:`classify_components`
    one after the other. Words of sentences that are not argumentative are not
    looked up in the second model.
    """
    scored = once(df, list_cascade(detector.scorer, components.scorer)(T.tokens(F.col(text))), "_margins")
    first, second = F.col("_margins.first"), F.col("_margins.second")
    return scored.select(
        *df.columns,
        (first > 0).cast("int").alias("is_arg"),
        margin_prob(first).alias("arg_prob"),
        F.when(first > 0, label_of((second > 0).cast("int"), labels)).alias("component"),
        F.when(first > 0, margin_prob(second)).alias("component_prob"),
    )


def attach_predictions(
    sentences: DataFrame, predictions: DataFrame, key: Sequence[str]
) -> DataFrame:
    """Put separately computed predictions back on their sentences by position."""
    return sentences.join(predictions, list(key), "left")


def score_batches(
    df: DataFrame,
    cols: Sequence[str],
    make_predict_fn: Callable[[], Callable[..., np.ndarray]],
    labels: Sequence[str],
    batch_size: int = 128,
) -> DataFrame:
    """Apply any model in batches: adds ``pred_id``, ``pred`` and ``probs``.

    ``make_predict_fn`` runs once per Python worker and returns a function from
    batches of the input columns to an array of logits, one row per input row
    and one column per label.
    """
    logits = predict_batch_udf(
        make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size
    )
    return (
        df.withColumn("_logits", logits(*[F.col(c) for c in cols]))
        .withColumn("probs", softmax(F.col("_logits"), len(labels)))
        .withColumn("pred_id", argmax(F.col("_logits")))
        .withColumn("pred", label_of(F.col("pred_id"), labels))
        .drop("_logits")
    )
