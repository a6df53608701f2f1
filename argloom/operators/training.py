"""Labelling, splitting and fitting sentence classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF
from pyspark.sql import DataFrame, functions as F, Window

from argloom.functions import text as T
from argloom.functions.arrays import items
from argloom.operators.evaluate import best_model, evaluate
from argloom.operators.sampling import balance_classes
from argloom.schemas import NOT_ARGUMENTATIVE
from argloom.session import materialize

MICRO = 1_000_000
_ALL = (1 << 31) - 1  # of a vocabulary: every word that there is


def binary_label(df: DataFrame, col: str = "annotation", out: str = "label") -> DataFrame:
    """0 for sentences marked as no argument, 1 for any other or a missing mark."""
    return df.withColumn(out, (~F.col(col).eqNullSafe(NOT_ARGUMENTATIVE)).cast("int"))


def select_split(df: DataFrame, name: str, col: str = "set") -> DataFrame:
    """Rows of one split."""
    return df.where(F.col(col) == name)


def select_confident(df: DataFrame, at_least: float = 0.85, col: str = "confidence") -> DataFrame:
    """Labelled pairs whose annotators were confident enough."""
    return df.where(F.col(col) >= at_least)


def prune_columns(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Only the columns a model reads."""
    return df.select(*keep)


def stack_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of several tables, matched by column name."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table, allowMissingColumns=True)
    return first


def prepare_splits(
    df: DataFrame, key: str | Sequence[str], balance: bool = False, seed: int = 42
) -> DataFrame:
    """Label the rows and, when asked, balance the classes over all splits together."""
    labelled = binary_label(df)
    return balance_classes(labelled, key, seed=seed) if balance else labelled


def word_counts(df: DataFrame, tokens: str = "tokens", label: str = "label") -> DataFrame:
    """Occurrences of every word, in class 1 and in class 0."""
    return (
        items(df, [F.col(label).alias("label")], tokens, "token")
        .groupBy("token")
        .agg(
            F.count_if(F.col("label") == 1).alias("n_pos"),
            F.count_if(F.col("label") == 0).alias("n_neg"),
        )
    )


def train_log_odds(
    df: DataFrame, tokens: str = "tokens", label: str = "label", smoothing: float = 1.0
) -> DataFrame:
    """Smoothed log-odds of every word between class 1 and class 0.

    ``weight`` holds millionths as a whole number: sums of weights are then the
    same in any order, on any number of machines.
    """
    counts = materialize(word_counts(df, tokens, label), "counts")
    pos = counts.select(F.sum("n_pos")).scalar()
    neg = counts.select(F.sum("n_neg")).scalar()
    words = counts.select(F.count("*")).scalar()

    def share(n: str, total) -> F.Column:
        return F.ln((F.col(n) + smoothing) / (total + smoothing * words))

    return counts.select(
        "token", "n_pos", "n_neg", (share("n_pos", pos) - share("n_neg", neg)).alias("log_odds")
    ).withColumn("weight", F.round(F.col("log_odds") * MICRO).cast("bigint"))


def fit_vocabulary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Words with a gapless index from 0, by falling count, then by word.

    Sorted ranges are numbered on their own and shifted by the sizes of the
    ranges before them, so no task has to see the whole vocabulary.
    """
    counts = items(df, [], tokens, "token").groupBy("token").agg(F.count("*").alias("n"))
    ranged = materialize(
        counts.repartitionByRange(F.desc("n"), F.asc("token")).withColumn(
            "part", F.spark_partition_id()
        ),
        "vocabulary",
    )
    # One row per range: bounded by the number of shuffle partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("part")
        .agg(F.count("*").alias("size"))
        .select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("part").orderBy(F.desc("n"), F.asc("token"))
    return (
        ranged.withColumn("row", F.row_number().over(within))
        .join(F.broadcast(offsets), "part")
        .select("token", "n", (F.col("offset") + F.col("row") - 1).alias("index"))
    )


def train_classifier(
    train: DataFrame,
    val: DataFrame | None = None,
    text: str = "sentence",
    label: str = "label",
    reg_params: Sequence[float] = (0.01,),
    features: str = "count",
    size: int | None = None,
    max_iter: int = 20,
) -> tuple[PipelineModel, DataFrame | None]:
    """Fit a text classifier; with several settings keep the best by validation F1.

    ``features="count"`` has a feature for every word of the training rows;
    ``features="hash"`` merges words into ``size`` buckets, for when that many
    weights are too many. The solver stops after ``max_iter`` steps at the
    latest: ``model.stages[-1].summary.totalIterations`` tells whether it did.
    Returns the model and the table of trials.
    """
    def with_tokens(df: DataFrame) -> DataFrame:
        return df.withColumn("tokens", T.tokens(F.col(text)))

    # Words are counted and weighed once, whatever the number of settings.
    if features == "hash":
        counter = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=size or 1 << 18)
    else:
        counter = CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=_ALL).fit(with_tokens(train))
    counted = materialize(counter.transform(with_tokens(train)).select(label, "tf"), "features")
    idf = IDF(inputCol="tf", outputCol="features").fit(counted)
    weighed = idf.transform(counted)
    models, trials = [], []
    for trial, reg in enumerate(reg_params):
        fitted = LogisticRegression(labelCol=label, regParam=reg, maxIter=max_iter).fit(weighed)
        model = PipelineModel([counter, idf, fitted])
        models.append(model)
        if val is not None:
            predicted = model.transform(with_tokens(val)).withColumn(
                "prediction", F.col("prediction").cast("int")
            )
            trials.append(evaluate(predicted, label=label).withColumn("trial", F.lit(trial)))
    if not trials:
        return models[0], None
    table = materialize(stack_tables(trials), "trials")
    return models[best_model(table, "f1", "max").first()["trial"]], table
