"""Keeping fitted models, and training only when none is kept."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from argloom.operators.relations import RelationModel
from argloom.operators.scoring import LinearModel
from argloom.sources.corpus import exists


def save_weights(weights: DataFrame, path: str) -> None:
    """Keep the weight table of a linear model."""
    weights.write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    """A kept weight table."""
    return spark.read.parquet(path)


def load_model(spark: SparkSession, path: str) -> LinearModel | PipelineModel:
    """The model kept at a path: an ML pipeline if its metadata is there, else a weight table."""
    if exists(spark, f"{path}/stages"):
        return PipelineModel.load(path)
    return LinearModel(load_weights(spark, path))


def load_or_train_linear(
    spark: SparkSession, path: str, train: Callable[[], DataFrame], force: bool = False
) -> LinearModel:
    """The linear model kept at ``path``; trained and kept first if there is none.

    A model that is there but cannot be read is an error, and is never overwritten.
    """
    if not force and exists(spark, path):
        return LinearModel(load_weights(spark, path))
    save_weights(train(), path)
    return LinearModel(load_weights(spark, path))


def load_or_train(
    path: str, train: Callable[[], PipelineModel], force: bool = False
) -> PipelineModel:
    """The ML model kept at ``path``; trained and kept first if there is none.

    A model that is there but cannot be read is an error, and is never overwritten.
    """
    if not force and exists(SparkSession.active(), path):
        return PipelineModel.load(path)
    train().write().overwrite().save(path)
    return PipelineModel.load(path)


def save_relations(model: RelationModel, path: str) -> None:
    """Keep a relation model: labels, feature weights and bias as one line, words by class as a table."""
    spark = SparkSession.active()
    fields = {f: getattr(model, f) for f in ("labels", "weights", "bias", "negations", "null_labels")}
    fields["fitted"] = bool(model.words)
    spark.createDataFrame([(json.dumps(fields),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/model")
    if model.words:
        tables = [m.weights.withColumn("class", F.lit(number)) for number, m in enumerate(model.words)]
        table = tables[0]
        for more in tables[1:]:
            table = table.unionByName(more)
        table.write.mode("overwrite").partitionBy("class").parquet(f"{path}/words")


def load_relations(spark: SparkSession, path: str) -> RelationModel:
    """A kept relation model."""
    fields = json.loads(spark.read.text(f"{path}/model").first()["value"])
    words = ()
    if fields.pop("fitted"):
        table = spark.read.schema("token STRING, weight BIGINT, class INT").parquet(f"{path}/words")
        words = tuple(LinearModel(table.where(F.col("class") == number)) for number in range(len(fields["labels"])))
    fields["weights"] = [tuple(row) for row in fields["weights"]]
    return RelationModel(**{name: tuple(value) for name, value in fields.items()}, words=words)
