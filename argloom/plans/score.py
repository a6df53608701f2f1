"""Bulk sentence scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from argloom.operators.scoring import LinearModel, detect_sentences
from argloom.plans.files import process_files


def score_corpus(
    sentences: DataFrame, model: LinearModel | PipelineModel, text: str = "text"
) -> DataFrame:
    """Every sentence with ``is_arg`` and ``arg_prob``. No shuffle."""
    return detect_sentences(sentences, model, text)


def score_files(
    spark: SparkSession,
    src: str,
    out: str,
    model: LinearModel | PipelineModel,
    by: Sequence[str] = (),
) -> DataFrame | None:
    """Score the sentence files under ``src`` that were not scored before; returns the report on them."""
    return process_files(spark, src, out, lambda rows: score_corpus(rows, model), by)
