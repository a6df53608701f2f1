"""Training and testing a sentence detector."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from argloom.operators.evaluate import evaluate_splits, metrics_table
from argloom.operators.scoring import LinearModel, detect_sentences
from argloom.operators.text import tokenize
from argloom.operators.training import (
    prepare_splits,
    select_split,
    train_classifier,
    train_log_odds,
)
from argloom.session import materialize


@dataclass
class Trained:
    """A detector with its validation and test metrics in long form."""

    model: LinearModel | PipelineModel
    metrics: DataFrame


def train_detector(
    labelled: DataFrame,
    key: str | Sequence[str],
    text: str = "sentence",
    balance: bool = False,
    kind: str = "linear",
    seed: int = 42,
    reg_params: Sequence[float] = (0.01,),
) -> Trained:
    """Label, balance if asked, fit on the train split, measure on the other two.

    ``kind="linear"`` fits word log-odds; ``kind="ml"`` fits a logistic
    regression, choosing among ``reg_params`` by validation F1.
    """
    key = [key] if isinstance(key, str) else list(key)
    columns = dict.fromkeys([*key, text, "annotation", "set"])
    kept = materialize(labelled.select(*columns), "labelled")
    rows = prepare_splits(kept, key, balance, seed)
    train = select_split(rows, "train")
    if kind == "linear":
        words = tokenize(train.select(text, "label"), text)
        model = LinearModel(materialize(train_log_odds(words), "weights"))
    else:
        model, _ = train_classifier(
            train, select_split(rows, "val"), text=text, reg_params=reg_params
        )
    held_out = rows.where(F.col("set") != "train")
    predicted = detect_sentences(held_out, model, text).withColumnRenamed("is_arg", "prediction")
    return Trained(model, metrics_table(evaluate_splits(predicted)))
