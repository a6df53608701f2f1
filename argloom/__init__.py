"""Argument mining over large text corpora, as Spark jobs."""

from argloom.operators.relations import RelationModel
from argloom.operators.scoring import LinearModel
from argloom.plans.mine import mine_arguments
from argloom.plans.preprocess import preprocess_corpus
from argloom.plans.score import score_corpus
from argloom.plans.train import train_detector
from argloom.session import build_session

__all__ = [
    "LinearModel",
    "RelationModel",
    "build_session",
    "mine_arguments",
    "preprocess_corpus",
    "score_corpus",
    "train_detector",
]
