"""From raw documents to argument graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from argloom.operators.documents import graph_nested, relate_nested, score_nested
from argloom.operators.relations import RelationModel
from argloom.operators.scoring import LinearModel
from argloom.operators.text import nest_sentences


def mine_arguments(
    docs: DataFrame,
    content: str,
    detector: LinearModel,
    components: LinearModel,
    relations: RelationModel = RelationModel(),
    window: int = 5,
) -> DataFrame:
    """All input columns plus ``sentences`` and ``relations``; both empty where nothing is found."""
    nested = nest_sentences(docs, content)
    scored = score_nested(nested, detector, components, keep_words=True)
    return relate_nested(scored, relations, window)


def mine_sentences(
    nested: DataFrame,
    detector: LinearModel,
    components: LinearModel,
    relations: RelationModel = RelationModel(),
    window: int = 5,
) -> DataFrame:
    """The same for documents that are split already, whose ``sentences`` are there, in one pass over their words."""
    return graph_nested(nested, detector, components, relations, window)
