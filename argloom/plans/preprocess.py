"""Bulk cleaning and sentence splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from argloom.operators.text import clean_text, split_sentences
from argloom.plans.files import process_files
from argloom.schemas import CONTENT_COLUMNS
from argloom.sources.corpus import FILE, resolve_content


def preprocess_corpus(
    docs: DataFrame,
    key: str | Sequence[str] = "id",
    candidates: Sequence[str] = CONTENT_COLUMNS,
) -> DataFrame:
    """Sentences of a corpus: content column chosen, text cleaned and split."""
    key = [key] if isinstance(key, str) else list(key)
    content = resolve_content(docs, candidates).select(*key, "content")
    return split_sentences(clean_text(content, "content"), key, "content")


def preprocess_files(
    spark: SparkSession,
    src: str,
    out: str,
    id_col: str = "id",
    by: Sequence[str] = (),
    glob: str = "*.parquet",
) -> DataFrame | None:
    """Sentences of every file under ``src`` not processed before, mirrored below ``out``.

    Returns what became of each of these files; None if there was none.
    """
    return process_files(
        spark, src, out, lambda docs: preprocess_corpus(docs, [id_col, FILE, *by]), by, glob,
        columns=[id_col, *by, *CONTENT_COLUMNS],
    )
