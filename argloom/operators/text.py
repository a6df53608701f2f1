"""Cleaning and sentence splitting over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType

from argloom.functions import text as T
from argloom.functions.arrays import items


def _names(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def cast_text(df: DataFrame, col: str) -> DataFrame:
    """The column as a string, empty where it was null."""
    return df.withColumn(col, F.coalesce(F.col(col).cast("string"), F.lit("")))


def clean_text(df: DataFrame, col: str) -> DataFrame:
    """Strip tags and collapse whitespace."""
    return df.withColumn(col, T.cleaned_text(F.col(col)))


def clean_html(df: DataFrame, col: str) -> DataFrame:
    """Readable text of whole pages."""
    return df.withColumn(col, T.cleaned_html(F.col(col)))


def drop_empty(df: DataFrame, col: str) -> DataFrame:
    """Drop rows whose cleaned text is null or empty."""
    return df.where(F.col(col) != "")


def split_sentences(df: DataFrame, key: str | Sequence[str], col: str, tight: bool = False) -> DataFrame:
    """One row per sentence of already cleaned text, with its position and span.

    ``tight`` also takes breaks at which no blank stands. Row-local: no shuffle,
    and no row depends on how often its key occurs.
    """
    return df.select(
        *_names(key), F.posexplode(T.sentence_spans(F.col(col), tight)).alias("sent_idx", "sentence")
    ).select(*_names(key), "sent_idx", "sentence.*")


def nest_sentences(df: DataFrame, col: str, out: str = "sentences") -> DataFrame:
    """Add the array of sentences of raw text to each document row."""
    return df.withColumn(out, T.sentence_spans(T.cleaned_text(F.col(col))))


def flatten_sentences(
    df: DataFrame, key: str | Sequence[str], col: str = "sentences"
) -> DataFrame:
    """Rows of ``(key, sent_idx, sentence fields)`` from nested documents."""
    rows = items(df, _names(key), col, "sentence", "sent_idx")
    return rows.select(*_names(key), "sent_idx", "sentence.*")


def span_text(
    df: DataFrame, col: str, start: str = "start_index", end: str = "end_index", out: str = "span"
) -> DataFrame:
    """The slice of a cleaned text that a span names."""
    return df.withColumn(
        out,
        F.substring(
            F.col(col),
            (F.col(start) + 1).cast("int"),
            (F.col(end) - F.col(start)).cast("int"),
        ),
    )


def tokenize(df: DataFrame, col: str, max_length: int | None = None) -> DataFrame:
    """Add ``tokens`` and ``n_tokens``; longer lists are cut to ``max_length`` if given."""
    return df.withColumn("tokens", T.tokens(F.col(col), max_length)).withColumn(
        "n_tokens", F.size("tokens")
    )


def tokenize_pair(df: DataFrame, left: str, right: str, max_length: int) -> DataFrame:
    """Add the word lists of two texts, shortened together to ``max_length``.

    A column may hold the list of all words of its text instead: then each
    sentence is cut into words once, not once for every pair it is in.
    """
    sides = [F.col(c) if isinstance(df.schema[c].dataType, ArrayType) else T.tokens(F.col(c)) for c in (left, right)]
    a, b = T.pair_tokens(*sides, max_length)
    return (
        df.withColumn("source_tokens", a)
        .withColumn("target_tokens", b)
        .withColumn("n_source", F.size("source_tokens"))
        .withColumn("n_target", F.size("target_tokens"))
    )
