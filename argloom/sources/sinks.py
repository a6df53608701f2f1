"""Writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from argloom.schemas import METRICS


def write_mirrored(
    df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Parquet in the directory layout of the input, one directory per partition value.

    Rows of one value are brought together first, or every task would write a
    file for every value. Spark splits a value that holds most of the rows over
    many tasks again.
    """
    if by:
        df = df.hint("rebalance", *by)
    df.write.mode(mode).partitionBy(*by).parquet(path)


def _json(df: DataFrame) -> Column:
    """The whole row as JSON; null fields keep their names."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def document_json(df: DataFrame, prefix: str, id_col: str = "id") -> DataFrame:
    """One JSON text per document under ``prefix/id.json``: columns ``key`` and ``body``."""
    return df.select(
        F.format_string("%s/%s.json", F.lit(prefix), F.col(id_col).cast("string")).alias("key"),
        _json(df).alias("body"),
    )


def write_documents(
    df: DataFrame,
    path: str,
    prefix: str,
    id_col: str = "id",
    records_per_file: int = 100_000,
    mode: str = "overwrite",
) -> None:
    """Documents as JSON lines of ``key`` and ``body``.

    Many documents share a file: a directory or an object per document would
    drown the file listing long before the data is large.
    """
    document_json(df, prefix, id_col).write.mode(mode).option(
        "maxRecordsPerFile", records_per_file
    ).option("compression", "gzip").json(path)


def index_lines(df: DataFrame, index: str, id_col: str = "id") -> DataFrame:
    """Bulk-index lines: for every document an action line, then its source line.

    Both lines are one value with a line break between them, so no split of the
    output can part them.
    """
    target = F.struct(F.lit(index).alias("_index"), F.col(id_col).cast("string").alias("_id"))
    action = F.to_json(F.struct(target.alias("index")))
    source = _json(df)
    return df.select(F.concat_ws("\n", action, source).alias("value"))


def index_export(
    df: DataFrame, path: str, index: str, id_col: str = "id", mode: str = "overwrite"
) -> None:
    """Write bulk-index lines as text files."""
    index_lines(df, index, id_col).write.mode(mode).text(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Keep a metrics table as JSON lines."""
    metrics.write.mode(mode).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Read a metrics table back."""
    return spark.read.schema(METRICS).json(path)
