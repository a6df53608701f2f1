"""Reading a corpus of parquet files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from argloom.schemas import CONTENT_COLUMNS

FILE = "source_file"


def scan_corpus(
    spark: SparkSession,
    path: str | Sequence[str],
    glob: str | None = "*.parquet",
    where: str | Column | None = None,
    flat: bool = False,
    merge_schema: bool = False,
    skip_corrupt: bool = False,
    with_file: bool = False,
) -> DataFrame:
    """Every parquet file under a tree.

    Directory names such as ``language=eng`` become columns, and a ``where`` on
    them prunes whole directories. ``flat=True`` reads trees whose directory
    names mean nothing, at any depth. ``with_file`` adds the file of each row.
    """
    reader = (
        spark.read.option("mergeSchema", merge_schema)
        .option("recursiveFileLookup", flat)
        .option("ignoreCorruptFiles", skip_corrupt)
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    if with_file:
        df = df.withColumn(FILE, F.col("_metadata.file_path"))
    return df if where is None else df.where(where)


def resolve_content(
    df: DataFrame, candidates: Sequence[str] = CONTENT_COLUMNS, out: str = "content"
) -> DataFrame:
    """Add the text column under one name: the first candidate that has a value.

    Files of a tree may differ in which of the candidates they hold; with merged
    schemas the missing ones read as null, and the row falls to the next one.
    """
    present = [c for c in candidates if c in df.columns]
    if not present:
        raise AnalysisException(f"none of the content columns {list(candidates)} exists")
    return df.withColumn(out, F.coalesce(*[F.col(c).cast("string") for c in present]))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path. Any other trouble with it is an error."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def pending_inputs(src: DataFrame, done: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Inputs that have no output yet.

    ``done`` is grouped first, so an input with very many output rows reaches
    the join as one row.
    """
    key = [key] if isinstance(key, str) else list(key)
    return src.join(done.select(*key).distinct(), key, "left_anti")


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Every file under a tree, one row each, from the listing alone: no file is opened.

    ``source_file`` is spelled as in the rows of a scan, ``path`` as a reader
    takes it. The driver holds this list for any scan of the tree.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    uris = reader.load(path).inputFiles()
    rows = [(re.sub("^file:/+", "file:/", uri), unquote(uri)) for uri in uris]
    return spark.createDataFrame(rows, f"{FILE} STRING, path STRING")


def relative_path(df: DataFrame, root: str, col: str = FILE, out: str = "relative_path") -> DataFrame:
    """The file path below the input root, without scheme or root."""
    bare = F.regexp_replace(F.col(col), r"^[a-z0-9]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return df.withColumn(
        out, F.when(bare.startswith(base), F.substring(bare, F.lit(len(base) + 1), F.length(bare)))
    )


def run_report(df: DataFrame, by: str | Sequence[str] = FILE) -> DataFrame:
    """Rows per input, for the log of a run."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.count("*").alias("rows"))
