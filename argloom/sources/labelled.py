"""Reading labelled sentences from tab-separated files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, functions as F

from argloom.operators.training import stack_tables
from argloom.sources.corpus import list_files

HEAD = 1 << 12


def _first_line(path: str, step: int = HEAD) -> bytes:
    """The first line of a file. No more is read than the line and one step."""
    system, place = FileSystem.from_uri(path)
    head = b""
    with system.open_input_file(place) as file:
        while b"\n" not in head and (more := file.read(step)):
            head += more
    return head.split(b"\n", 1)[0]


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [_first_line(path).decode("utf-8", "replace") for path in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], names=["path", "header"])


def read_headers(spark: SparkSession, path: str, glob: str) -> dict[str, list[str]]:
    """The files under a path by their first lines; empty files are left out.

    Only the heads of files are read, in tasks. The driver holds the listing, as
    it does for any scan. Where tasks cannot open the store by themselves, Spark
    reads the first split of every file instead.
    """
    files = list_files(spark, path, glob).select("path")
    first = files.first()
    if first is None:
        return {}
    try:
        FileSystem.from_uri(first["path"])
    except (pa.ArrowException, OSError):
        lines = spark.read.text([r["path"] for r in files.collect()]).select(
            "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        )
        heads = lines.where("start = 0").groupBy("path").agg(F.min_by("value", "line").alias("header"))
    else:
        heads = files.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_headers, "path string, header string")
    groups: dict[str, list[str]] = {}
    for row in sorted(heads.where("header <> ''").collect()):
        groups.setdefault(row["header"], []).append(row["path"])
    return dict(sorted(groups.items()))


def scan_labelled(spark: SparkSession, path: str, glob: str = "*.tsv") -> DataFrame:
    """All rows of all files, stacked by column name; quotes are ordinary characters.

    CSV columns are matched by position, so files are read in groups that share
    a header. Without any file the table is empty, with the columns that training
    needs.
    """
    tables = []
    for header, files in read_headers(spark, path, glob).items():
        names = [name.strip("\ufeff\r") for name in header.split("\t")]
        schema = ", ".join(f"`{name}` STRING" for name in names)
        tables.append(
            spark.read.option("sep", "\t")
            .option("quote", "")
            .option("header", True)
            .option("enforceSchema", False)
            .schema(schema)
            .csv(files)
        )
    if not tables:
        return spark.createDataFrame([], "sentence STRING, annotation STRING, set STRING")
    return stack_tables(tables)
