"""What became of every input file: how many rows it has, how many could be read.

Jobs keep the manifest beside their output, in a folder that readers of the
output do not look into. Only files that were read whole are processed; the
others are listed as failed and tried again on the next run. A file without
rows, or whose rows yield nothing, is done like any other.

Rows are counted while the job reads them, in a fixed number of buckets of
files, and compared with what the footers promise. No file yields more rows than
its footer says, so a bucket with the right sum has only whole files. Only the
files of other buckets are read again, to tell which of them is damaged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple
from zlib import crc32

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from argloom.session import scratch_path
from argloom.sources.corpus import FILE, exists, list_files, scan_corpus

MANIFEST = "_manifest"
BUCKETS = 256
COLUMNS = f"{FILE} STRING, path STRING, expected BIGINT, read BIGINT, status STRING"



class File(NamedTuple):
    """A file by its name in rows and its path for readers, the rows that its footer promises, and what became of it.

    The driver holds a list of these, as it holds the listing of any scan.
    """

    source_file: str
    path: str
    expected: int | None = None
    read: int = 0
    status: str = "failed"

    def settled(self, read: int) -> File:
        return self._replace(read=read, status="done" if self.expected == read else "failed")


Read = Callable[[SparkSession, list[str]], DataFrame]
Job = Callable[[DataFrame], DataFrame]


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    """The last word on every file; without a manifest, no rows."""
    path = f"{out}/{MANIFEST}"
    if not exists(spark, path):
        return spark.createDataFrame([], COLUMNS)
    rows = spark.read.schema(f"{COLUMNS}, run BIGINT").parquet(path)
    last = rows.groupBy(FILE).agg(F.max_by(F.struct("path", "expected", "read", "status"), "run").alias("last"))
    return last.select(FILE, "last.*")


def write_manifest(report: DataFrame, out: str) -> None:
    """Add rows to the manifest; for each file the ones written last count."""
    report.withColumn("run", F.unix_micros(F.current_timestamp())).write.mode("append").parquet(f"{out}/{MANIFEST}")


def report_table(spark: SparkSession, files: Iterable[File]) -> DataFrame:
    """``source_file, path, expected, read, status`` of files."""
    columns = list(zip(*files)) or [[]] * 5
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=list(File._fields)))


def _footer(path: str, content: bytes | None = None) -> int | None:
    try:
        if content is not None:
            return pq.read_metadata(pa.BufferReader(content)).num_rows
        system, place = FileSystem.from_uri(path)
        with system.open_input_file(place) as file:  # reads the end of the file, not all of it
            return pq.read_metadata(file).num_rows
    except (pa.ArrowException, OSError):
        return None


def _by_footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*[column.to_pylist() for column in batch.columns[1:]])
        counts = pa.array([_footer(*row) for row in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=[FILE, "rows"])


def _footer_counts(spark: SparkSession, files: list[File]) -> dict[str, int | None]:
    """Rows of single files by their footers, looked at in tasks; None for what is no parquet."""
    try:
        FileSystem.from_uri(files[0].path)
    except (pa.ArrowException, OSError):  # a store that only Spark can open
        content = spark.read.format("binaryFile").load([f.path for f in files])
        looked = content.select(F.col("_metadata.file_path").alias(FILE), "path", "content")
    else:
        looked = report_table(spark, files).select(FILE, "path")
        looked = looked.repartition(min(len(files), spark.sparkContext.defaultParallelism))
    return dict(map(tuple, looked.mapInArrow(_by_footers, f"{FILE} STRING, rows BIGINT").collect()))


def _reader(spark: SparkSession, src: str, merge_schema: bool):
    reader = spark.read.option("basePath", src).option("mergeSchema", merge_schema)
    return reader.option("ignoreCorruptFiles", True)


def _with_file(df: DataFrame) -> DataFrame:
    return df.withColumn(FILE, F.col("_metadata.file_path"))


def _per_file(rows: DataFrame, *more: Column) -> dict[str, int]:
    counts = rows.groupBy(FILE).agg(F.count("*").alias("n"), *more)
    return {r[FILE]: r["n"] for r in counts.collect()}


def footers(spark: SparkSession, src: str, files: list[File], merge_schema: bool = True) -> list[File]:
    """The files with the rows that their footers promise, from the footers alone.

    Files that show no rows at all, so either empty or no parquet, have their
    footer looked at one by one; ``expected`` is None for what has none.
    """
    try:
        table = _reader(spark, src, merge_schema).parquet(*[f.path for f in files])
        found: dict[str, int | None] = dict(_per_file(_with_file(table).select(FILE)))
    except Exception as error:  # not one footer among them can be read
        if "UNABLE_TO_INFER_SCHEMA" not in str(error) and "CANNOT_READ_FILE_FOOTER" not in str(error):
            raise
        found = {}
    silent = [f for f in files if f.source_file not in found]
    if silent:
        found |= _footer_counts(spark, silent)
    return [f._replace(expected=found.get(f.source_file)) for f in files]


def rows_read(rows: DataFrame) -> dict[str, int]:
    """How many rows of each file can be read, all columns of them."""
    # The hash is used, or the optimizer would count rows without reading their columns.
    columns = [c for c in rows.columns if c != FILE]
    return _per_file(rows, F.max(F.xxhash64(*columns)).alias("proof"))


def as_files(files: DataFrame) -> list[File]:
    """Rows of ``source_file, path`` as a list."""
    return [File(r[FILE], r["path"]) for r in files.select(FILE, "path").collect()]


def inspect(spark: SparkSession, src: str, files: DataFrame, merge_schema: bool = True) -> DataFrame:
    """``source_file, path, expected, read, status`` of parquet files, by reading all their columns."""
    known = footers(spark, src, as_files(files), merge_schema)
    seen, paths = {}, [f.path for f in known if f.expected]
    if paths:
        seen = rows_read(_with_file(_reader(spark, src, merge_schema).parquet(*paths)))
    return report_table(spark, [f.settled(seen.get(f.source_file, 0)) for f in known])


def _twin(spark: SparkSession) -> SparkSession:
    """A session with the same settings. Once a session has observed a table it cannot be shipped,
    nor can fitted models that hold it; so tables are observed in a twin, which no model holds."""
    return type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())


def bucket(file: str) -> int:
    """The bucket that a file's rows are counted in."""
    return crc32(file.encode()) % BUCKETS


class Counted:
    """Counts the rows of a table by buckets of files, while a job reads them."""

    def __init__(self, *more: Column):
        self._seen, self._more = Observation(), more

    def rows(self, df: DataFrame) -> DataFrame:
        """The same rows; they must be written by a job without a shuffle, where no row counts twice."""
        number = (F.crc32(F.col(FILE).cast("binary")) % BUCKETS).cast("double")
        # With as many bins as there are values, this histogram is an exact table of counts.
        return df.observe(self._seen, F.histogram_numeric(number, F.lit(BUCKETS)).alias("rows"), *self._more)

    @property
    def found(self) -> dict:
        """What was seen, once the job is over."""
        return self._seen.get

    def buckets(self) -> Counter[int]:
        return Counter({int(bin["x"]): int(bin["y"]) for bin in self.found["rows"] or []})


def settle(files: list[File], counts: Counter[int], staged: DataFrame, read: Read, job: Job) -> tuple[DataFrame | None, list[File]]:
    """The rows of whole files and what became of all, from what a job counted.

    ``files`` is the result of :func:`footers`, ``staged`` what the job wrote. Where
    a bucket falls short, its files are read once more and counted one by one, and
    the job is done again over the whole ones.
    """
    due: Counter[int] = Counter()
    for f in files:
        due[bucket(f.source_file)] += f.expected or 0
    off = {b for b, rows in due.items() if rows != counts[b]}
    suspects = [f for f in files if f.expected and bucket(f.source_file) in off]
    seen = rows_read(read(staged.sparkSession, [f.path for f in suspects])) if suspects else {}
    known = {f.source_file: seen.get(f.source_file, 0) for f in suspects}
    report = [f.settled(known.get(f.source_file, f.expected or 0)) for f in files]
    if not any(f.expected and f.status == "failed" for f in report):
        return staged, report
    whole = [f for f in report if f.status == "done"]
    rows, again = process_whole(staged.sparkSession, whole, read, job)
    return rows, [f for f in report if f.status == "failed"] + again


def process_whole(spark: SparkSession, files: list[File], read: Read, job: Job) -> tuple[DataFrame | None, list[File]]:
    """What ``job`` makes of the rows of whole files, written down, and what became of all files.

    ``files`` is the result of :func:`footers`, ``read`` gives the rows of files by
    a session and their paths, with :data:`FILE`. No rows at all is None.
    """
    paths = [f.path for f in files if f.expected]
    if not paths:
        return None, [f.settled(0) for f in files]
    counted = Counted()
    found = job(counted.rows(read(_twin(spark), paths)))
    path = scratch_path(spark, "processed")
    found.write.parquet(path)
    staged = spark.read.schema(found.schema).parquet(path)
    return settle(files, counted.buckets(), staged, read, job)


def pending(spark: SparkSession, src: str, out: str, glob: str = "*.parquet", merge_schema: bool = True) -> list[File]:
    """The files under ``src`` that are not done.

    A run that broke off after writing its rows and before its manifest is
    recognized by the rows: a job's output appears as one or not at all.
    """
    listed = list_files(spark, src, glob)
    manifest = read_manifest(spark, out)
    done = manifest.where("status = 'done'").select(FILE)
    started = manifest.where("status = 'started'").select(FILE)
    if not started.isEmpty() and exists(spark, out):
        written = scan_corpus(spark, out, merge_schema=True)
        if FILE in written.columns:
            done = done.unionByName(written.select(FILE).join(started, FILE, "left_semi").distinct())
    return as_files(listed.join(done, FILE, "left_anti"))


def reading(src: str, columns: list[str] | None = None, merge_schema: bool = True) -> Read:
    """Reads files by their paths, of ``columns`` those that they have, leaving out what is damaged."""

    def read(spark: SparkSession, paths: list[str]) -> DataFrame:
        df = _reader(spark, src, merge_schema).parquet(*paths)
        return _with_file(df).select(*[c for c in df.columns if c != FILE and (columns is None or c in columns)], FILE)

    return read
