"""Processing only newly arrived files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from argloom.plans.preprocess import preprocess_corpus
from argloom.session import materialize
from argloom.sources.corpus import FILE, list_files
from argloom.sources.manifest import (
    Counted, Read, as_files, footers, process_whole, read_manifest, report_table, settle, write_manifest,
)


def incremental(
    spark: SparkSession,
    src: str,
    dst: str,
    checkpoint: str,
    fn: Callable[[DataFrame], DataFrame],
    schema: str,
    max_files: int = 10_000,
) -> None:
    """Run ``fn`` over the files that arrived in ``src`` since the last call.

    ``fn`` works row by row, without a shuffle; its rows come with the file that
    each is from. The checkpoint remembers files by name, so the stream reads each
    once. A batch that is replayed after a failure overwrites the folder of its
    own batch number, so its rows are not written twice.

    Rows are counted while a batch is read. A damaged file yields no rows: the
    manifest in ``dst`` lists it as failed, and every later call tries it again
    beside the stream, in a folder that belongs to this file alone. So a file that
    was mended is processed once, also if a call breaks off in between.
    """

    def read(session: SparkSession, paths: list[str]) -> DataFrame:
        rows = session.read.schema(schema).option("ignoreCorruptFiles", True).parquet(*paths)
        return rows.withColumn(FILE, F.col("_metadata.file_path"))

    def write(batch: DataFrame, batch_id: int) -> None:
        counted = Counted(F.collect_set(FILE).alias("files"))
        staged = materialize(fn(counted.rows(batch)), "batch")  # a stream's batches have a session of their own
        names = set(counted.found["files"] or [])  # files of which nothing could be read are seen to below
        if not names:
            return
        mine = [f for f in as_files(list_files(spark, src, "*.parquet")) if f.source_file in names]
        rows, files = settle(footers(spark, src, mine), counted.buckets(), staged, read, fn)
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{dst}/batch={batch_id}")
        write_manifest(report_table(spark, files), dst)

    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", "*.parquet")
        .option("ignoreCorruptFiles", True)
        .parquet(src)
    )
    query = (
        stream.withColumn(FILE, F.col("_metadata.file_path"))
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    _catch_up(spark, src, dst, read, fn)


def _catch_up(spark: SparkSession, src: str, dst: str, read: Read, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Process the files that the stream has passed and that are not done: failed ones, and those without rows."""
    done = read_manifest(spark, dst).where("status = 'done'").select(FILE)
    files = as_files(list_files(spark, src, "*.parquet").join(done, FILE, "left_anti"))
    if not files:
        return

    def own_folder(rows: DataFrame) -> DataFrame:
        # A folder per file, numbered below zero to stay apart from the batches of the stream.
        number = F.bitwise_not(F.xxhash64(FILE).bitwiseAND(F.lit((1 << 62) - 1)))
        return fn(rows).withColumn("batch", number)

    rows, files = process_whole(spark, footers(spark, src, files), read, own_folder)
    if rows is not None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("batch").parquet(dst)
    write_manifest(report_table(spark, files), dst)


def incremental_sentences(
    spark: SparkSession,
    src: str,
    dst: str,
    checkpoint: str,
    schema: str,
    key: str,
    content: str,
) -> None:
    """Clean and split only the documents of newly arrived files, once each."""
    incremental(
        spark,
        src,
        dst,
        checkpoint,
        lambda batch: preprocess_corpus(batch, [key, FILE], [content]),
        schema,
    )
