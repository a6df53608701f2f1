"""Running a job over the files that it has not done yet."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from argloom.sources.manifest import footers, pending, process_whole, reading, report_table, write_manifest
from argloom.sources.sinks import write_mirrored


def process_files(
    spark: SparkSession,
    src: str,
    out: str,
    job: Callable[[DataFrame], DataFrame],
    by: Sequence[str] = (),
    glob: str = "*.parquet",
    columns: Sequence[str] | None = None,
) -> DataFrame | None:
    """Run ``job`` over the whole files under ``src`` that are not done, and keep the manifest.

    Every file is read once, while the job runs. What it makes of them goes to
    the scratch folder; rows of damaged files never reach ``out``. ``columns``
    names those that the job needs, if not all.

    Returns the report on the files looked at: done or failed, with their rows
    expected and read. None if all were done before.
    """
    files = pending(spark, src, out, glob)
    if not files:
        return None
    read = reading(src, None if columns is None else list(columns))
    rows, files = process_whole(spark, footers(spark, src, files), read, job)
    report = report_table(spark, files)
    if rows is not None:
        started = [f._replace(status="started") if f.status == "done" else f for f in files]
        write_manifest(report_table(spark, started), out)
        write_mirrored(rows, out, by, mode="append")
    write_manifest(report, out)
    return report
