"""Weight tables as sorted arrays in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, functions as F

from argloom.functions.linear import SharedTable, TableFile, word_hashes
from argloom.session import scratch_path


def _range_files(root: str):
    """Writes each task's sorted rows as two arrays, bit by bit, and tells where they are.

    A repeated task writes files of its own; only those of the one that was heard are used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = FileSystem.from_uri(root)
        name, ends = uuid.uuid4().hex, []
        system.create_dir(place, recursive=True)
        with (
            system.open_output_stream(f"{place}/{name}.hashes") as hashes,
            system.open_output_stream(f"{place}/{name}.weights") as weights,
        ):
            for batch in batches:
                if batch.num_rows:
                    own = batch.column(0).to_numpy()
                    ends += [int(own[0]), int(own[-1])]
                    hashes.write(np.ascontiguousarray(own, dtype=np.int64).tobytes())
                    weights.write(np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1).astype(np.int64).tobytes())
        if ends:
            row = {"first": [ends[0]], "last": [ends[-1]], "name": [name]}
            yield pa.RecordBatch.from_pydict(row)

    return run


def share_weights(weights: DataFrame, files: int, columns: Sequence[str] | None = None) -> SharedTable:
    """The table ``token, weight`` in about ``files`` files that tasks look words up in.

    With ``columns``, these are the weights of a word, found together; words may be given by their
    ``hash`` instead. The driver sees one row per file.
    """
    names = columns or ["weight"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = word_hashes(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(own), *batch.columns[1:]], names=["hash", *names])

    root = scratch_path(weights.sparkSession, "weights")
    values = [F.col(c).cast("bigint").alias(c) for c in names]
    if "hash" in weights.columns:
        rows = weights.select("hash", *values)
    else:
        rows = weights.select("token", *values).mapInArrow(hashed, ", ".join(f"{c} bigint" for c in ["hash", *names]))
    sorted_rows = rows.repartitionByRange(files, "hash").sortWithinPartitions("hash")
    found = sorted_rows.mapInArrow(_range_files(root), "first bigint, last bigint, name string").collect()
    return SharedTable(
        tuple(TableFile(r["first"], r["last"], f"{root}/{r['name']}.hashes", f"{root}/{r['name']}.weights") for r in found),
        columns and len(columns),
    )
