"""Fill-in-the-middle: texts cut at two unit boundaries and put in another order.

A unit is a run of ASCII letters or one other code point. A text is seen as
fixed blocks of code points. A Fenwick tree holds, for every block, how many
units begin in it and how many code points it has; walking down that tree by
powers of two finds the block of a cut, and only that block is looked at again
to find the place inside it. So whatever the length of a text, no more than one
block of it is unpacked at a time, and a cut costs the logarithm of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 4096
# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


class FenwickTree:
    """Running sums of two counts per block, found by binary lifting."""

    def __init__(self, units: np.ndarray, chars: np.ndarray):
        self.size = len(units)
        self.top = 1 << (self.size.bit_length() - 1) if self.size else 0
        units, chars = np.concatenate([[0], units]), np.concatenate([[0], chars])
        # Node i sums the blocks from i minus its lowest bit on: level by level, all nodes at once.
        step = 1
        while step <= self.size:
            upper = np.arange(2 * step, self.size + 1, 2 * step)
            units[upper] += units[upper - step]
            chars[upper] += chars[upper - step]
            step *= 2
        self.units, self.chars = units.tolist(), chars.tolist()

    def find(self, unit: int) -> tuple[int, int, int]:
        """The block in which unit number ``unit`` (from 0) begins, its number there, code points before the block.

        A number that is not there gives the number of blocks as block.
        """
        block, chars, step = 0, 0, self.top
        while step:
            if block + step <= self.size and self.units[block + step] <= unit:
                block += step
                unit -= self.units[block]
                chars += self.chars[block]
            step >>= 1
        return block, unit, chars


class CutText:
    """A text with the means to find where any of its units begins."""

    def __init__(self, text: str, block: int = BLOCK):
        self.text, self.block = text, block
        sizes = [min(block, len(text) - at) for at in range(0, len(text), block)]
        counts = [int(np.count_nonzero(self._begins(i))) for i in range(len(sizes))]
        self.n = sum(counts)
        self.tree = FenwickTree(np.array(counts, np.int64), np.array(sizes, np.int64))

    def _begins(self, number: int) -> np.ndarray:
        """Whether a unit begins at each code point of a block."""
        at = number * self.block
        before = self.text[at - 1] if at else " "
        points = np.frombuffer((before + self.text[at : at + self.block]).encode("utf-32-le"), "<u4")
        letter = ((points | 32) - 97) < 26
        return ~(letter[1:] & letter[:-1])

    def place(self, unit: int) -> int:
        """Code points before unit number ``unit``; the length of the text from the last one on."""
        block, left, chars = self.tree.find(unit)
        if block == self.tree.size:
            return chars
        return chars + int(np.flatnonzero(self._begins(block))[left])


def arrange(text: str, seed: int, key: str, plain_from: int, spm_below: int) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    draw = sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(draw[i : i + 8], 16) for i in range(0, 32, 8)]
    cut = CutText(text)
    if not text or h[2] % 100 >= plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return cut.n, PLAIN, None, None, text
    low, high = sorted(cut.place(x % (cut.n + 1)) for x in h[:2])
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h[3] % 100 < spm_below:
        return cut.n, SPM, low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return cut.n, PSM, low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 1,
    plain_from: int = 90,
    spm_below: int = 20,
) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` of every text.

    ``n`` counts units. Cuts and form are drawn from a hash of ``seed`` and the
    key, so a repeated task draws the same. Out of 100 texts those from
    ``plain_from`` on stay plain, and of the others ``spm_below`` have the suffix
    first. Empty texts and texts that hold a mark are plain; lengths are null
    there.

    Null text is treated as empty, a null key as an empty one. Repeated keys
    give one row each; an empty table gives an empty one; other columns are not
    read.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    names = [key, "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, found = 0, 0, []
            for row, (name, value) in enumerate(zip(batch.column(1), batch.column(2))):
                value = value.as_py() or ""
                found.append(arrange(value, seed, name.as_py(), plain_from, spm_below))
                size += len(value)
                if size >= 1 << 20 or row + 1 == batch.num_rows:  # outputs are as large as the texts: pass them on
                    columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
                    keys = batch.column(0).slice(at, len(found))
                    yield pa.RecordBatch.from_arrays([keys, *columns], names=names)
                    at, size, found = row + 1, 0, []

    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return df.select(key, name.alias("_name"), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    No text that was cut holds a mark, and no mark can arise across its ends, as
    each begins with a character that occurs nowhere else in a mark. So the first
    mark of each kind is the one that was put there.
    """
    first = F.substring(output, len(PREFIX) + 1, F.length(output))
    middle_at = F.instr(first, MIDDLE)
    middle = F.substring(first, middle_at + len(MIDDLE), F.length(first))
    head = F.substring(first, F.lit(1), middle_at - 1)

    def around(mark: str) -> tuple[Column, Column]:
        at = F.instr(head, mark)
        return F.substring(head, F.lit(1), at - 1), F.substring(head, at + len(mark), F.length(head))

    prefix, suffix = around(SUFFIX)
    late_suffix, late_prefix = around(PREFIX)
    return (
        F.when(form == PSM, F.concat(prefix, middle, suffix))
        .when(form == SPM, F.concat(late_prefix, middle, late_suffix))
        .otherwise(output)
    )


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of :func:`fill_in_middle` with hashes of output and restored text in place of the output."""

    def hashed(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return found.select(
        key, "n", "form", "prefix_chars", "middle_chars",
        hashed(F.col("output")).alias("output_sha256"),
        hashed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
