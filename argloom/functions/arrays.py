"""Helpers around arrays: values computed once, items as rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, value: Column, out: str) -> DataFrame:
    """``df`` with a new column that is worked out once per row, whatever is filtered above it.

    A filter on the column would be pushed below it together with a second copy of
    the work. One-item arrays stop that; filters on other columns still reach the scan.
    """
    return df.select("*", F.explode(F.array(value)).alias(out))


def _running(values: Column) -> Column:
    """0 and the running sums of a short array. Each step copies the list so far."""
    zero = F.array(F.lit(0).cast("bigint"))
    return F.aggregate(
        values, zero, lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
    )


def sums_before(values: Column, levels: int = 3, run: int = 16) -> Column:
    """For every number of an array, the sum of those before it.

    Sums run over short pieces, and the totals of the pieces are summed the
    same way, so that the work stays in proportion to the length of the array.
    """
    if levels == 0:
        return let(_running(values), lambda sums: F.slice(sums, F.lit(1), F.size(sums) - 1))

    def pieces(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(run)))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        return F.transform(starts, lambda at: _running(F.slice(v, at, F.lit(run))))

    def shifted(piece: Column, base: Column) -> Column:
        inner = F.slice(piece, F.lit(1), F.size(piece) - 1)
        return F.transform(inner, lambda sum_before: sum_before + base)

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda piece: F.element_at(piece, -1))
        bases = sums_before(totals, levels - 1, run)
        return F.flatten(F.zip_with(parts, bases, shifted))

    return let(let(values, pieces), joined)


def items(
    df: DataFrame, keep: Sequence[str | Column], array: str, item: str = "item", place: str = "place"
) -> DataFrame:
    """One row per item of an array column, with its position.

    The outer generator followed by a filter, not the inner one: from the inner
    one the optimizer infers ``size(array) > 0`` and pushes that below whatever
    builds the array, so that every split, model and pairing would run twice.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, item))
    return rows.where(F.col(place).isNotNull())
