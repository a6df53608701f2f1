"""Seeded, exact sampling that never gathers the sampled class in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from argloom.session import materialize

_DIGITS = 3  # hex digits per counting pass


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count("*").alias("n"))


def seeded_rank(key: Sequence[str], seed: int) -> Column:
    """A reproducible pseudo-random rank of a row, as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def _nth_rank(ranks: DataFrame, n: int, total: int) -> str:
    """The n-th smallest of a column of hex ranks.

    Counts ranks by leading digits and follows the digits that hold the n-th
    one, until it is the last of those that share them. A pass returns at most
    16**_DIGITS counts, whatever the size of the table.
    """
    prefix, left = "", n
    while left < total and len(prefix) < 32:
        digits = F.substring("rank", len(prefix) + 1, _DIGITS)
        counts = ranks.groupBy(digits.alias("digits")).agg(F.count("*").alias("n"))
        for row in sorted(counts.collect()):
            if left <= row.n:
                prefix, total = prefix + row.digits, row.n
                break
            left -= row.n
        ranks = ranks.where(F.col("rank").startswith(prefix))
    return prefix if left < total else ranks.agg(F.max("rank")).first()[0]


def sample_exactly(
    df: DataFrame, n: int, key: Sequence[str], seed: int, total: int | None = None
) -> DataFrame:
    """``n`` rows without replacement: those of the smallest seeded ranks.

    The result is a filter on the rank, so the rows themselves are not moved.
    Rows that share a key share a rank; when the cut falls among such copies,
    the copies alone are numbered and cut once more.
    """
    if n <= 0:
        return df.limit(0)
    rank = seeded_rank(key, seed)
    total = df.count() if total is None else total
    if total <= n:
        return df
    ranks = materialize(df.select(rank.alias("rank")), "ranks")
    cut = _nth_rank(ranks, n, total)
    below, upto = ranks.agg(
        F.count_if(F.col("rank") < cut), F.count_if(F.col("rank") <= cut)
    ).first()
    if upto == n:
        return df.where(rank <= cut)
    copies = materialize(
        df.where(rank == cut).withColumn("_copy", F.monotonically_increasing_id()), "copies"
    )
    return df.where(rank < cut).unionByName(
        sample_exactly(copies, n - below, ["_copy"], seed).drop("_copy")
    )


def _cuts(ranks: DataFrame, targets: DataFrame) -> DataFrame:
    """For every class, what its ``n`` smallest ranks begin with at most: ``class, cut, below, within``.

    Follows the leading digits of all classes at once, so the number of passes
    is bounded by the length of a rank, whatever the number of classes. ``below``
    ranks of the class are smaller than ``cut`` in its leading digits, ``within``
    begin with it; together they are at least ``n``, and more only where copies
    share the rank.
    """
    state = targets.select(
        "class", "n", F.lit("").alias("cut"), F.lit(0).cast("bigint").alias("below"), F.col("total").alias("within")
    )
    open_class = (F.col("below") + F.col("within") > F.col("n")) & (F.length("cut") < 32)
    digits = F.substring("rank", F.length("cut") + 1, F.lit(_DIGITS))
    so_far = Window.partitionBy("class").orderBy("digits")  # at most 16**_DIGITS rows a class
    while not state.where(open_class).isEmpty():
        asked = state.where(open_class)
        counts = (
            ranks.join(asked, ranks["_class"].eqNullSafe(asked["class"]))
            .where(F.col("rank").startswith(F.col("cut")))
            .groupBy("class", "n", "cut", "below", digits.alias("digits"))
            .agg(F.count("*").alias("within"))
        )
        summed = counts.withColumn("upto", F.col("below") + F.sum("within").over(so_far))
        found = summed.where((F.col("upto") >= F.col("n")) & (F.col("upto") - F.col("within") < F.col("n")))
        moved = found.select(
            "class", "n", F.concat("cut", "digits").alias("cut"), (F.col("upto") - F.col("within")).alias("below"), "within"
        )
        state = materialize(state.where(~open_class).unionByName(moved), "cuts")
    return state


def sample_each(
    df: DataFrame, targets: DataFrame, key: Sequence[str], label: str = "label", seed: int = 42
) -> DataFrame:
    """Of every class, the rows of its ``n`` smallest seeded ranks; ``targets`` has ``class, n, total``.

    ``total`` is the number of rows of the class. A class without a target is
    left out, one of at most ``n`` rows is kept whole, and a null label is a
    class. The result is a filter on the rank. Copies that share a rank at the
    cut are numbered and cut once more, those of all classes together.
    """
    names = df.columns
    rank = seeded_rank(key, seed)
    targets = materialize(targets.where("n > 0"), "targets")
    ranks = df.select(F.col(label).alias("_class"), rank.alias("rank"))
    ranks = materialize(ranks.join(targets.where("total > n"), F.col("_class").eqNullSafe(F.col("class")), "left_semi"), "ranks")
    cuts = _cuts(ranks, targets).select(
        F.col("class").alias("_class"), F.col("cut").alias("_cut"), "n", "below",
        (F.col("below") + F.col("within") > F.col("n")).alias("_over"),
    )
    cuts = materialize(cuts, "cuts")
    placed = df.join(cuts, df[label].eqNullSafe(cuts["_class"]))
    start = F.substring(rank, F.lit(1), F.length("_cut"))
    sampled = placed.where((start < F.col("_cut")) | ((start == F.col("_cut")) & ~F.col("_over"))).select(names)
    more = cuts.where("_over").select(F.col("_class").alias("class"), (F.col("n") - F.col("below")).alias("n"))
    if more.isEmpty():
        return sampled
    copies = placed.where((start == F.col("_cut")) & F.col("_over")).select(names)
    copies = materialize(copies.withColumn("_copy", F.monotonically_increasing_id()), "copies")
    sizes = copies.groupBy(F.col(label).alias("_class")).agg(F.count("*").alias("total"))
    more = more.join(sizes, F.col("class").eqNullSafe(F.col("_class"))).drop("_class")
    return sampled.unionByName(sample_each(copies, more, ["_copy"], label, seed).drop("_copy"))


def balance_classes(
    df: DataFrame, key: str | Sequence[str], label: str = "label", seed: int = 42
) -> DataFrame:
    """Sample every larger class down to the size of the smallest one; a null label is a class.

    The number of passes does not depend on the number of classes.
    """
    key = [key] if isinstance(key, str) else list(key)
    sizes = materialize(class_counts(df, label).select(F.col(label).alias("class"), F.col("n").alias("total")), "sizes")
    smallest = sizes.agg(F.min("total")).first()[0] or 0
    return sample_each(df, sizes.withColumn("n", F.lit(smallest).cast("bigint")), key, label, seed)


def shuffle_rows(df: DataFrame, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """Rows in a seeded random order.

    Copies of one key are ordered among themselves by a number written down
    beforehand: a much-repeated key then spreads over many output partitions,
    and a repeated task finds the same order again.
    """
    key = [key] if isinstance(key, str) else list(key)
    rows = materialize(df.withColumn("_copy", F.monotonically_increasing_id()), "shuffle")
    return rows.orderBy(seeded_rank(key, seed), seeded_rank(["_copy"], seed)).drop("_copy")
