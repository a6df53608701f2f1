"""Logits to probabilities, classes and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from argloom.functions.arrays import let


def softmax(logits: Column, classes: int | None = None) -> Column:
    """Probabilities from an array of logits, shifted by the maximum for stability.

    With the number of classes known the sums are written out, which is faster.
    """
    if classes is not None:
        top = F.array_max(logits)
        powers = F.array(*[F.exp(logits[i] - top) for i in range(classes)])

        def shares(e: Column) -> Column:
            total = e[0]
            for i in range(1, classes):
                total = total + e[i]
            return F.array(*[e[i] / total for i in range(classes)])

        return let(powers, shares)
    powers = let(
        logits,
        lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top))),
    )

    def normalised(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
        return let(total, lambda t: F.transform(e, lambda v: v / t))

    return let(powers, normalised)


def sigmoid(margin: Column) -> Column:
    """Probability of class 1 from the difference of two logits."""
    return 1 / (1 + F.exp(-margin))


def argmax(scores: Column) -> Column:
    """Position of the largest entry, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def label_of(class_id: Column, labels: Sequence[str]) -> Column:
    """Name of a class id."""
    return F.element_at(F.array(*[F.lit(label) for label in labels]), class_id + 1)


def prob_of(probs: Column, class_id: Column | int = 1) -> Column:
    """Probability of one class, class 1 unless told otherwise."""
    return F.element_at(probs, (F.lit(class_id) if isinstance(class_id, int) else class_id) + 1)


def rounded(prob: Column) -> Column:
    """A probability to six digits, the same as ``F.round`` gives, whose decimal arithmetic only a near tie needs."""
    micro = prob * 1_000_000
    clear = prob.between(0, 1) & (F.abs(micro - F.floor(micro) - 0.5) > 1e-9)
    return F.when(clear, F.floor(micro + 0.5) / 1_000_000).otherwise(F.round(prob, 6))
