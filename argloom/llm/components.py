"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from argloom.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``; the root is one node of each component.

    Every round sends a node to the smallest of itself and its neighbours and
    contracts the links that way, until none is left. Both tables are written
    each round, so that no plan grows and a lost executor costs one round.
    """
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    roots = materialize(ends.withColumn("root", F.col("node")), "roots")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_b"))
        up = materialize(least.select(F.col("a").alias("_a"), F.least("a", "_b").alias("_up")), "up")
        roots = materialize(
            roots.join(up, F.col("root") == F.col("_a"), "left").select("node", F.coalesce("_up", "root").alias("root")),
            "roots",
        )
        moved = edges.join(up, F.col("a") == F.col("_a")).select(F.col("_up").alias("a"), "b")
        moved = moved.join(up, F.col("b") == F.col("_a")).select("a", F.col("_up").alias("b"))
        edges = materialize(moved.where("a <> b").distinct(), "links")
    return roots
