"""Connected components by hooking and pointer jumping, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); the component is the smallest id reachable.

    Each round hooks every vertex to its smallest neighbour if that is smaller, follows the pointers
    to the roots by doubling and contracts the edges to the roots. A vertex that is no local minimum
    disappears, so few rounds are left whatever the graph's shape. NULL ends and loops are ignored;
    no edges give no rows. Every round is written, so lost executors cost no more than one round.
    """
    left = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    placed = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = materialize(both.groupBy("a").agg(F.min("b").alias("to")).select(
            F.col("a").alias("id"), F.least("a", "to").alias("to")
        ))
        while True:
            ahead = point.select(F.col("id").alias("to"), F.col("to").alias("next"))
            moved = materialize(point.join(ahead, "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            point = moved.select("id", "to")
            if moved.where("moved").isEmpty():
                break
        if placed is None:
            placed = point
        else:
            step = point.select(F.col("id").alias("to"), F.col("to").alias("next"))
            placed = materialize(placed.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to")))
        root = lambda c: point.select(F.col("id").alias(c), F.col("to").alias(f"{c}_root"))
        left = materialize(
            left.join(root("a"), "a").join(root("b"), "b").where("a_root <> b_root")
            .select(F.greatest("a_root", "b_root").alias("a"), F.least("a_root", "b_root").alias("b")).distinct()
        )
    if placed is None:
        placed = left.select(F.col("a").alias("id"), F.col("b").alias("to"))
    return placed.withColumnRenamed("to", "component")
