"""Exact order statistics from one table of counted values, for groups of any size.

The table holds every value of every field of a key once, with its count, in the order of key, field
and value over range partitions. Ranks are prefix sums: over the few partitions that a key's field
reaches into, and inside one partition, which bounds every group whatever a key's share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalis.functions.scratch import materialize


def count_values(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(``key``, field, value, n, part) of all ``fields``, from one pass over ``df``.

    Every key has a row per field, one of NULL where there is no value. Counts combine before the
    shuffle. ``part`` is the range partition; the table is written.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), value.cast("double").alias("value")) for name, value in fields.items()])
    counted = df.select(key, F.explode(pairs).alias("_p")).groupBy(
        key, F.col("_p.field").alias("field"), F.col("_p.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    dealt = counted.repartitionByRange(key, "field", "value").sortWithinPartitions(key, "field", "value")
    return materialize(dealt.withColumn("part", F.spark_partition_id()))


def medians(counted: DataFrame, key: str, *fields: str) -> DataFrame:
    """(``key``, field, x): the median of each field that has a value."""
    rows = counted.where(F.col("value").isNotNull() & F.col("field").isin(list(fields)))
    group = [key, "field"]
    whole = Window.partitionBy(*group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition that a group reaches into.
    reach = rows.groupBy(*group, "part").agg(F.sum("n").alias("held")).withColumns({
        "before": F.coalesce(F.sum("held").over(before), F.lit(0)), "total": F.sum("held").over(whole)})
    inside = lambda rank: F.when((rank > F.col("before")) & (rank <= F.col("before") + F.col("held")), rank - F.col("before"))
    middle = reach.select(
        *group, "part", inside(F.expr("(total + 1) div 2")).alias("low"), inside(F.expr("total div 2 + 1")).alias("high")
    ).where("low IS NOT NULL OR high IS NOT NULL")
    upto = Window.partitionBy(*group, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.join(middle, [*group, "part"]).withColumn("upto", F.sum("n").over(upto))
    at = lambda rank: F.max(F.when((F.col("upto") >= F.col(rank)) & (F.col("upto") - F.col("n") < F.col(rank)), F.col("value")))
    return ranked.groupBy(*group).agg(at("low").alias("low"), at("high").alias("high")).select(
        *group, ((F.col("low") + F.col("high")) / 2).alias("x"))


def modes(counted: DataFrame, key: str, *fields: str) -> DataFrame:
    """(``key``, field, x): the most frequent value of each field that has one, the smallest on a tie."""
    rows = counted.where(F.col("value").isNotNull() & F.col("field").isin(list(fields)))
    best = rows.groupBy(key, "field").agg(F.max(F.struct("n", (-F.col("value")).alias("less"))).alias("b"))
    return best.select(key, "field", (F.lit(0.0) - F.col("b.less")).alias("x"))


def gather(counted: DataFrame, key: str, found: dict[str, tuple[DataFrame, str]], plain: dict[str, Column]) -> DataFrame:
    """One row per key of ``counted``: ``found`` columns (long table, field) and ``plain`` aggregates.

    ``plain`` are aggregates over field, value and n. Results meet in one aggregate, without a join.
    """
    rows = counted.select(key, "field", "value", "n", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("x"))
    for name, (table, field) in found.items():
        rows = rows.unionByName(table.where(F.col("field") == field).select(key, "x", F.lit(name).alias("name")), allowMissingColumns=True)
    return rows.groupBy(key).agg(
        *[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in found],
        *[column.alias(name) for name, column in plain.items()])
