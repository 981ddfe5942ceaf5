"""Range tables of any size: disjoint first-match intervals, and values looked up in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonalis.functions.scratch import materialize


def _carried(parts: DataFrame, name: str, how) -> DataFrame:
    """Per range partition what all earlier ones hand over; one row per partition, so one task is enough."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", how(F.col(name)).over(earlier).alias(f"carried_{name}"))


def first_match_intervals(ranges: DataFrame) -> DataFrame:
    """(a, b, new_val): where each range of ``ranges`` (lo, hi, new_val) is the first that holds a value.

    Ranges hold lo < v <= hi and are tried by lo, hi and new_val. Whatever begins before a range and
    reaches a value in it comes first, so a range wins from the largest end before it to its own end:
    a running maximum in the order of the beginnings, inside range partitions and carried between them.
    """
    known = ranges.select(*[F.col(c).cast("double").alias(c) for c in ("lo", "hi", "new_val")]).where("lo < hi").distinct()
    dealt = materialize(known.repartitionByRange("lo", "hi", "new_val").withColumn("part", F.spark_partition_id()))
    ends = dealt.groupBy("part").agg(F.max("hi").alias("hi"))
    before = Window.partitionBy("part").orderBy("lo", "hi", "new_val").rowsBetween(Window.unboundedPreceding, -1)
    swept = dealt.withColumn("own", F.max("hi").over(before)).join(F.broadcast(_carried(ends, "hi", F.max)), "part")
    # greatest skips NULL.
    return swept.select(F.greatest("lo", "own", "carried_hi").alias("a"), F.col("hi").alias("b"), "new_val").where("a < b")


def look_up(values: DataFrame, value: str, intervals: DataFrame) -> DataFrame:
    """(``value``, new_val) of the distinct ``values`` that lie in a disjoint interval a < v <= b.

    Values and beginnings are dealt together over range partitions; the last beginning before a value
    comes from its own partition or is carried into it.
    """
    asked = values.select(F.col(value).alias("x")).where("x IS NOT NULL").distinct()
    # At one place the value comes first: it is not in an interval that begins there.
    begins = intervals.select(F.col("a").alias("x"), F.lit(1).alias("kind"), F.struct("b", "new_val").alias("at"))
    both = begins.unionByName(asked.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    dealt = materialize(both.repartitionByRange("x", "kind").withColumn("part", F.spark_partition_id()))
    last = dealt.groupBy("part").agg(F.max_by("at", F.when(F.col("kind") == 1, F.col("x"))).alias("at"))
    upto = Window.partitionBy("part").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumn("own", F.last("at", True).over(upto)).where("kind = 0").join(
        F.broadcast(_carried(last, "at", lambda c: F.last(c, True))), "part")
    hit = F.coalesce("own", "carried_at")
    return found.select(F.col("x").alias(value), hit.alias("hit")).where(F.col(value) <= F.col("hit.b")).select(value, "hit.new_val")
