"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.scratch import materialize

HOT_ROWS = 1_000_000


def lookup(left: DataFrame, key: str, right: DataFrame, n_left: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join to ``right``, which has one row per ``key``.

    A key can only be hot when ``left`` has more than ``hot_rows`` rows; below that this is a plain
    join. Above it, every key with more than ``hot_rows`` rows, whether ``right`` has it or not, is
    spread over as many salts as it has times that, and its row in ``right`` is repeated for each.
    There are at most ``n_left / hot_rows`` such keys, which bounds the table that is broadcast.
    """
    if n_left <= hot_rows:
        return left.join(right, key, "left")
    hot = materialize(left.groupBy(key).count().where(F.col("count") > hot_rows).select(
        key, F.ceil(F.col("count") / hot_rows).cast("int").alias("_salts")))
    mark = lambda df: df.join(F.broadcast(hot), key, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    tagged = mark(left).withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.col("_salts")).cast("int"))
    spread = mark(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    values = [c for c in right.columns if c != key]
    return tagged.join(spread, [key, "_salt"], "left").select(*left.columns, *values)
