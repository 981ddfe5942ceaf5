"""Integer ranges as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 4096


def explode_range(df: DataFrame, name: str, lo: Column, hi: Column, chunk: int = CHUNK) -> DataFrame:
    """One row per integer in ``lo..hi`` (none when ``hi < lo``).

    The range is cut into chunks first, so that no row ever carries a long array.
    """
    return (
        df.withColumn("_lo", lo.cast("bigint"))
        .withColumn("_hi", hi.cast("bigint"))
        .where("_lo <= _hi")
        .withColumn("_at", F.explode(F.expr(f"sequence(_lo, _hi, {chunk}L)")))
        .withColumn(name, F.explode(F.expr(f"sequence(_at, least(_at + {chunk - 1}L, _hi))")))
        .drop("_lo", "_hi", "_at")
    )


def lattice(spark: SparkSession, n_rows: int, n_cols: int, row: str, col: str) -> DataFrame:
    """Every (row, col) of a frame, produced in parallel from a range."""
    if n_rows * n_cols == 0:
        return spark.createDataFrame([], f"{row} BIGINT, {col} BIGINT")
    return spark.range(n_rows * n_cols).select(
        F.expr(f"id div {n_cols}L").alias(row), F.expr(f"id % {n_cols}L").alias(col)
    )
