"""Cell attributes computed from other cell attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.schemas import require_columns


def roughness_height(cells: DataFrame) -> DataFrame:
    """Height of the roughness elements: surface level less ground level, NULL unless both are known."""
    require_columns(cells, "dtm_median", "dsm_median")
    return cells.withColumn("Height_rou", F.col("dsm_median") - F.col("dtm_median"))


def roughness_audit(cells: DataFrame) -> DataFrame:
    """Outcome counts of :func:`roughness_height`. Typed columns leave no conversion errors to count."""
    return cells.agg(
        F.count("*").alias("total"),
        F.count("Height_rou").alias("success"),
        F.lit(0).cast("bigint").alias("error"),
        F.count_if(F.col("Height_rou").isNull()).alias("missing"),
    )


def at_least_one(distance: Column) -> Column:
    """A distance never below 1; unknown counts as 1."""
    return F.greatest(F.coalesce(distance, F.lit(1.0)), F.lit(1.0))


def aspect_ratio(cells: DataFrame) -> DataFrame:
    """Mean building height over the median distance between buildings.

    Adds ``median_dist_used``, the distance with its lower bound of 1, and ``aspect_ratio``.
    """
    require_columns(cells, "median_dist", "mean_build_height")
    return cells.withColumn("median_dist_used", at_least_one(F.col("median_dist"))).withColumn(
        "aspect_ratio", F.col("mean_build_height") / F.col("median_dist_used"))
