"""Statistics of pixels per zone.

Every function takes pixels that already carry their zone key. Counts, sums and means combine before
the shuffle. Exact medians and modes hold a group's distinct values in one buffer, so they are used
as plain aggregates only while the zone's pixel count is bounded by ``max_pixels``; beyond it they
are read from a table of counted values, in which no group is larger than a range partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.counted import count_values, gather, medians, modes

BUFFER_PIXELS = 500_000
# The surface codes, and the stand-in distance for a cell with no building near.
IMPERVIOUS, PERVIOUS, BUILDINGS = 0, 1, 2
DISTANCE_FLOOR = 0.001


def fraction_columns(code: Column) -> list[Column]:
    """Aggregates for the share of each surface code in percent; other codes do not count at all."""
    whole = F.count_if(code.isin(IMPERVIOUS, PERVIOUS, BUILDINGS))
    share = lambda k: F.try_divide(F.count_if(code == k), whole) * F.lit(100.0)
    return [
        share(IMPERVIOUS).alias("perc_impervious"),
        share(PERVIOUS).alias("perc_pervious"),
        share(BUILDINGS).alias("perc_buildings"),
    ]


def class_fractions(pixels: DataFrame, code: str, zone: str = "cell_id") -> DataFrame:
    """Share of impervious, pervious and built pixels per zone; NULL where no pixel has a known code."""
    return pixels.groupBy(zone).agg(*fraction_columns(F.col(code)))


def fraction_summary(cells: DataFrame, fields=("perc_impervious", "perc_pervious", "perc_buildings")) -> DataFrame:
    """Minimum, maximum, mean and count of the non-NULL values of each field."""
    long = cells.unpivot([], list(fields), "field", "v")
    return long.groupBy("field").agg(
        F.min("v").alias("min_value"), F.max("v").alias("max_value"),
        F.avg("v").alias("mean_value"), F.count("v").alias("n_values"),
    )


def zonal_median(
    pixels: DataFrame, value: Column, name: str, max_pixels: int, zone: str = "cell_id"
) -> DataFrame:
    """Exact median of the non-NULL values per zone; zones without a value get NULL."""
    if max_pixels <= BUFFER_PIXELS:
        return pixels.groupBy(zone).agg(F.median(value).alias(name))
    counted = count_values(pixels, zone, {name: value})
    return gather(counted, zone, {name: (medians(counted, zone, name), name)}, {})


def zonal_mean(pixels: DataFrame, value: Column, name: str, zone: str = "cell_id") -> DataFrame:
    """Mean of the non-NULL values per zone."""
    return pixels.groupBy(zone).agg(F.avg(value).alias(name))


def zonal_majority(pixels: DataFrame, value: Column, name: str, max_pixels: int, zone: str = "cell_id") -> DataFrame:
    """Most frequent value per zone, the smallest on a tie; zones without a value get NULL."""
    if max_pixels <= BUFFER_PIXELS:
        return pixels.groupBy(zone).agg(F.mode(value, True).alias(name))
    counted = count_values(pixels, zone, {name: value})
    return gather(counted, zone, {name: (modes(counted, zone, name), name)}, {})


def positive_distance(distance: Column) -> Column:
    """A distance as the median sees it: zero and NaN do not count."""
    return F.when((distance != 0) & ~F.isnan(distance), distance)


def median_dist(pixels: DataFrame, max_pixels: int, zone: str = "cell_id") -> DataFrame:
    """Median distance to the nearest building over the pixels outside buildings."""
    return zonal_median(pixels, positive_distance(F.col("distance")), "median_dist", max_pixels, zone)


def median_dist_floor(pixels: DataFrame, max_pixels: int, zone: str = "cell_id") -> DataFrame:
    """The same, with a small positive number for zones that have no such pixel."""
    medians = median_dist(pixels, max_pixels, zone)
    return medians.withColumn("median_dist", F.coalesce("median_dist", F.lit(DISTANCE_FLOOR)))


def masked_height(
    pixels: DataFrame, product: Column, stat: str, max_pixels: int, zone: str = "cell_id"
) -> DataFrame:
    """Median or mean of elevation times mask per zone, with 0 in place of NULL."""
    if stat == "median":
        out = zonal_median(pixels, product, "med_median", max_pixels, zone)
        return out.withColumn("med_median", F.coalesce("med_median", F.lit(0.0)))
    if stat == "mean":
        return zonal_mean(pixels, product, "med_mean", zone).withColumn("med_mean", F.coalesce("med_mean", F.lit(0.0)))
    raise ValueError("stat is 'median' or 'mean'")


def _built_height() -> Column:
    return F.when(F.col("mask") == 1, F.col("dsm"))


def _mean_of(field: str) -> Column:
    """Mean of a field of counted values."""
    n = F.when((F.col("field") == field) & F.col("value").isNotNull(), F.col("n"))
    return F.sum(n * F.col("value")) / F.sum(n)


def mean_build_height(pixels: DataFrame, max_pixels: int, zone: str = "cell_id") -> DataFrame:
    """Mean height of a zone's building pixels above its ground level, the median of ``dtm``.

    The mean of ``dsm - level`` is the mean of ``dsm`` less the level, so pixels need not be joined
    with the ground level first.
    """
    built = F.avg(_built_height()).alias("_built")
    if max_pixels <= BUFFER_PIXELS:
        stats = pixels.groupBy(zone).agg(built, F.median("dtm").alias("_level"))
    else:
        counted = count_values(pixels, zone, {"dtm": F.col("dtm"), "built": _built_height()})
        stats = gather(counted, zone, {"_level": (medians(counted, zone, "dtm"), "dtm")}, {"_built": _mean_of("built")})
    return stats.select(zone, (F.col("_built") - F.col("_level")).alias("mean_build_height"))


def cell_profile(pixels: DataFrame, max_pixels: int, zone: str = "cell_id") -> DataFrame:
    """All zonal statistics of an aligned table in one aggregation.

    Needs the columns surface, dsm, dtm, mask, albedo. Returns the class fractions, dtm_median,
    dsm_median, mean_build_height and albedo_majority.
    """
    if max_pixels <= BUFFER_PIXELS:
        stats = pixels.groupBy(zone).agg(
            *fraction_columns(F.col("surface")), F.avg(_built_height()).alias("_built"),
            F.median("dtm").alias("dtm_median"), F.median("dsm").alias("dsm_median"),
            F.mode("albedo", True).alias("albedo_majority"),
        )
    else:
        # One pass over the pixels counts all values; every statistic is read from the counts.
        counted = count_values(pixels, zone, {
            "surface": F.col("surface"), "dtm": F.col("dtm"), "dsm": F.col("dsm"), "albedo": F.col("albedo"), "built": _built_height()})
        middle, most = medians(counted, zone, "dtm", "dsm"), modes(counted, zone, "albedo")
        of = lambda *codes: F.sum(F.when((F.col("field") == "surface") & F.col("value").isin(*codes), F.col("n")).otherwise(0))
        share = lambda code: F.try_divide(of(code), of(IMPERVIOUS, PERVIOUS, BUILDINGS)) * F.lit(100.0)
        stats = gather(
            counted, zone,
            {"dtm_median": (middle, "dtm"), "dsm_median": (middle, "dsm"), "albedo_majority": (most, "albedo")},
            {"perc_impervious": share(IMPERVIOUS), "perc_pervious": share(PERVIOUS), "perc_buildings": share(BUILDINGS), "_built": _mean_of("built")},
        ).select(zone, "perc_impervious", "perc_pervious", "perc_buildings", "_built", "dtm_median", "dsm_median", "albedo_majority")
    return stats.withColumn("mean_build_height", F.col("_built") - F.col("dtm_median")).drop("_built")
