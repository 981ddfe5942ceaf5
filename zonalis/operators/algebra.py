"""Per-pixel map algebra: alignment, reclassification, overlay, masks, products, expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.intervals import first_match_intervals, look_up
from zonalis.functions.scratch import materialize
from zonalis.functions.skew import lookup
from zonalis.schemas import NODATA

# Fixed values: (low, high, new) class ranges, the burned building code, the steepest ground slope
# in degrees, the albedo scale.
SURFACE_RANGES = ((0.0, 5.0, 1.0), (5.0, 9.0, 0.0))
BUILDING_CODE = 2
GROUND_SLOPE = 5.71
ALBEDO_SCALE = 10000.0

# Ranges that every pixel can look through; more are joined.
MAX_RANGES = 1000


def align_layers(pixels: DataFrame, layers, band: int = 1, how: str = "inner", by=("row_idx", "col_idx")) -> DataFrame:
    """One row per position with a column per layer, in a single shuffle for any number of layers.

    ``how='inner'`` keeps positions at which every layer has a row; ``'outer'`` keeps all of them. A
    position is the columns ``by``.
    """
    named = list(layers)
    wide = (
        pixels.where(F.col("layer").isin(named) & (F.col("band") == band))
        .groupBy(*by)
        .agg(
            *[F.max(F.when(F.col("layer") == name, F.col("value"))).alias(name) for name in named],
            *[F.max(F.when(F.col("layer") == name, True)).alias(f"_has_{name}") for name in named],
        )
    )
    if how == "inner":
        wide = wide.where(" AND ".join(f"`_has_{name}`" for name in named))
    return wide.drop(*[f"_has_{name}" for name in named])


def reclassify(value: Column, ranges=SURFACE_RANGES) -> Column:
    """Map ``low < v <= high`` to the new value; the first matching range wins.

    Values in no range pass through and the nodata code becomes NULL. Ranges are few and given by
    the caller, so they become one CASE expression and no join.
    """
    v = value.cast("double")
    out = F.when(v == NODATA, F.lit(None).cast("double"))
    for low, high, new in ranges:
        out = out.when((v > low) & (v <= high), F.lit(float(new)))
    return out.otherwise(v)


def reclassify_by_table(pixels: DataFrame, ranges: DataFrame, value: str, name: str) -> DataFrame:
    """The same with ranges from a table (lo, hi, new_val) of any size, tried by lo, hi and new_val.

    Up to ``MAX_RANGES`` rows are gathered into one array that every pixel looks through. Of more, the
    disjoint intervals in which each range is the first match are found by a sweep, the distinct
    values are looked up in them, and the pixels take the result by a join that spreads hot values.
    """
    v = F.col(value).cast("double")
    if ranges.count() > MAX_RANGES:
        keyed = pixels.withColumn("_v", F.when(v != NODATA, v))
        new = materialize(look_up(keyed, "_v", first_match_intervals(ranges)).withColumnRenamed("new_val", "_new"))
        out = lookup(keyed, "_v", new, keyed.count())
        return out.withColumn(name, F.coalesce("_new", "_v")).drop("_v", "_new")
    table = ranges.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "new_val"))).alias("t")).scalar()
    hit = F.get(F.filter("_ranges", lambda r: (v > r.lo) & (v <= r.hi)), F.lit(0))
    new = F.when(v != NODATA, F.coalesce(hit["new_val"].cast("double"), v))
    return pixels.withColumn("_ranges", table).withColumn(name, new).drop("_ranges")


def overlay_buildings(base: Column, building: Column) -> Column:
    """A building pixel takes the building code, every other pixel keeps the base value."""
    return F.coalesce(F.when(building == 1, F.lit(float(BUILDING_CODE))), base)


def slope_filter(slope: Column, elevation: Column, limit: float = GROUND_SLOPE) -> Column:
    """Elevation where the ground is flat enough, NULL elsewhere."""
    return F.when(slope <= limit, elevation)


def mask_buildings(elevation: Column, mask: Column, masked: str = "zero") -> Column:
    """Elevation outside buildings. Building pixels become 0, or NULL with ``masked='null'``."""
    if masked == "null":
        return F.when(mask != 1, elevation)
    if masked == "zero":
        return elevation * (mask != 1).cast("int")
    raise ValueError("masked is 'zero' or 'null'")


def raster_product(a: Column, b: Column) -> Column:
    """Pixel-wise product, stored as 32-bit float."""
    return (a * b).cast("float").cast("double")


def normalize_albedo(value: Column, scale: float = ALBEDO_SCALE) -> Column:
    """Scale stored albedo to 0..1; NULL stays NULL."""
    return value / scale


def albedo_audit(cells: DataFrame, column: str) -> DataFrame:
    """How many rows were scaled and how many had nothing to scale."""
    return cells.agg(
        F.count("*").alias("total"),
        F.count(column).alias("normalized"),
        F.count_if(F.col(column).isNull()).alias("null_rows"),
    )


def raster_expr(pixels: DataFrame, name: str, expression: str) -> DataFrame:
    """Add a column computed from other columns by a Spark SQL expression."""
    return pixels.withColumn(name, F.expr(expression))


def drop_zero(regions: DataFrame, column: str = "value") -> DataFrame:
    """Remove the background: rows whose value is 0."""
    return regions.where(F.col(column) != 0)
