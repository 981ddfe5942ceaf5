"""Polygons as edge rows: rasterization and statistics of the pixels inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonalis.functions.blocks import BLOCK
from zonalis.functions.ranges import explode_range
from zonalis.operators.windows import PrefixSums, prefix_sums, sums_in
from zonalis.operators.zonal import BUILDINGS, IMPERVIOUS, PERVIOUS, class_fractions
from zonalis.schemas import Georef

BURN_VALUE = 2


def polygon_spans(edges: DataFrame, geo: Georef) -> DataFrame:
    """(polygon_id, row_idx, first, last): the stretches of columns whose pixel centres lie inside a polygon.

    ``edges`` has (polygon_id, x1, y1, x2, y2) in pixel units. Each edge is cut at the pixel-centre
    lines it crosses, counting its lower end and not its upper one; the crossings of a line, taken
    in pairs, bound the inside (even-odd rule, so holes work).
    """
    y_low, y_high = F.least("y1", "y2"), F.greatest("y1", "y2")
    crossing = explode_range(
        edges, "row_idx",
        F.greatest(F.ceil(y_low - 0.5), F.lit(0)), F.least(F.ceil(y_high - 0.5) - 1, F.lit(geo.n_rows - 1)),
    ).select(
        "polygon_id", "row_idx",
        (F.col("x1") + (F.col("row_idx") + F.lit(0.5) - F.col("y1")) * (F.col("x2") - F.col("x1"))
         / (F.col("y2") - F.col("y1"))).alias("x"),
    )
    line = Window.partitionBy("polygon_id", "row_idx").orderBy("x")
    spans = crossing.select(
        "polygon_id", "row_idx", "x", F.lead("x").over(line).alias("x_end"), F.row_number().over(line).alias("n"),
    ).where("n % 2 = 1")
    return spans.select(
        "polygon_id", "row_idx", F.greatest(F.ceil(F.col("x") - 0.5), F.lit(0)).alias("first"),
        F.least(F.ceil(F.col("x_end") - 0.5) - 1, F.lit(geo.n_cols - 1)).alias("last"))


def polygon_pixels(edges: DataFrame, geo: Georef) -> DataFrame:
    """Pixels (polygon_id, row_idx, col_idx) whose centre lies inside a polygon; see :func:`polygon_spans`."""
    return explode_range(polygon_spans(edges, geo), "col_idx", F.col("first"), F.col("last")).select("polygon_id", "row_idx", "col_idx")


def rasterize_polygons(edges: DataFrame, geo: Georef, burn: int = BURN_VALUE) -> DataFrame:
    """Burn one value into every pixel covered by any polygon; all other pixels are absent."""
    covered = polygon_pixels(edges, geo).select("row_idx", "col_idx").distinct()
    return covered.withColumn("value", F.lit(burn))


def zonal_polygons(edges: DataFrame, pixels: DataFrame, geo: Georef, code: str = "surface") -> DataFrame:
    """Class fractions per polygon of any shape. Polygons may overlap; one without a pixel has NULLs.

    Only pixels within the extent of all polygons, one row of figures, are shuffled.
    """
    extent = edges.agg(
        F.floor(F.min(F.least("y1", "y2")) - 1).alias("_r0"), F.ceil(F.max(F.greatest("y1", "y2"))).alias("_r1"),
        F.floor(F.min(F.least("x1", "x2")) - 1).alias("_c0"), F.ceil(F.max(F.greatest("x1", "x2"))).alias("_c1"))
    near = pixels.select("row_idx", "col_idx", code).join(
        F.broadcast(extent), F.expr("row_idx BETWEEN _r0 AND _r1 AND col_idx BETWEEN _c0 AND _c1"))
    inside = polygon_pixels(edges, geo).join(near.drop("_r0", "_r1", "_c0", "_c1"), ["row_idx", "col_idx"])
    return edges.select("polygon_id").distinct().join(class_fractions(inside, code, "polygon_id"), "polygon_id", "left")


CODES = {"impervious": IMPERVIOUS, "pervious": PERVIOUS, "buildings": BUILDINGS}


def class_counts(pixels: DataFrame, geo: Georef, code: str = "surface", block: int = BLOCK) -> PrefixSums:
    """Prefix counts of the surface codes, which :func:`zonal_polygons_cover` reads for any number of polygons."""
    marked = pixels.select("row_idx", "col_idx", *[F.when(F.col(code) == k, F.lit(1.0)).alias(name) for name, k in CODES.items()])
    return prefix_sums(marked, geo, *CODES, block=block)


def zonal_polygons_cover(edges: DataFrame, counts: PrefixSums) -> DataFrame:
    """The same as :func:`zonal_polygons` from prefix counts, without a row per covered pixel.

    A polygon is its stretches of columns, as many as the rows that its outline passes, and what is in
    a stretch is the difference of counts at its corners. The corners that two stretches one above
    the other share fall away before anything is looked up.
    """
    spans = polygon_spans(edges, counts.geo).where("first <= last")
    boxes = spans.select(
        F.col("polygon_id").alias("box"), F.col("row_idx").alias("r0"), (F.col("row_idx") + 1).alias("r1"),
        F.col("first").alias("c0"), (F.col("last") + 1).alias("c1"))
    per = sums_in(counts, boxes)
    n = {name: F.col(f"n{k}") for k, name in enumerate(CODES)}
    whole = sum(n.values())
    shares = per.select(
        F.col("box").alias("polygon_id"), *[(F.try_divide(x, whole) * F.lit(100.0)).alias(f"perc_{name}") for name, x in n.items()])
    return edges.select("polygon_id").distinct().join(shares, "polygon_id", "left")
