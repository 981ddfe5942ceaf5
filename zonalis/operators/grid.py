"""The cell grid, pixel-to-cell assignment, windows, and attaching cell results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions.ranges import lattice
from zonalis.schemas import Georef, GridSpec, exact


def make_grid(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """Every cell of the grid with its rectangle; ids run row by row from the upper-left cell."""
    left = F.lit(grid.x_min) + F.col("cell_col") * F.lit(grid.size)
    top = F.lit(grid.y_max) - F.col("cell_row") * F.lit(grid.size)
    return lattice(spark, grid.n_rows, grid.n_cols, "cell_row", "cell_col").select(
        (F.col("cell_row") * grid.n_cols + F.col("cell_col")).alias("cell_id"),
        "cell_row", "cell_col",
        left.alias("left"), top.alias("top"),
        (left + grid.size).alias("right"), (top - grid.size).alias("bottom"),
    )


def layer_extent(pixels: DataFrame, geo: Georef) -> DataFrame:
    """Bounds of each layer in map units, from the indices it occupies."""
    return pixels.groupBy("layer").agg(
        (F.lit(geo.x_min) + F.min("col_idx") * geo.px_x).alias("x_min"),
        (F.lit(geo.y_max) - (F.max("row_idx") + 1) * geo.px_y).alias("y_min"),
        (F.lit(geo.x_min) + (F.max("col_idx") + 1) * geo.px_x).alias("x_max"),
        (F.lit(geo.y_max) - F.min("row_idx") * geo.px_y).alias("y_max"),
    )


def assign_cells(pixels: DataFrame, geo: Georef, grid: GridSpec) -> DataFrame:
    """Add ``cell_id``, the one cell that holds the pixel centre; pixels off the grid drop out.

    The cell follows from the indices by arithmetic, so this is a projection, not a spatial join.
    """

    def cell(index: str, start: float, pixel: float) -> Column:
        # floor((start + (index + 1/2) * pixel) / size) in whole numbers, so that a centre on a border
        # falls on the same side as in the count of the grid's cells.
        size, step, first = exact(grid.size), exact(pixel), exact(start)
        unit = math.lcm(size.denominator, step.denominator, first.denominator)
        a, b, c = (int(v * unit) for v in (step, 2 * first, 2 * size))
        place = f"((2 * {index} + 1) * {a}L + {b}L)"
        return F.expr(f"({place} - pmod({place}, {c}L)) div {c}L")

    return (
        pixels.withColumns({
            "cell_row": cell("row_idx", grid.y_max - geo.y_max, geo.px_y),
            "cell_col": cell("col_idx", geo.x_min - grid.x_min, geo.px_x)})
        .where(F.col("cell_row").between(0, grid.n_rows - 1) & F.col("cell_col").between(0, grid.n_cols - 1))
        .withColumn("cell_id", F.col("cell_row") * grid.n_cols + F.col("cell_col"))
        .drop("cell_row", "cell_col")
    )


def window_pixels(pixels: DataFrame, geo: Georef, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """Pixels whose centre lies in a box. The test is on the stored indices, so the scan can skip data."""
    first_col = F.ceil(F.lit((left - geo.x_min) / geo.px_x - 0.5))
    end_col = F.ceil(F.lit((right - geo.x_min) / geo.px_x - 0.5))
    first_row = F.ceil(F.lit((geo.y_max - top) / geo.px_y - 0.5))
    end_row = F.ceil(F.lit((geo.y_max - bottom) / geo.px_y - 0.5))
    row, col = F.col("row_idx"), F.col("col_idx")
    return pixels.where((row >= first_row) & (row < end_row) & (col >= first_col) & (col < end_col))


def attach_stats(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """Add result columns to cells; cells without a result keep NULL."""
    return cells.join(stats, "cell_id", "left")


def cells_without_stats(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """Cells for which no result was computed."""
    return cells.join(stats.select("cell_id"), "cell_id", "left_anti")
