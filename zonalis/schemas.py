"""Table schemas and the raster and grid geometry that operators take as parameters."""

from __future__ import annotations

import math
from fractions import Fraction
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIXELS = "layer STRING, band INT, row_idx BIGINT, col_idx BIGINT, value DOUBLE"
TILES = (
    "tile_id BIGINT, layer STRING, band INT, priority INT, row0 BIGINT, col0 BIGINT, "
    "n_rows INT, n_cols INT, data ARRAY<FLOAT>"
)
CELLS = (
    "cell_id BIGINT, cell_row BIGINT, cell_col BIGINT, "
    "left DOUBLE, top DOUBLE, right DOUBLE, bottom DOUBLE"
)

NODATA = -9999.0


def exact(x: float) -> Fraction:
    """The decimal number that was meant by ``x``, up to six places: 0.3 is three tenths."""
    return Fraction(str(float(x))).limit_denominator(10**6)


@dataclass(frozen=True)
class Georef:
    """Placement of a raster: upper-left corner, pixel size, shape and CRS text."""

    x_min: float
    y_max: float
    px_x: float
    px_y: float
    n_rows: int
    n_cols: int
    crs: str = ""


@dataclass(frozen=True)
class GridSpec:
    """Square cells anchored at an upper-left corner; edge cells keep their full size."""

    x_min: float
    y_max: float
    size: float
    n_rows: int
    n_cols: int

    MIN_SIZE = 0.1
    MAX_SIZE = 10000.0

    @staticmethod
    def over(geo: Georef, size: float = 30.0) -> GridSpec:
        size = round(float(size), 2)
        if not GridSpec.MIN_SIZE <= size <= GridSpec.MAX_SIZE:
            raise ValueError(f"cell size {size} is outside {GridSpec.MIN_SIZE}..{GridSpec.MAX_SIZE}")
        return GridSpec(
            geo.x_min,
            geo.y_max,
            size,
            math.ceil(geo.n_rows * exact(geo.px_y) / exact(size)),
            math.ceil(geo.n_cols * exact(geo.px_x) / exact(size)),
        )

    def max_pixels_per_cell(self, geo: Georef) -> int:
        """How many pixel centres one cell can hold, known before any data is read."""
        per_side = lambda px, n: min(n, math.ceil(self.size / px) + 1)
        return per_side(geo.px_y, geo.n_rows) * per_side(geo.px_x, geo.n_cols)


def georef_of(pixels: DataFrame, x_min=0.0, y_max=0.0, px_x=1.0, px_y=1.0, crs="") -> Georef:
    """Read a raster's shape from its pixel table. This collects a single row."""
    last = pixels.agg(F.max("row_idx").alias("r"), F.max("col_idx").alias("c")).first()
    shape = [0 if v is None else v + 1 for v in last]
    return Georef(x_min, y_max, px_x, px_y, *shape, crs=crs)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Return ``df`` unchanged, or raise naming the columns it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def ensure_column(df: DataFrame, name: str, sql_type: str) -> DataFrame:
    """Add ``name`` as a NULL column of the given type unless it is already there."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(sql_type))
