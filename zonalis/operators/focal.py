"""Slope and the ground filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.blocks import BLOCK, Line, with_halo
from zonalis.operators.algebra import GROUND_SLOPE, mask_buildings, slope_filter


def slope(
    pixels: DataFrame, elevation: str = "dsm", px_x: float = 1.0, px_y: float = 1.0,
    z_factor: float = 1.0, block: int = BLOCK, name: str = "slope",
) -> DataFrame:
    """Add the slope in degrees by the 3x3 gradient of Horn (1981); all columns are kept.

    A missing or NULL neighbour takes the centre value, a NULL centre gives NULL. Each block is
    passed over along its rows and then along its columns. The column pass reads the west, centre
    and east values of the rows above and below, so a position without a pixel but with a stored
    neighbour in its row needs a stand-in there: the row pass adds exactly those, which is nothing
    for a dense raster.
    """
    others = [c for c in pixels.columns if c not in ("row_idx", "col_idx")]
    row = Line("col_idx")
    keyed = with_halo(pixels, block).withColumn("_v", F.col(elevation).cast("double"))
    lined = keyed.withColumns({
        "_pc": row.position(-1), "_nc": row.position(1),
        "_pv": row.value("_v", -1), "_nv": row.value("_v", 1),
    })
    col, none = F.col("col_idx"), F.lit(None).cast("double")
    west = F.when(F.col("_pc") == col - 1, F.col("_pv"))
    east = F.when(F.col("_nc") == col + 1, F.col("_nv"))
    cell = lambda c, w, v, e, real: F.struct(
        c.alias("c"), w.alias("w"), v.alias("v"), e.alias("e"), F.lit(real).alias("real"))
    here = cell(col, west, F.col("_v"), east, True)
    # Stand-ins right and left of a pixel. A gap of one is filled once, from its left side.
    after = cell(col + 1, F.col("_v"), none, F.when(F.col("_nc") == col + 2, F.col("_nv")), False)
    before = cell(col - 1, none, none, F.col("_v"), False)
    gap_after = F.col("_nc").isNull() | (F.col("_nc") > col + 1)
    gap_before = F.col("_pc").isNull() | (F.col("_pc") < col - 2)
    placed = lined.withColumn("_p", F.explode(
        F.when(gap_after & gap_before, F.array(here, after, before))
        .when(gap_after, F.array(here, after))
        .when(gap_before, F.array(here, before))
        .otherwise(F.array(here))
    )).select(
        "br", "bc", "row_idx", *others, "core",
        F.col("_p.c").alias("col_idx"), F.col("_p.w").alias("_w"), F.col("_p.v").alias("_c"),
        F.col("_p.e").alias("_e"), F.col("_p.real").alias("_real"),
    )
    column = Line("row_idx")
    tall = placed.withColumns({
        "_nw": column.adjacent("_w", -1), "_n": column.adjacent("_c", -1), "_ne": column.adjacent("_e", -1),
        "_sw": column.adjacent("_w", 1), "_s": column.adjacent("_c", 1), "_se": column.adjacent("_e", 1),
    }).where("core AND _real")
    z = lambda n: F.coalesce(F.col(n), F.col("_c"))
    gx: Column = ((z("_ne") + 2 * z("_e") + z("_se")) - (z("_nw") + 2 * z("_w") + z("_sw"))) / (8 * px_x)
    gy: Column = ((z("_sw") + 2 * z("_s") + z("_se")) - (z("_nw") + 2 * z("_n") + z("_ne"))) / (8 * px_y)
    steep = F.when(F.col("_c").isNotNull(), F.degrees(F.atan(F.sqrt(gx * gx + gy * gy) * z_factor)))
    return tall.select("row_idx", "col_idx", *others, steep.alias(name))


def dtm(
    pixels: DataFrame, px_x: float = 1.0, px_y: float = 1.0, limit: float = GROUND_SLOPE,
    masked: str = "zero", block: int = BLOCK,
) -> DataFrame:
    """Add ground elevation ``dtm`` to pixels with dsm and mask: flat enough and not a building."""
    sloped = slope(pixels, "dsm", px_x, px_y, block=block)
    ground = slope_filter(F.col("slope"), F.col("dsm"), limit)
    return sloped.withColumn("dtm", mask_buildings(ground, F.col("mask"), masked))
