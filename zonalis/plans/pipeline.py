"""From aligned pixels to classified cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.blocks import BLOCK
from zonalis.functions.scratch import materialize
from zonalis.operators import algebra, derive, focal, grid as cell_grid, lcz, proximity, regrid, zonal
from zonalis.schemas import Georef, GridSpec, require_columns

# Computed percentages add up to 100 only within rounding.
SUM_TOLERANCE = 1e-6


def surface_code(class_code: str = "class", mask: str = "mask"):
    """Surface code of a pixel: reclassified land cover with buildings on top."""
    return algebra.overlay_buildings(algebra.reclassify(F.col(class_code)), F.col(mask))


def surface_fractions(pixels: DataFrame, geo: Georef, grid: GridSpec) -> DataFrame:
    """Share of impervious, pervious and built surface per cell."""
    coded = pixels.select("row_idx", "col_idx", surface_code().alias("surface"))
    return zonal.class_fractions(cell_grid.assign_cells(coded, geo, grid), "surface")


def cell_statistics(pixels: DataFrame, geo: Georef, grid: GridSpec, block: int = BLOCK) -> DataFrame:
    """All cell attributes from aligned pixels (row_idx, col_idx, dsm, mask, class, albedo).

    Pixels are shuffled to their block for the slope, and to their block for the distance. The two
    results meet per cell, not per pixel. The aligned pixels are written once, so that no reader
    repeats the mosaic and the alignment behind them.
    """
    require_columns(pixels, "row_idx", "col_idx", "dsm", "mask", "class", "albedo")
    pixels = materialize(pixels.select("row_idx", "col_idx", "dsm", "mask", "class", "albedo"))
    limit = grid.max_pixels_per_cell(geo)
    ready = pixels.select("row_idx", "col_idx", "dsm", "mask", "albedo", surface_code().alias("surface"))
    ground = focal.dtm(ready, geo.px_x, geo.px_y, masked="null", block=block)
    profile = zonal.cell_profile(cell_grid.assign_cells(ground, geo, grid), limit)
    distance = proximity.proximity(pixels, geo, units="map", block=block)
    spacing = zonal.median_dist(cell_grid.assign_cells(distance, geo, grid), limit)
    cells = cell_grid.make_grid(pixels.sparkSession, grid).select("cell_id", "cell_row", "cell_col")
    stats = cell_grid.attach_stats(cell_grid.attach_stats(cells, profile), spacing)
    return derive.aspect_ratio(derive.roughness_height(stats))


def classifier_parameters(cells: DataFrame) -> DataFrame:
    """Cell attributes under the names the classifier knows."""
    return cells.withColumns({
        "building_surface_fraction": F.col("perc_buildings"),
        "impervious_surface_fraction": F.col("perc_impervious"),
        "pervious_surface_fraction": F.col("perc_pervious"),
        "height_roughness": F.col("Height_rou"),
        "surface_albedo": algebra.normalize_albedo(F.col("albedo_majority")),
    })


def lcz_grid(
    pixels: DataFrame, geo: Georef, grid: GridSpec, external: DataFrame | None = None, block: int = BLOCK,
) -> DataFrame:
    """Every cell of the grid with its attributes and its climate zone."""
    cells = classifier_parameters(cell_statistics(pixels, geo, grid, block))
    if external is not None:
        cells = lcz.attach_parameters(cells, external)
    return lcz.lcz_describe(lcz.lcz_classify(cells, SUM_TOLERANCE))


def lcz_grid_from_layers(
    layers: dict[str, tuple[DataFrame, Georef, str]], target: Georef, grid: GridSpec,
    external: DataFrame | None = None, block: int = BLOCK,
) -> DataFrame:
    """The same from layers dsm, mask, class and albedo, each (pixels, lattice, regridding method)."""
    return lcz_grid(regrid.align_regridded(layers, target), target, grid, external, block)
