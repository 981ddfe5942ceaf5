"""Checks on the set of loaded layers, for many projects at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The layers (name, kind) that each step needs.
REQUIRED_LAYERS = {
    "import": (("rgb", "raster"), ("dsm", "raster"), ("mask", "raster"), ("class", "raster")),
    "surface": (("class", "raster"), ("buildings", "vector")),
    "terrain": (("dsm", "raster"), ("mask", "raster")),
    "distance": (("grid", "vector"), ("mask", "raster")),
    "masked_height": (("dsm", "raster"), ("mask", "raster"), ("grid", "vector")),
    "height": (("grid", "vector"), ("dtm", "raster"), ("dsm", "raster")),
    "albedo": (("grid", "vector"), ("albedo", "raster")),
}


def missing_layers(catalog: DataFrame, steps=tuple(REQUIRED_LAYERS)) -> DataFrame:
    """Layers that a step needs and a project lacks, or holds with another type.

    ``catalog`` has (project_id, load_order, name, type). Each project's names are first reduced to
    one small row, so the required list is compared inside that row.
    """
    wanted = [(step, name, kind) for step in steps for name, kind in REQUIRED_LAYERS[step]]
    names = sorted({name for _, name, _ in wanted})
    held = (
        catalog.where(F.col("name").isin(names) & F.col("type").isin("raster", "vector"))
        .groupBy("project_id")
        .agg(*[
            F.max(F.when((F.col("name") == name) & (F.col("type") == kind), True)).alias(f"{name}_{kind}")
            for name, kind in sorted({(n, k) for _, n, k in wanted})
        ])
    )
    projects = catalog.select("project_id").distinct().join(held, "project_id", "left")
    rows = F.explode(F.array(*[
        F.when(F.col(f"{name}_{kind}").isNull(), F.struct(
            F.lit(step).alias("step"), F.lit(name).alias("name"), F.lit(kind).alias("type")))
        for step, name, kind in wanted
    ]))
    return projects.select("project_id", rows.alias("m")).where("m IS NOT NULL").select("project_id", "m.*")


def require_layers(catalog: DataFrame, step: str) -> DataFrame:
    """Return ``catalog``, or raise naming all layers that its first incomplete project lacks. Reads one row back."""
    lacks = missing_layers(catalog, (step,)).groupBy("project_id").agg(
        F.sort_array(F.collect_list(F.concat_ws(" layer ", "type", "name"))).alias("names"))
    first = lacks.orderBy("project_id").first()
    if first:
        raise ValueError(f"project {first.project_id}: no {', no '.join(first.names)}")
    return catalog


def dedupe_layers(catalog: DataFrame, keep: str = "first") -> DataFrame:
    """One layer per (project, name): the first or the last one loaded."""
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    pick = F.min if keep == "first" else F.max
    best = catalog.groupBy("project_id", "name").agg(
        pick(F.struct("load_order", "type")).alias("_b"))
    return best.select("project_id", "name", "_b.load_order", "_b.type")
