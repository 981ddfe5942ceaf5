"""Counts, sums and means of any number of boxes, from two-dimensional prefix sums.

The sum over all pixels above and left of a corner is made of four parts: the blocks wholly above and
left of the corner's block, the blocks above it up to the corner's column, the blocks left of it down
to the corner's row, and the corner's own block. Each part is a table of prefix sums, built once in
blocks, and a box is four corners, whatever its size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalis.functions.blocks import BLOCK
from zonalis.functions.ranges import explode_range, lattice
from zonalis.functions.scratch import materialize
from zonalis.functions.skew import lookup
from zonalis.schemas import Georef


@dataclass(frozen=True)
class PrefixSums:
    """Written prefix sums of raster columns: inside blocks, down block columns, along block rows, over blocks.

    Column k has its sums in ``s<k>`` and its counts of known values in ``n<k>``.
    """

    geo: Georef
    block: int
    values: tuple[str, ...]
    inside: DataFrame
    down: DataFrame
    along: DataFrame
    blocks: DataFrame


def _inside(block: int, width: int):
    def sums(table: pa.Table) -> pa.Table:
        """Per row of one block the sums and counts of all pixels not below and not right of each column."""
        get = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
        br, bc = table["br"][0].as_py(), table["bc"][0].as_py()
        row, col = get("row_idx") - br * block, get("col_idx") - bc * block
        out = {
            "br": pa.array([br] * block, pa.int64()), "bc": pa.array([bc] * block, pa.int64()),
            "row_idx": pa.array(br * block + np.arange(block), pa.int64()),
        }
        ends = pa.array(np.arange(block + 1, dtype=np.int32) * block)
        for k in range(width):
            value = get(f"v{k}")
            known = ~np.isnan(value)
            s, n = np.zeros((block, block)), np.zeros((block, block), np.int64)
            np.add.at(s, (row[known], col[known]), value[known])
            np.add.at(n, (row[known], col[known]), 1)
            for name, x in ((f"s{k}", s), (f"n{k}", n)):
                out[name] = pa.ListArray.from_arrays(ends, pa.array(x.cumsum(0).cumsum(1).ravel()))
        return pa.table(out)

    return sums


def prefix_sums(pixels: DataFrame, geo: Georef, *values: str, block: int = BLOCK) -> PrefixSums:
    """Prefix sums of the columns ``values`` over the frame of ``geo``.

    NULL and NaN do not count; pixels may be missing. The pixels are shuffled once, by block. What
    lies outside a corner's own block takes one row per row or column and block. All tables are
    written, so they serve any number of box tables.
    """
    n_br, n_bc = -(-geo.n_rows // block), -(-geo.n_cols // block)
    spark, width = pixels.sparkSession, range(len(values))
    names = [f"{x}{k}" for k in width for x in ("s", "n")]
    placed = pixels.where(
        F.col("row_idx").between(0, geo.n_rows - 1) & F.col("col_idx").between(0, geo.n_cols - 1)
    ).select("row_idx", "col_idx", F.expr(f"row_idx div {block}").alias("br"), F.expr(f"col_idx div {block}").alias("bc"),
             *[F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias(f"v{k}") for k, v in enumerate(values)])
    arrays = ", ".join(f"s{k} ARRAY<DOUBLE>, n{k} ARRAY<BIGINT>" for k in width)
    inside = materialize(placed.groupBy("br", "bc").applyInArrow(
        _inside(block, len(values)), f"br BIGINT, bc BIGINT, row_idx BIGINT, {arrays}"))
    nothing = [F.lit(0.0 if c[0] == "s" else 0).cast("double" if c[0] == "s" else "bigint").alias(c) for c in names]
    every = lattice(spark, n_br, n_bc, "br", "bc")
    before = lambda *group, order: Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda df, w: df.withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in names})
    total = lambda df, *group: df.groupBy(*group).agg(*[F.sum(c).alias(c) for c in names])
    # The last row of a block holds its columns, the last column its rows; empty blocks have zeros.
    columns = inside.where(F.col("row_idx") % block == block - 1).select(
        "br", "bc", F.inline(F.arrays_zip(F.sequence(F.lit(0), F.lit(block - 1)).alias("at"), *names))
    ).toDF("br", "bc", "at", *names).withColumn("col_idx", F.col("bc") * block + F.col("at")).drop("at")
    bare_columns = explode_range(every, "col_idx", F.col("bc") * block, F.col("bc") * block + block - 1).select("br", "bc", "col_idx", *nothing)
    down = running(total(columns.unionByName(bare_columns), "br", "bc", "col_idx"), before("bc", "col_idx", order="br"))
    rows = inside.select("br", "bc", "row_idx", *[F.element_at(c, -1).alias(c) for c in names])
    bare_rows = explode_range(every, "row_idx", F.col("br") * block, F.col("br") * block + block - 1).select("br", "bc", "row_idx", *nothing)
    along = running(total(rows.unionByName(bare_rows), "br", "bc", "row_idx"), before("br", "row_idx", order="bc"))
    # Blocks above and left: what blocks above hold in whole columns, summed over the block columns to the left.
    over = down.where(F.col("col_idx") % block == block - 1).select("br", "bc", *names)
    blocks = running(over, before("br", order="bc"))
    return PrefixSums(geo, block, tuple(values), inside, materialize(down), materialize(along), materialize(blocks))


def box_indices(geo: Georef, left: Column, top: Column, right: Column, bottom: Column) -> dict[str, Column]:
    """First and end row and column of the pixels whose centre lies in a box, inside the frame."""
    cut = lambda x, n: F.least(F.greatest(F.ceil(x - F.lit(0.5)), F.lit(0)), F.lit(n)).cast("bigint")
    across, down = lambda x: (x - F.lit(geo.x_min)) / F.lit(geo.px_x), lambda y: (F.lit(geo.y_max) - y) / F.lit(geo.px_y)
    return {"r0": cut(down(top), geo.n_rows), "r1": cut(down(bottom), geo.n_rows),
            "c0": cut(across(left), geo.n_cols), "c1": cut(across(right), geo.n_cols)}


def sums_in(sums: PrefixSums, boxes: DataFrame) -> DataFrame:
    """(box, s0, n0, s1, ...): sums and counts over the boxes (box, r0, r1, c0, c1), ends exclusive, of each ``box``.

    Boxes lie in the frame; those that share a ``box`` are added up and empty ones have no row. Corners
    that boxes share are looked up once.
    """
    wide, block = sums.geo.n_cols + 1, sums.block
    corner = lambda r, c, sign: F.struct(F.col(r).alias("r"), F.col(c).alias("c"), F.lit(sign).alias("sign"))
    corners = materialize(boxes.where("r0 < r1 AND c0 < c1").select("box", F.inline(F.array(
        corner("r1", "c1", 1), corner("r0", "c1", -1), corner("r1", "c0", -1), corner("r0", "c0", 1)))).where(
        "r > 0 AND c > 0").groupBy("box", (F.col("r") * wide + F.col("c")).alias("point")).agg(F.sum("sign").alias("sign")).where("sign <> 0"))
    # The pixel above and left of the corner, and its block.
    found = corners.select("point").distinct().select(
        "point", F.expr(f"point div {wide}L - 1").alias("row_idx"), F.expr(f"point % {wide}L - 1").alias("col_idx")).withColumns({
            "br": F.expr(f"row_idx div {block}"), "bc": F.expr(f"col_idx div {block}")})
    names = [f"{x}{k}" for k in range(len(sums.values)) for x in ("s", "n")]
    at = F.expr(f"cast(col_idx % {block} as int)")
    for part, table, keys in (
        ("i", sums.inside, ["br", "bc", "row_idx"]), ("d", sums.down, ["br", "bc", "col_idx"]),
        ("a", sums.along, ["br", "bc", "row_idx"]), ("b", sums.blocks, ["br", "bc"]),
    ):
        found = found.join(table.select(*keys, *[F.col(c).alias(f"{part}{c}") for c in names]), keys, "left")
    own = lambda c: F.coalesce(F.get(f"i{c}", at), F.lit(0)) + F.col(f"d{c}") + F.col(f"a{c}") + F.col(f"b{c}")
    values = found.select("point", *[own(c).alias(c) for c in names])
    return lookup(corners, "point", values, corners.count()).groupBy("box").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in names])


def window_sums(sums: PrefixSums, boxes: DataFrame, box_id: str = "box_id") -> DataFrame:
    """(``box_id``, <value>_n, <value>_total, <value>_mean, ...) of each id of ``boxes`` (``box_id``, left, top, right, bottom).

    A box holds the pixels whose centre is not left of ``left`` nor above ``top`` and is left of
    ``right`` and above ``bottom``. Boxes that share an id are added up. Without a known pixel there is
    a count and total of 0 and a NULL mean. Sums are exact to about 1e-16 of the sum over the raster.
    """
    indices = box_indices(sums.geo, *map(F.col, ("left", "top", "right", "bottom")))
    per = sums_in(sums, boxes.select(F.col(box_id).alias("box"), *[c.alias(n) for n, c in indices.items()]))
    whole = boxes.select(F.col(box_id).alias("box")).distinct().join(per, "box", "left")
    out = [F.col("box").alias(box_id)]
    for k, value in enumerate(sums.values):
        n = F.coalesce(f"n{k}", F.lit(0))
        out += [n.alias(f"{value}_n"), F.when(n > 0, F.col(f"s{k}")).otherwise(0.0).alias(f"{value}_total"),
                F.when(n > 0, F.col(f"s{k}") / n).alias(f"{value}_mean")]
    return whole.select(*out)
