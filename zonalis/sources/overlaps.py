"""Mosaic of tiles that sends only the pixels over the cluster that several tiles cover.

A plane sweep over the tiles' extents, which are read without their data, finds what each tile shares
with others. The rest of a tile is nobody else's and passes through where the tile is. Tiles are dealt
out as arrays first, because a small file of them holds pixels for many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.blocks import BLOCK
from zonalis.functions.ranges import explode_range, lattice
from zonalis.schemas import Georef
from zonalis.sources.tiles import clean, tiles_to_pixels

KEY = ("layer", "band")
SWEPT = "layer STRING, band INT, tile_id BIGINT, r0 BIGINT, r1 BIGINT, c0 BIGINT, c1 BIGINT, place INT"
# Boxes of one tile in one block beyond which their bounding box stands for them: a larger box sends
# more pixels than it must, and changes no result.
BOXES = 32
# Pixels of tiles that a task expands, on average.
TASK_PIXELS = 1_000_000


def _shared_boxes(r0, r1, c0, c1) -> list[list[tuple[int, int, int, int]]]:
    """Per extent (ends exclusive) the boxes that it shares with others, none inside another."""
    n = len(r0)
    boxes: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
    order = np.argsort(r0, kind="stable")
    active = np.zeros(0, np.int64)
    for t in order.tolist():
        active = active[r1[active] > r0[t]]
        meets = active[(c0[active] < c1[t]) & (c1[active] > c0[t])]
        for u in meets.tolist():
            box = (int(r0[t]), int(min(r1[t], r1[u])), int(max(c0[t], c0[u])), int(min(c1[t], c1[u])))
            for own in (boxes[t], boxes[u]):
                inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and b[2] <= a[2] and a[3] <= b[3]
                if not any(inside(box, b) for b in own):
                    own[:] = [b for b in own if not inside(b, box)] + [box]
                    if len(own) > BOXES:
                        own[:] = [(min(b[0] for b in own), max(b[1] for b in own), min(b[2] for b in own), max(b[3] for b in own))]
        active = np.append(active, t)
    return boxes


def _sweep(table: pa.Table) -> pa.Table:
    """What the tiles of one layer, band and block share, with each tile's place in the order of their claims."""
    get = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
    priority, tile = get("priority"), get("tile_id")
    place = np.empty(len(tile), np.int32)
    place[np.lexsort((tile, priority))] = np.arange(len(tile))
    at, found = [], []
    for k, boxes in enumerate(_shared_boxes(get("r0"), get("r1"), get("c0"), get("c1"))):
        at.extend([k] * len(boxes))
        found.extend(boxes)
    own = table.take(pa.array(at, pa.int64()))
    sides = np.array(found, np.int64).reshape(-1, 4)
    return pa.table({
        **{c: own[c] for c in ("layer", "band", "tile_id")},
        **{c: pa.array(sides[:, k]) for k, c in enumerate(("r0", "r1", "c0", "c1"))}, "place": pa.array(place[at], pa.int32()),
    })


def _extents(tiles: DataFrame, block: int) -> DataFrame:
    """The part of each tile's extent in each block that it meets, ends exclusive; the data is not read."""
    cut = lambda lo, n, b: (
        F.greatest(F.col(lo), F.col(b) * block), F.least(F.col(lo) + F.col(n), F.col(b) * block + block))
    met = lambda lo, n: F.explode(F.expr(f"sequence({lo} div {block}, ({lo} + {n} - 1) div {block})"))
    placed = tiles.where("n_rows > 0 AND n_cols > 0").select(*KEY, "tile_id", "priority", "row0", "col0", "n_rows", "n_cols")
    placed = placed.withColumn("br", met("row0", "n_rows")).withColumn("bc", met("col0", "n_cols"))
    (r0, r1), (c0, c1) = cut("row0", "n_rows", "br"), cut("col0", "n_cols", "bc")
    return placed.select(*KEY, "tile_id", "priority", "br", "bc", r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1"))


def shared_parts(tiles: DataFrame, block: int = BLOCK) -> DataFrame:
    """(layer, band, tile_id, shared): per tile that overlaps others, the boxes in which it does."""
    swept = _extents(tiles, block).groupBy(*KEY, "br", "bc").applyInArrow(_sweep, SWEPT)
    return swept.groupBy(*KEY, "tile_id").agg(F.collect_list(F.struct("r0", "r1", "c0", "c1", "place")).alias("shared"))


def _gaps(block: int):
    def gaps(table: pa.Table) -> pa.Table:
        """Runs of one block's columns, per row, that no extent covers; the frame is the extent without a tile."""
        frame = table["tile_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        get = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
        r0, r1, c0, c1 = (get(c) for c in ("r0", "r1", "c0", "c1"))
        top, left = r0.min() // block * block, c0.min() // block * block
        count = np.zeros((block + 1, block + 1), np.int32)
        inside = np.zeros((block, block), bool)
        for k in range(len(r0)):
            a, b, c, d = r0[k] - top, r1[k] - top, c0[k] - left, c1[k] - left
            if frame[k]:
                inside[a:b, c:d] = True
            else:
                count[a, c] += 1
                count[b, d] += 1
                count[a, d] -= 1
                count[b, c] -= 1
        bare = inside & (count.cumsum(0).cumsum(1)[:block, :block] == 0)
        edge = np.diff(np.pad(bare, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        head = table.slice(0, 1)
        n = len(row)
        return pa.table({
            "layer": pa.array([head["layer"][0].as_py()] * n, pa.string()), "band": pa.array([head["band"][0].as_py()] * n, pa.int32()),
            "row_idx": pa.array(top + row, pa.int64()), "first": pa.array(left + first, pa.int64()), "last": pa.array(left + end - 1, pa.int64()),
        })

    return gaps


def _bare(tiles: DataFrame, frame: Georef, block: int) -> DataFrame:
    """(layer, band, row_idx, col_idx) of the frame's positions outside all tiles of that layer and band."""
    n_br, n_bc = -(-frame.n_rows // block), -(-frame.n_cols // block)
    named = tiles.select(*KEY).distinct().agg(F.collect_set(F.struct(*KEY)).alias("b"))  # layers and bands are a handful
    blocks = lattice(tiles.sparkSession, n_br, n_bc, "br", "bc").withColumn("b", F.explode(named.scalar()))
    nothing = lambda kind: F.lit(None).cast(kind)
    whole = blocks.select(
        "b.layer", "b.band", nothing("bigint").alias("tile_id"), nothing("int").alias("priority"), "br", "bc",
        (F.col("br") * block).alias("r0"), F.least((F.col("br") + 1) * block, F.lit(frame.n_rows)).alias("r1"),
        (F.col("bc") * block).alias("c0"), F.least((F.col("bc") + 1) * block, F.lit(frame.n_cols)).alias("c1"))
    rows = _extents(tiles, block).unionByName(whole)
    runs = rows.groupBy(*KEY, "br", "bc").applyInArrow(
        _gaps(block), "layer STRING, band INT, row_idx BIGINT, first BIGINT, last BIGINT")
    return explode_range(runs, "col_idx", F.col("first"), F.col("last")).drop("first", "last")


def _dealt(tiles: DataFrame) -> DataFrame:
    """Tiles spread by id over as many tasks as their pixels need; a count stays whatever their bytes are."""
    pixels = tiles.agg(F.sum(F.col("n_rows").cast("bigint") * F.col("n_cols"))).first()[0] or 0
    tasks = max(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pixels // TASK_PIXELS))
    return tiles.repartition(tasks, *KEY, "tile_id")


def mosaic_tiles(tiles: DataFrame, frame: Georef | None = None, fill: float | None = None, block: int = BLOCK) -> DataFrame:
    """One value per (layer, band, row, col): the highest (priority, tile_id) that has a value wins.

    Only pixels in boxes that several tiles cover are shuffled; a tile's other pixels are its own, and
    travel packed in the tile. The tiles' sizes are summed at once, to spread them. With
    ``frame`` and ``fill``, positions of the frame without a value get ``fill``. Tile ids are unique in
    a layer and band. The boxes are joined to the tiles by key, as a broadcast only while Spark
    measures them small.
    """
    joined = _dealt(tiles).join(shared_parts(tiles, block), [*KEY, "tile_id"], "left")
    own = tiles_to_pixels(joined, keep=["shared"])
    within = lambda s: (F.col("row_idx") >= s["r0"]) & (F.col("row_idx") < s["r1"]) & (F.col("col_idx") >= s["c0"]) & (F.col("col_idx") < s["c1"])
    alone = own.where(F.col("shared").isNull() | ~F.exists("shared", within))
    boxes = joined.where("shared IS NOT NULL").select(*KEY, "row0", "col0", "n_cols", "data", F.inline("shared"))
    both = explode_range(boxes, "row_idx", F.col("r0"), F.col("r1") - 1)
    both = explode_range(both, "col_idx", F.col("c0"), F.col("c1") - 1)
    pos = ((F.col("row_idx") - F.col("row0")) * F.col("n_cols") + F.col("col_idx") - F.col("col0")).cast("int")
    claims = both.select(*KEY, "row_idx", "col_idx", clean(F.get("data", pos)).alias("value"), "place")
    place = ["row_idx", "col_idx"]
    settled = claims.groupBy(*KEY, *place).agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("place"))).alias("value"))
    out = alone.select(*KEY, *place, "value").unionByName(settled)
    if frame is None or fill is None:
        return out.where("value IS NOT NULL")
    framed = F.col("row_idx").between(0, frame.n_rows - 1) & F.col("col_idx").between(0, frame.n_cols - 1)
    filled = out.withColumn("value", F.coalesce("value", F.when(framed, F.lit(float(fill))))).where("value IS NOT NULL")
    return filled.unionByName(_bare(tiles, frame, block).withColumn("value", F.lit(float(fill))))
