"""Exact Euclidean distance from every pixel to the nearest target pixel.

The transform is separable (Felzenszwalb and Huttenlocher 2012): first the distance to the nearest
target in the pixel's own column, then the best column along its row. Both steps are cut into square
blocks so that no task ever holds a whole row or column of a large raster:

1. what a block needs to know of its columns beyond its borders is one target row above and one
   below per column, found by a running last value over a table of one row per block column;
2. what it needs to know of its rows is the lower envelope of the other blocks' parabolas where it
   crosses the block. Envelopes merge: of two neighbouring stretches of columns the left one wins up
   to a single place. They are combined in a tree over the block columns; a stretch hands up only
   what wins beyond its own ends, and a block is sent only the intervals that meet it;
3. with both, a block is finished on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonalis.functions.blocks import BLOCK, add_block
from zonalis.functions.ranges import explode_range, lattice
from zonalis.schemas import Georef

FAR = np.int64(1) << 30          # farther than any index
NEVER = np.int64(1) << 60        # squared distance of "no target"
# A parabola on its way up the tree (``up``, with the stretch that it left and the side) or for a block.
PARABOLAS = "up BOOLEAN, br BIGINT, unit BIGINT, row_idx BIGINT, toward INT, col_idx BIGINT, g2 BIGINT"
CARRIES = "block BIGINT, kind INT, row_idx BIGINT, col_idx BIGINT, a BIGINT, b BIGINT"
DISTANCES = "row_idx BIGINT, col_idx BIGINT, distance DOUBLE"
# What a block learns from outside. COLUMN: nearest target rows above (a) and below (b) in a column.
# PARABOLA: a column of the row with squared column distance a.
COLUMN, PARABOLA = 0, 1
# Stretches that meet in one task, and rows of them at the lowest level of the tree.
FAN, MERGE_ROWS = 64, 32


def _numbers(table: pa.Table, name: str, default: int = 0) -> np.ndarray:
    return table[name].combine_chunks().fill_null(default).to_numpy(zero_copy_only=False)


def _column_distance(spots: np.ndarray, known: pa.Table, r0: int, c0: int, block: int) -> np.ndarray:
    """Squared distance to the nearest target in the same column, for each position of the block.

    ``spots`` are the positions of the block's own targets, counted row by row.
    """
    at = np.arange(block, dtype=np.int64)[:, None]
    above = np.full((block, block), -FAR)
    below = np.full((block, block), FAR)
    above.flat[spots] = below.flat[spots] = spots // block
    k = _numbers(known, "kind") == COLUMN
    col = _numbers(known, "col_idx")[k] - c0
    up, down = np.full(block, -FAR), np.full(block, FAR)
    up[col], down[col] = _numbers(known, "a", -FAR)[k] - r0, _numbers(known, "b", FAR)[k] - r0
    above = np.maximum(np.maximum.accumulate(above, axis=0), up)
    below = np.minimum(np.minimum.accumulate(below[::-1], axis=0)[::-1], down)
    g = np.minimum(at - above, below - at)
    return np.where(g < FAR // 2, g * g, NEVER)


def _survivors(g2: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which parabolas can win anywhere beyond a border, scanning away from that border.

    ``reach`` is the distance of each column to the border, growing along the axis. A parabola that
    is not strictly below every nearer one at the border never gets below it farther out.
    """
    at_border = reach * reach + g2
    nearer = np.minimum.accumulate(at_border, axis=1)
    keep = at_border < NEVER
    keep[:, 1:] &= at_border[:, 1:] < nearer[:, :-1]
    return keep


def _row_parabolas(block: int, n_bc: int):
    def parabolas(key: tuple[pa.Scalar, ...], own: pa.Table, known: pa.Table) -> pa.Table:
        br, bc = divmod(key[0].as_py(), n_bc)
        r0, c0 = br * block, bc * block
        g2 = _column_distance(_numbers(own, "spot"), known, r0, c0, block)
        reach = np.arange(1, block + 1, dtype=np.int64)[None, :]
        parts = []
        for toward, view, cols in (
            (1, g2[:, ::-1], c0 + block - 1 - np.arange(block)),
            (-1, g2, c0 + np.arange(block)),
        ):
            i, j = np.nonzero(_survivors(view, reach))
            parts.append((r0 + i, np.full(len(i), toward), cols[j], view[i, j]))
        row, toward, col, best = (np.concatenate(x) for x in zip(*parts))
        return _parabola_table(np.ones(len(row), bool), np.full(len(row), br), np.full(len(row), bc), row, toward, col, best)

    return parabolas


def _parabola_table(up, br, unit, row, toward, col, g2) -> pa.Table:
    long = lambda x: pa.array(np.asarray(x, np.int64))
    return pa.table({
        "up": pa.array(np.asarray(up, bool)), "br": long(br), "unit": long(unit), "row_idx": long(row),
        "toward": pa.array(np.asarray(toward, np.int32)), "col_idx": long(col), "g2": long(g2),
    })


def envelope(sites: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int, int, int]]:
    """(column, offset, first, last) of the parabolas (column, offset), by growing column, that win on low..high.

    Each place has one winner, the smaller column on a tie, so the intervals part low..high.
    """
    won: list[list[int]] = []
    for c, g in sites:
        first = low
        while won:
            top = won[-1]
            # The last place at which the parabola of the smaller column is not above the other.
            last = (c * c - top[0] * top[0] + g - top[1]) // (2 * (c - top[0]))
            if last >= top[2]:
                first = last + 1
                break
            won.pop()
        if first <= high:
            won.append([c, g, first])
    ends = [w[2] - 1 for w in won[1:]] + [high]
    return [(c, g, first, last) for (c, g, first), last in zip(won, ends)]


def _merge_units(block: int, n_blocks: int, fan: int, level: int):
    """Combine the ``fan`` stretches of one parent for some rows: send each what its siblings win in it."""
    width = block * fan ** level
    end = n_blocks * block - 1

    def merge(table: pa.Table) -> pa.Table:
        up = table["up"].combine_chunks().to_numpy(zero_copy_only=False)
        done, rising = table.filter(pa.array(~up)), table.filter(pa.array(up))
        br, unit, row, toward, col, g2 = (_numbers(rising, n) for n in ("br", "unit", "row_idx", "toward", "col_idx", "g2"))
        order = np.lexsort((toward * col, toward * unit, toward, row))
        out: list[tuple[bool, int, int, int, int, int, int]] = []
        lines: dict[tuple[int, int, int], dict[int, list[tuple[int, int]]]] = {}
        for k in order.tolist():
            lines.setdefault((int(br[k]), int(row[k]), int(toward[k])), {}).setdefault(int(unit[k]), []).append(
                (int(toward[k] * col[k]), int(g2[k])))
        for (b, r, way), units in lines.items():
            parent = next(iter(units)) // fan
            last_unit = (n_blocks - 1) // fan ** level
            children = range(parent * fan, min(parent * fan + fan - 1, last_unit) + 1)
            # Leftward the axis is mirrored, so that parabolas always come from smaller places.
            limit = end if way > 0 else 0
            held: list[tuple[int, int]] = []
            for u in children if way > 0 else reversed(children):
                begin, stop = u * width, min(u * width + width - 1, end)
                if way < 0:
                    begin, stop = -stop, -begin
                if held:
                    for c, g, first, last in envelope(held, begin, stop):
                        here = range(first // block, last // block + 1) if way > 0 else range(-last // block, -first // block + 1)
                        out.extend((False, b, bc, r, way, way * c, g) for bc in here)
                own = units.get(u)
                if own or held:
                    held = [x[:2] for x in envelope(held + (own or []), stop + 1, limit)]
            out.extend((True, b, parent, r, way, way * c, g) for c, g in held)
        found = _parabola_table(*(zip(*out) if out else [()] * 7))
        return pa.concat_tables([done.select(found.column_names).cast(found.schema), found])

    return merge


def _finish(block: int, n_bc: int):
    def finish(key: tuple[pa.Scalar, ...], own: pa.Table, known: pa.Table) -> pa.Table:
        br, bc = divmod(key[0].as_py(), n_bc)
        r0, c0 = br * block, bc * block
        spot, hit = _numbers(own, "spot"), _numbers(own, "hit", False)
        g2 = _column_distance(spot[hit], known, r0, c0, block)
        best = g2.copy()
        across = c0 + np.arange(block)
        p = _numbers(known, "kind") == PARABOLA
        row, col, offset = (_numbers(known, n)[p] for n in ("row_idx", "col_idx", "a"))
        # The first parabola of every row at once, then the second, and so on.
        order = np.argsort(row, kind="stable")
        row, col, offset = row[order] - r0, col[order], offset[order]
        turn = np.arange(len(row)) - np.searchsorted(row, row)
        for k in range(int(turn.max(initial=-1)) + 1):
            r, c, g = (x[turn == k] for x in (row, col, offset))
            best[r] = np.minimum(best[r], (across - c[:, None]) ** 2 + g[:, None])
        # Within the block, try columns at growing offsets until none can be nearer.
        for d in range(1, block):
            if d * d >= best.max():
                break
            np.minimum(best[:, d:], g2[:, :-d] + d * d, out=best[:, d:])
            np.minimum(best[:, :-d], g2[:, d:] + d * d, out=best[:, :-d])
        d2 = best.flat[spot]
        return pa.table({
            "row_idx": pa.array(r0 + spot // block, pa.int64()), "col_idx": pa.array(c0 + spot % block, pa.int64()),
            "distance": pa.array(np.sqrt(d2.astype(float)), pa.float64(), mask=d2 >= NEVER),
        })

    return finish


def proximity(
    pixels: DataFrame, geo: Georef, column: str = "mask", target: int = 1,
    units: str = "pixel", block: int = BLOCK, fan: int = FAN,
) -> DataFrame:
    """Distance (row_idx, col_idx, distance) between pixel centres; 0 on targets, NULL without any.

    ``units='map'`` multiplies by the pixel size and needs square pixels. Pixels may be missing.
    """
    if units not in ("pixel", "map"):
        raise ValueError("units is 'pixel' or 'map'")
    if units == "map" and geo.px_x != geo.px_y:
        raise ValueError("map units need square pixels")
    n_br, n_bc = -(-geo.n_rows // block), -(-geo.n_cols // block)
    spark = pixels.sparkSession
    # A pixel travels as its block, its position inside it and whether it is a target.
    placed = pixels.select(
        F.expr(f"row_idx div {block} * {n_bc} + col_idx div {block}").alias("block"),
        F.expr(f"cast(row_idx % {block} * {block} + col_idx % {block} as int)").alias("spot"),
        F.coalesce(F.col(column) == target, F.lit(False)).alias("hit"))
    known = spark.createDataFrame([], CARRIES)
    if n_br > 1:
        known = _nearest_rows(pixels.where(F.col(column) == target), geo, block, n_br, n_bc)
    if n_bc > 1:
        targets = placed.where("hit").select("block", "spot")
        parabolas = targets.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
            _row_parabolas(block, n_bc), PARABOLAS)
        level, n_units = 0, n_bc
        while n_units > 1:
            band = F.expr(f"row_idx div {max(1, MERGE_ROWS // fan ** level)}").alias("band")
            # What is for a block already is dealt along with the rows of its own block column.
            parent = F.expr(f"if(up, unit, unit div {fan ** level}) div {fan}").alias("parent")
            parabolas = parabolas.groupBy(band, parent).applyInArrow(_merge_units(block, n_bc, fan, level), PARABOLAS)
            level, n_units = level + 1, -(-n_units // fan)
        known = known.unionByName(parabolas.where("NOT up").select(
            F.expr(f"br * {n_bc} + unit").alias("block"), F.lit(PARABOLA).alias("kind"), "row_idx", "col_idx",
            F.col("g2").alias("a"), F.lit(None).cast("bigint").alias("b")))
    out = placed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_finish(block, n_bc), DISTANCES)
    return out if units == "pixel" else out.withColumn("distance", F.col("distance") * geo.px_x)


def _nearest_rows(targets: DataFrame, geo: Georef, block: int, n_br: int, n_bc: int) -> DataFrame:
    """For every block and column, the nearest target rows above and below the block."""
    firsts = add_block(targets.select("row_idx", "col_idx"), block).groupBy("br", "bc", "col_idx").agg(
        F.min("row_idx").alias("first"), F.max("row_idx").alias("last"))
    lines = explode_range(
        lattice(targets.sparkSession, n_br, n_bc, "br", "bc"), "col_idx",
        F.col("bc") * block, F.least(F.col("bc") * block + block, F.lit(geo.n_cols)) - 1,
    ).select("br", "bc", "col_idx", *[F.lit(None).cast("bigint").alias(c) for c in ("first", "last")])
    # One row per block and column, partitioned once for the grouping and both windows.
    runs = (
        firsts.unionByName(lines).repartition("col_idx")
        .groupBy("col_idx", "bc", "br").agg(F.max("first").alias("first"), F.max("last").alias("last"))
    )
    by_column = Window.partitionBy("col_idx", "bc")
    before = by_column.orderBy("br").rowsBetween(Window.unboundedPreceding, -1)
    after = by_column.orderBy(F.desc("br")).rowsBetween(Window.unboundedPreceding, -1)
    return runs.select(
        (F.col("br") * n_bc + F.col("bc")).alias("block"), F.lit(COLUMN).alias("kind"),
        F.lit(None).cast("bigint").alias("row_idx"), "col_idx",
        F.last("last", True).over(before).alias("a"), F.last("first", True).over(after).alias("b"),
    ).where("a IS NOT NULL OR b IS NOT NULL")
