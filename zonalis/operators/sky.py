"""Sky view factor from a surface model: horizon angles along the eight lattice directions.

What hides the sky from a pixel in one direction is the steepest line of sight to a pixel ahead, and
that touches the upper hull of the pixels ahead. The hull runs along a line of pixels as a stack:
a vertex that a later pixel sees below the next one is never seen again. Lines are cut into blocks.
A block hands on the part of its hull that rises away from the viewer, up to its peak; what lies
behind the peak is hidden. The hulls of a line pass through one task, farthest first, and a block is
sent the hull of all that is ahead of it; the task keeps that hull and no more of the line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.blocks import BLOCK
from zonalis.operators.grid import assign_cells
from zonalis.schemas import Georef, GridSpec

# Families of lines by the steps of row and column along them.
FAMILIES = ((0, 1), (1, 0), (1, 1), (1, -1))
HULLS = "family INT, sense INT, line BIGINT, br BIGINT, bc BIGINT, pos BIGINT, z DOUBLE, low DOUBLE"
SEEN = "row_idx BIGINT, col_idx BIGINT, sky_view DOUBLE"
HULL_SCHEMA = pa.schema(
    [("family", pa.int32()), ("sense", pa.int32())] + [(c, pa.int64()) for c in ("line", "br", "bc", "pos")]
    + [("z", pa.float64()), ("low", pa.float64())])
# Rows of a batch that is handed on.
ROWS = 10_000


def _lines(z: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block as lines: values (line, place on it), NaN where the line has left, and row and column of each."""
    n = len(z)
    line, place = np.indices((n, n) if family < 2 else (2 * n - 1, n))
    row = line if family == 0 else place
    col = place if family == 0 else line if family == 1 else line + place - (n - 1) if family == 2 else line - place
    inside = (col >= 0) & (col < n)
    return np.where(inside, z[row, np.where(inside, col, 0)], np.nan), row, col


def _line_of(row, col, family: int):
    """Number of the line through a pixel, and the pixel's position on it."""
    return (row, col) if family == 0 else (col, row) if family == 1 else (col - row, row) if family == 2 else (col + row, row)


def horizon(z: np.ndarray, pos: np.ndarray, stack_pos: np.ndarray, stack_z: np.ndarray, depth: np.ndarray):
    """Greatest rise per step to a pixel ahead, for lines (line, place) at positions ``pos`` that grow ahead.

    ``stack_pos``, ``stack_z`` and ``depth`` hold each line's hull of what is ahead of the block,
    farthest first, with room for a vertex per place. They hold the hull with the block in it after.
    """
    lines, places = z.shape
    best = np.zeros((lines, places))
    at = np.arange(lines)
    for k in range(places - 1, -1, -1):
        own, here = z[:, k], pos[:, k]
        known = ~np.isnan(own)
        asked = np.flatnonzero(known & (depth > 1))
        while len(asked):
            d = depth[asked]
            near_z, near = stack_z[asked, d - 1] - own[asked], stack_pos[asked, d - 1] - here[asked]
            far_z, far = stack_z[asked, d - 2] - own[asked], stack_pos[asked, d - 2] - here[asked]
            asked = asked[far_z * near >= near_z * far]
            depth[asked] -= 1
            asked = asked[depth[asked] > 1]
        seen = np.flatnonzero(known & (depth > 0))
        top = depth[seen] - 1
        best[seen, k] = np.maximum((stack_z[seen, top] - own[seen]) / (stack_pos[seen, top] - here[seen]), 0.0)
        add = at[known]
        stack_pos[add, depth[add]], stack_z[add, depth[add]] = here[add], own[add]
        depth[add] += 1
    return best


def _dense(table: pa.Table, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    get = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
    row, col, value = get("row_idx"), get("col_idx"), get("z")
    r0, c0 = int(row[0]) // block * block, int(col[0]) // block * block
    z = np.full((block, block), np.nan)
    z[row - r0, col - c0] = value
    return z, row, col, r0, c0


def _ahead(z: np.ndarray, family: int, sense: int, r0: int, c0: int):
    """Values, positions that grow ahead, and line numbers of a block's lines in one direction."""
    values, row, col = _lines(z, family)
    line, pos = _line_of(row + r0, col + c0, family)
    if sense < 0:
        values, pos = values[:, ::-1], -pos[:, ::-1]
    return values, pos, line[:, 0] if family < 2 else line.max(axis=1)


def _hulls(block: int):
    def hulls(table: pa.Table) -> pa.Table:
        z, _, _, r0, c0 = _dense(table, block)
        parts = []
        for family in range(len(FAMILIES)):
            for sense in (1, -1):
                values, pos, line = _ahead(z, family, sense, r0, c0)
                n, width = values.shape
                stack_pos, stack_z, depth = np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1)), np.zeros(n, np.int64)
                horizon(values, pos, stack_pos, stack_z, depth)
                held = np.arange(width + 1)[None, :] < depth[:, None]
                peak = np.where(held, stack_z, -np.inf).argmax(axis=1)
                # From the peak to the nearest vertex.
                i, j = np.nonzero(held & (np.arange(width + 1)[None, :] >= peak[:, None]))
                low = np.nanmin(np.where(np.isnan(values), np.inf, values), axis=1)
                parts.append((np.full(len(i), family), np.full(len(i), sense), line[i], stack_pos[i, j], stack_z[i, j], low[i]))
        family, sense, line, pos, height, low = (np.concatenate(x) for x in zip(*parts))
        k = len(line)
        return pa.table({
            "family": pa.array(family, pa.int32()), "sense": pa.array(sense, pa.int32()), "line": pa.array(line, pa.int64()),
            "br": pa.array(np.full(k, r0 // block), pa.int64()), "bc": pa.array(np.full(k, c0 // block), pa.int64()),
            "pos": pa.array(pos, pa.int64()), "z": pa.array(height), "low": pa.array(low),
        })

    return hulls


def _hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is ahead of each block: the rising hull of all blocks farther on.

    Rows come line by line, farthest first.
    """
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), HULL_SCHEMA)], schema=HULL_SCHEMA)
    out, hull, line, here = [], [], None, None
    for batch in batches:
        for family, sense, number, br, bc, pos, z, low in zip(*(batch.column(c).to_pylist() for c in HULL_SCHEMA.names)):
            if (family, sense, number) != line:
                line, hull, here = (family, sense, number), [], None
            if (br, bc) != here:
                here = (br, bc)
                # The part of the hull that rises towards its peak, as far as it is above the block's lowest pixel.
                peak = max(range(len(hull)), key=lambda k: hull[k][1], default=0)
                hull = hull[peak:]
                for p, h in hull:
                    if h > low:
                        out.append((family, sense, number, br, bc, p, h, low))
                        if len(out) == ROWS:
                            yield pack(out)
                            out = []
            while len(hull) > 1 and (hull[-2][1] - z) * (hull[-1][0] - pos) >= (hull[-1][1] - z) * (hull[-2][0] - pos):
                hull.pop()
            hull.append((pos, z))
    if out:
        yield pack(out)


def _finish(block: int, px: float):
    def finish(own: pa.Table, ahead: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"row_idx": pa.array([], pa.int64()), "col_idx": pa.array([], pa.int64()), "sky_view": pa.array([], pa.float64())})
        z, row, col, r0, c0 = _dense(own, block)
        get = lambda c: ahead[c].combine_chunks().to_numpy(zero_copy_only=False)
        family_of, sense_of, line_of, pos_of, z_of = (get(c) for c in ("family", "sense", "line", "pos", "z"))
        sky = np.zeros((block, block))
        for family, (down, right) in enumerate(FAMILIES):
            step = px * np.hypot(down, right)
            for sense in (1, -1):
                values, pos, line = _ahead(z, family, sense, r0, c0)
                n, width = values.shape
                mine = np.flatnonzero((family_of == family) & (sense_of == sense))
                # Farthest first on each line.
                mine = mine[np.lexsort((-pos_of[mine], line_of[mine]))]
                sorter = np.argsort(line)
                at = sorter[np.searchsorted(line, line_of[mine], sorter=sorter)]
                turn = np.arange(len(mine)) - np.searchsorted(line_of[mine], line_of[mine])
                room = width + 1 + int(turn.max(initial=-1)) + 1
                stack_pos, stack_z, depth = np.zeros((n, room), np.int64), np.zeros((n, room)), np.zeros(n, np.int64)
                stack_pos[at, turn], stack_z[at, turn] = pos_of[mine], z_of[mine]
                np.maximum.at(depth, at, turn + 1)
                rise = horizon(values, pos, stack_pos, stack_z, depth) / step
                if sense < 0:
                    rise = rise[:, ::-1]
                _, r, c = _lines(z, family)
                inside = (c >= 0) & (c < block)
                sky[r[inside], c[inside]] += 1 / (1 + rise[inside] ** 2)
        return pa.table({
            "row_idx": pa.array(row, pa.int64()), "col_idx": pa.array(col, pa.int64()),
            "sky_view": pa.array(sky[row - r0, col - c0] / (2 * len(FAMILIES))),
        })

    return finish


def sky_view(pixels: DataFrame, geo: Georef, column: str = "dsm", block: int = BLOCK) -> DataFrame:
    """(row_idx, col_idx, sky_view): the share of the sky that a pixel of a surface model sees, 0..1.

    With the horizon angle h in each of the eight lattice directions, at least 0, it is the mean of
    cos(h) squared; the horizon is that of the whole raster, not of a radius. Pixels without a value
    hide nothing and have no row. Pixels are square.
    """
    if geo.px_x != geo.px_y:
        raise ValueError("the sky view needs square pixels")
    known = pixels.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(
        F.expr(f"row_idx div {block}").alias("br"), F.expr(f"col_idx div {block}").alias("bc"),
        "row_idx", "col_idx", F.col(column).cast("double").alias("z"))
    hulls = known.groupBy("br", "bc").applyInArrow(_hulls(block), HULLS)
    ordered = hulls.repartition("family", "sense", "line").sortWithinPartitions("family", "sense", "line", F.desc("pos"))
    ahead = ordered.mapInArrow(_hand_on, HULLS)
    return known.groupBy("br", "bc").cogroup(ahead.groupBy("br", "bc")).applyInArrow(_finish(block, geo.px_x), SEEN)


def sky_view_cells(pixels: DataFrame, geo: Georef, grid: GridSpec, column: str = "dsm", block: int = BLOCK) -> DataFrame:
    """(cell_id, sky_view_factor): the mean sky view of each cell's pixels, as the classifier takes it."""
    return assign_cells(sky_view(pixels, geo, column, block), geo, grid).groupBy("cell_id").agg(F.avg("sky_view").alias("sky_view_factor"))
