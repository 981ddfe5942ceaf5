"""Layers of different pixel size and origin, and rasters many blocks wide."""

from dataclasses import replace

from checks.fixtures import BOXES, PX, PX_WIDE, RANGES, WIDTH, raster, read, sql
from checks.raster import DIST_SQL
from checks.registry import query, r6, rounded
from zonalis.operators import algebra, regrid, windows
from zonalis.operators.proximity import proximity

PX_CTE = f"px AS MATERIALIZED ({sql(PX)})"

# Lengths in twentieths of a metre: pixel size, and offset of the layer's corner down and to the right
# of the target's.
TARGET = 15
LATTICES = {"dsm": (10, -4, -6), "class": (16, -12, -12), "albedo": (25, -2, -4)}


def _target(geo):
    """Three pixels of the raster to two of the target's, whose corner lies inside a pixel."""
    return replace(geo, x_min=500000.3, y_max=4749999.8, px_x=0.75, px_y=0.75, n_rows=geo.n_rows * 10 // TARGET, n_cols=66)


def _lattice(geo, name):
    size, down, right = LATTICES[name]
    return replace(geo, x_min=500000.3 + right / 20, y_max=4749999.8 - down / 20, px_x=size / 20, px_y=size / 20)


def _layer(px, geo, name, how):
    return px.select("row_idx", "col_idx", px[name].cast("double").alias("value")), _lattice(geo, name), how


FRAME_CTE = f"""frame AS (SELECT (max(row_idx) + 1) * 10 // {TARGET} AS n_rows FROM px),
jr AS (SELECT unnest(range(n_rows)) AS j FROM frame), jc AS (SELECT unnest(range(66)) AS j),
ir AS (SELECT DISTINCT row_idx AS i FROM px), ic AS (SELECT unnest(range({WIDTH})) AS i)"""


def _axes_sql(name, near=False):
    """Source index, target index and shared length, for both axes."""
    size, down, right = LATTICES[name]
    parts = []
    for axis, offset in (("r", down), ("c", right)):
        low, high = f"({offset} + i * {size})", f"({offset} + (i + 1) * {size})"
        test = f"2 * {low} <= (2 * j + 1) * {TARGET} AND (2 * j + 1) * {TARGET} < 2 * {high}" if near else f"least((j + 1) * {TARGET}, {high}) > greatest(j * {TARGET}, {low})"
        parts.append(f"""{name}_{axis} AS (SELECT i, j, least((j + 1) * {TARGET}, {high}) - greatest(j * {TARGET}, {low}) AS w
            FROM i{axis} CROSS JOIN j{axis} WHERE {test})""")
    return ",\n".join(parts)


def _sent_sql(name):
    return f"""SELECT r.j AS row_idx, c.j AS col_idx, CAST({name} AS DOUBLE) AS v, r.w * c.w AS w
        FROM px JOIN {name}_r r ON r.i = px.row_idx JOIN {name}_c c ON c.i = px.col_idx"""


MEAN_SQL = f"""dsm_on AS (SELECT row_idx, col_idx, sum(v * w) / sum(w) FILTER (WHERE v IS NOT NULL) AS dsm FROM ({_sent_sql('dsm')}) s GROUP BY ALL)"""
MOST_SQL = f"""class_on AS (SELECT row_idx, col_idx, v AS class FROM (
    SELECT *, row_number() OVER (PARTITION BY row_idx, col_idx ORDER BY w DESC, v) AS rn
    FROM (SELECT row_idx, col_idx, v, sum(w) AS w FROM ({_sent_sql('class')}) s GROUP BY ALL) t) u WHERE rn = 1)"""
NEAR_SQL = f"albedo_on AS (SELECT row_idx, col_idx, v AS albedo FROM ({_sent_sql('albedo')}) s)"


@query("align_regridded", f"""WITH {PX_CTE}, {FRAME_CTE}, {_axes_sql('dsm')}, {_axes_sql('class')}, {_axes_sql('albedo', True)},
    {MEAN_SQL}, {MOST_SQL}, {NEAR_SQL}
    SELECT row_idx, col_idx, round(dsm, 6) AS dsm, class, albedo
    FROM dsm_on JOIN class_on USING (row_idx, col_idx) JOIN albedo_on USING (row_idx, col_idx)""")
def align_regridded(spark, sf):
    """Elevation by mean, class by majority and albedo by nearest centre, from three lattices to a fourth."""
    px, geo = raster(spark, sf)
    layers = {name: _layer(px, geo, name, how) for name, how in (("dsm", "mean"), ("class", "majority"), ("albedo", "nearest"))}
    return rounded(regrid.align_regridded(layers, _target(geo)))


@query("regrid_majority", f"""WITH {PX_CTE}, {FRAME_CTE}, {_axes_sql('class')}, {MOST_SQL} SELECT row_idx, col_idx, class FROM class_on""")
def regrid_majority(spark, sf):
    px, geo = raster(spark, sf)
    pixels, lattice, how = _layer(px, geo, "class", "majority")
    return regrid.regrid(pixels.withColumnRenamed("value", "class"), lattice, _target(geo), "class", how)


@query("regrid_covered", f"""WITH {PX_CTE}, {FRAME_CTE}, {_axes_sql('albedo')}
    SELECT row_idx, col_idx, CASE WHEN sum(w) FILTER (WHERE v IS NOT NULL) >= 0.9::DOUBLE * {TARGET * TARGET}
        THEN round(sum(v * w) / sum(w) FILTER (WHERE v IS NOT NULL), 6) END AS albedo
    FROM ({_sent_sql('albedo')}) s GROUP BY row_idx, col_idx""")
def regrid_covered(spark, sf):
    """Area-weighted mean of a layer with gaps, where nine tenths of a pixel are known."""
    px, geo = raster(spark, sf)
    pixels, lattice, how = _layer(px, geo, "albedo", "mean")
    out = regrid.regrid(pixels, lattice, _target(geo), how=how, least_cover=0.9)
    return out.select("row_idx", "col_idx", r6("value").alias("albedo"))


@query("regrid_finer", f"""WITH {PX_CTE} SELECT row_idx * 2 + a AS row_idx, col_idx * 2 + b AS col_idx, round(dsm, 6) AS dsm
    FROM px CROSS JOIN range(2) r(a) CROSS JOIN range(2) c(b)""")
def regrid_finer(spark, sf):
    """Pixels cut in four: every target pixel lies in one source pixel, so nothing is shuffled."""
    px, geo = raster(spark, sf)
    finer = replace(geo, px_x=0.25, px_y=0.25, n_rows=2 * geo.n_rows, n_cols=2 * geo.n_cols)
    return rounded(regrid.regrid(px.select("row_idx", "col_idx", "dsm"), geo, finer, "dsm", "mean"))


@query("proximity_wide", f"WITH px AS MATERIALIZED ({sql(PX_WIDE)}), {DIST_SQL}")
def proximity_wide(spark, sf):
    """47 block columns in a tree of three levels, most of them without a building."""
    px, geo = raster(spark, sf, PX_WIDE)
    return rounded(proximity(px, geo, block=32, fan=4))


@query("proximity_blocks", f"WITH {PX_CTE}, {DIST_SQL}")
def proximity_blocks(spark, sf):
    """13 block columns, and as many block rows as the raster gives."""
    px, geo = raster(spark, sf)
    return rounded(proximity(px, geo, block=8, fan=3))


@query("window_sums", f"""WITH {PX_CTE}, box AS ({sql(BOXES)})
    SELECT box_id, count(albedo) AS albedo_n, round(coalesce(sum(albedo), 0), 9) AS albedo_total, round(avg(albedo), 9) AS albedo_mean,
        count(dsm) AS dsm_n, round(coalesce(sum(dsm), 0), 9) AS dsm_total, round(avg(dsm), 9) AS dsm_mean
    FROM box LEFT JOIN px ON 500000 + (col_idx + 0.5) * 0.5 >= x0 AND 500000 + (col_idx + 0.5) * 0.5 < x1
      AND 4750000 - (row_idx + 0.5) * 0.5 <= y1 AND 4750000 - (row_idx + 0.5) * 0.5 > y0
    GROUP BY box_id""")
def window_sums(spark, sf):
    """Albedo, which has gaps, and elevation in thousands of boxes."""
    px, geo = raster(spark, sf)
    boxes = read(spark, sf, BOXES).withColumnsRenamed({"x0": "left", "x1": "right", "y1": "top", "y0": "bottom"})
    return rounded(windows.window_sums(windows.prefix_sums(px, geo, "albedo", "dsm", block=16), boxes), 9)


@query("reclassify_by_large_table", f"""WITH {PX_CTE}, ranges AS MATERIALIZED ({sql(RANGES)}),
    first AS (SELECT v, new_val FROM (SELECT v, new_val, row_number() OVER (PARTITION BY v ORDER BY lo, hi, new_val) AS rn
        FROM (SELECT DISTINCT dsm AS v FROM px) d JOIN ranges ON v > lo AND v <= hi) r WHERE rn = 1)
    SELECT row_idx, col_idx, round(coalesce(new_val, dsm), 6) AS value FROM px LEFT JOIN first ON dsm = v""")
def reclassify_by_large_table(spark, sf):
    """Elevation classes from as many ranges as there are orders."""
    px, _ = raster(spark, sf)
    out = algebra.reclassify_by_table(px, read(spark, sf, RANGES), "dsm", "value")
    return out.select("row_idx", "col_idx", r6("value").alias("value"))
