"""Map algebra, focal operators, regions, polygons, grid and zonal statistics."""

import uuid
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from checks.fixtures import CELL_UNEVEN, POLY, PX, PX_HOLES, WIDTH, grid_over, raster, read, sql
from checks.registry import query, r6, rounded
from zonalis.operators import algebra, derive, focal, grid, polygons, regions, zonal
from zonalis.operators.proximity import proximity
from zonalis.functions.scratch import scratch_dir
from zonalis.plans import pipeline
from zonalis.schemas import GridSpec, ensure_column, require_columns
from zonalis.sources import stored, tiles

PX_CTE = f"px AS MATERIALIZED ({sql(PX)})"
HOLES_CTE = f"px AS MATERIALIZED ({sql(PX_HOLES)})"
RECLASS = "CASE WHEN class > 0 AND class <= 5 THEN 1.0::DOUBLE WHEN class > 5 AND class <= 9 THEN 0.0::DOUBLE ELSE CAST(class AS DOUBLE) END"
SURFACE = f"CASE WHEN mask = 1 THEN 2.0::DOUBLE ELSE {RECLASS} END"
CELL_ID = "CAST(floor((row_idx + 0.5) * 0.5 / 5.0) AS BIGINT) * 10 + CAST(floor((col_idx + 0.5) * 0.5 / 5.0) AS BIGINT)"
UNEVEN_ID = "CAST(floor((row_idx + 0.5) * 0.5 / 3.5) AS BIGINT) * 15 + CAST(floor((col_idx + 0.5) * 0.5 / 3.5) AS BIGINT)"


def _slope_cte(z="dsm"):
    near = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}
    picks = ", ".join(f"coalesce({k}.{z}, c.{z}) AS {k}" for k in near)
    joins = " ".join(
        f"LEFT JOIN px {k} ON {k}.row_idx = c.row_idx + ({dr}) AND {k}.col_idx = c.col_idx + ({dc})" for k, (dr, dc) in near.items())
    return f"""
near AS (SELECT c.*, {picks} FROM px c {joins}),
grad AS (SELECT *, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / 4.0::DOUBLE AS gx,
                ((sw + 2 * s + se) - (nw + 2 * n + ne)) / 4.0::DOUBLE AS gy FROM near),
sl AS MATERIALIZED (SELECT *, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM grad),
ground AS MATERIALIZED (SELECT *, CASE WHEN slope <= 5.71 THEN dsm END AS filtered FROM sl)"""


SLOPE_CTE = _slope_cte()
DIST_CTE = """
dist AS MATERIALIZED (SELECT p.row_idx, p.col_idx, sqrt(min((p.row_idx - t.row_idx) * (p.row_idx - t.row_idx)
        + (p.col_idx - t.col_idx) * (p.col_idx - t.col_idx))::DOUBLE) AS distance
    FROM px p CROSS JOIN (SELECT row_idx, col_idx FROM px WHERE mask = 1) t GROUP BY p.row_idx, p.col_idx)"""
REGION_CTE = f"""
m AS MATERIALIZED (SELECT row_idx, col_idx, row_idx * {WIDTH} + col_idx AS id FROM px WHERE mask = 1),
half AS MATERIALIZED (SELECT a.id AS s, b.id AS t FROM m a JOIN m b ON b.row_idx = a.row_idx AND b.col_idx = a.col_idx + 1
    UNION ALL SELECT a.id, b.id FROM m a JOIN m b ON b.row_idx = a.row_idx + 1 AND b.col_idx = a.col_idx),
link AS MATERIALIZED (SELECT s, t FROM half UNION ALL SELECT t, s FROM half),
reach(id, seen) AS (SELECT id, id FROM m UNION SELECT r.id, l.t FROM reach r JOIN link l ON l.s = r.seen),
region AS MATERIALIZED (SELECT m.row_idx, m.col_idx, 1 AS value, c.component_id
    FROM m JOIN (SELECT id, min(seen) AS component_id FROM reach GROUP BY id) c USING (id))"""
EDGE_CTE = """
edge AS MATERIALIZED (
    SELECT g.component_id, g.row_idx, g.col_idx, d.side,
           g.col_idx + d.c1 AS x1, g.row_idx + d.r1 AS y1, g.col_idx + d.c2 AS x2, g.row_idx + d.r2 AS y2
    FROM region g CROSS JOIN (VALUES (0, -1, 0, 0, 0, 1, 0), (1, 0, 1, 1, 0, 1, 1), (2, 1, 0, 1, 1, 0, 1), (3, 0, -1, 0, 1, 0, 0))
         d(side, dr, dc, c1, r1, c2, r2)
    LEFT JOIN region o ON o.row_idx = g.row_idx + d.dr AND o.col_idx = g.col_idx + d.dc
    WHERE o.component_id IS DISTINCT FROM g.component_id)"""


def _surface(px):
    return px.select("row_idx", "col_idx", pipeline.surface_code().alias("surface"))


# --- map algebra -------------------------------------------------------------------------------

@query("reclassify", f"WITH {PX_CTE} SELECT row_idx, col_idx, {RECLASS} AS value FROM px")
def reclassify(spark, sf):
    px, _ = raster(spark, sf)
    return px.select("row_idx", "col_idx", algebra.reclassify(F.col("class")).alias("value"))


@query("reclassify_by_table", f"WITH {PX_CTE} SELECT row_idx, col_idx, {RECLASS} AS value FROM px")
def reclassify_by_table(spark, sf):
    px, _ = raster(spark, sf)
    ranges = spark.createDataFrame(list(algebra.SURFACE_RANGES), "lo DOUBLE, hi DOUBLE, new_val DOUBLE")
    return algebra.reclassify_by_table(px, ranges, "class", "value").select("row_idx", "col_idx", "value")


@query("overlay_buildings", f"WITH {PX_CTE} SELECT row_idx, col_idx, {SURFACE} AS value FROM px")
def overlay_buildings(spark, sf):
    px, _ = raster(spark, sf)
    return px.select("row_idx", "col_idx", pipeline.surface_code().alias("value"))


@query("slope_filter", f"WITH {PX_CTE}, {SLOPE_CTE} SELECT row_idx, col_idx, round(filtered, 6) AS value FROM ground")
def slope_filter(spark, sf):
    px, geo = raster(spark, sf)
    sloped = focal.slope(px.select("row_idx", "col_idx", "dsm"), "dsm", geo.px_x, geo.px_y)
    return sloped.select("row_idx", "col_idx", r6(algebra.slope_filter(F.col("slope"), F.col("dsm"))).alias("value"))


@query("dtm_masked", f"WITH {PX_CTE} SELECT row_idx, col_idx, round(dsm * CAST(mask <> 1 AS INTEGER), 6) AS value FROM px")
def dtm_masked(spark, sf):
    px, _ = raster(spark, sf)
    return px.select("row_idx", "col_idx", r6(algebra.mask_buildings(F.col("dsm"), F.col("mask"))).alias("value"))


@query("raster_product", f"WITH {PX_CTE} SELECT row_idx, col_idx, round(CAST(CAST(dsm * mask AS FLOAT) AS DOUBLE), 6) AS value FROM px")
def raster_product(spark, sf):
    px, _ = raster(spark, sf)
    return px.select("row_idx", "col_idx", r6(algebra.raster_product(F.col("dsm"), F.col("mask"))).alias("value"))


@query("normalize_albedo", f"WITH {PX_CTE} SELECT row_idx, col_idx, round(albedo / 10000, 6) AS value FROM px")
def normalize_albedo(spark, sf):
    px, _ = raster(spark, sf)
    return px.select("row_idx", "col_idx", r6(algebra.normalize_albedo(F.col("albedo"))).alias("value"))


@query("albedo_audit", f"""WITH {PX_CTE} SELECT count(*) AS total, count(albedo) AS normalized,
    count(*) - count(albedo) AS null_rows FROM px""")
def albedo_audit(spark, sf):
    return algebra.albedo_audit(raster(spark, sf)[0], "albedo")


def _long(px):
    """The raster as a pixel table, with the mask layer holding building pixels only."""
    long = px.selectExpr("row_idx", "col_idx", "1 AS band", "stack(3, 'dsm', dsm, 'class', CAST(class AS DOUBLE), "
                         "'mask', CAST(NULLIF(mask, 0) AS DOUBLE)) AS (layer, value)")
    return long.where("layer <> 'mask' OR value IS NOT NULL")


ALIGNED_SQL = f"""WITH {PX_CTE} SELECT row_idx, col_idx, round(dsm, 6) AS dsm,
    CAST(class AS DOUBLE) AS class, CAST(mask AS DOUBLE) AS mask FROM px WHERE mask = 1"""


@query("align_layers", ALIGNED_SQL)
def align_layers(spark, sf):
    return rounded(algebra.align_layers(_long(raster(spark, sf)[0]), ["dsm", "class", "mask"]))


@query("aligned_stored", ALIGNED_SQL)
def aligned_stored(spark, sf):
    """Layers added one after another to a table stored by block, and aligned where they lie."""
    long, name = _long(raster(spark, sf)[0]), f"layers_{uuid.uuid4().hex}"
    for layer in ("dsm", "class", "mask"):
        stored.store_blocks(long.where(F.col("layer") == layer), name, block=32, path=f"{scratch_dir(spark)}/{name}")
    return rounded(stored.align_stored(spark, name, ["dsm", "class", "mask"])).drop("br", "bc")


@query("raster_expr", f"""WITH {PX_CTE} SELECT row_idx, col_idx,
    round(CASE WHEN class > 5 THEN dsm * 2 - albedo / 100 ELSE dsm END, 6) AS value FROM px""")
def raster_expr(spark, sf):
    px, _ = raster(spark, sf)
    out = algebra.raster_expr(px, "value", "CASE WHEN class > 5 THEN dsm * 2 - albedo / 100 ELSE dsm END")
    return out.select("row_idx", "col_idx", r6("value").alias("value"))


@query("drop_zero", f"WITH {PX_CTE} SELECT row_idx, col_idx, mask AS value FROM px WHERE mask <> 0")
def drop_zero(spark, sf):
    px, _ = raster(spark, sf)
    return algebra.drop_zero(px.select("row_idx", "col_idx", F.col("mask").alias("value")))


# --- focal operators ---------------------------------------------------------------------------

SLOPE_SQL = f"{SLOPE_CTE} SELECT row_idx, col_idx, round(slope, 6) AS slope FROM sl"


@query("slope", f"WITH {PX_CTE}, {SLOPE_SQL}")
def slope(spark, sf):
    px, geo = raster(spark, sf)
    return rounded(focal.slope(px.select("row_idx", "col_idx", "dsm"), "dsm", geo.px_x, geo.px_y)).drop("dsm")


@query("slope_holes", f"WITH {HOLES_CTE}, {SLOPE_SQL}")
def slope_holes(spark, sf):
    px, geo = raster(spark, sf, PX_HOLES)
    return rounded(focal.slope(px.select("row_idx", "col_idx", "dsm"), "dsm", geo.px_x, geo.px_y, block=32)).drop("dsm")


@query("dtm", f"""WITH {PX_CTE}, {SLOPE_CTE} SELECT row_idx, col_idx,
    round(filtered * CAST(mask <> 1 AS INTEGER), 6) AS dtm FROM ground""")
def dtm(spark, sf):
    px, geo = raster(spark, sf)
    return rounded(focal.dtm(px.select("row_idx", "col_idx", "dsm", "mask"), geo.px_x, geo.px_y).select(
        "row_idx", "col_idx", "dtm"))


DIST_SQL = f"{DIST_CTE} SELECT row_idx, col_idx, round(distance, 6) AS distance FROM dist"


@query("proximity", f"WITH {PX_CTE}, {DIST_SQL}")
def proximity_query(spark, sf):
    px, geo = raster(spark, sf)
    return rounded(proximity(px, geo))


@query("proximity_holes", f"WITH {HOLES_CTE}, {DIST_SQL}")
def proximity_holes(spark, sf):
    px, geo = raster(spark, sf, PX_HOLES)
    return rounded(proximity(px, geo, block=32))


# --- regions and polygons ----------------------------------------------------------------------

def _buildings(px):
    return algebra.drop_zero(px.select("row_idx", "col_idx", F.col("mask").alias("value")))


@query("building_components", f"WITH RECURSIVE {PX_CTE}, {REGION_CTE} SELECT row_idx, col_idx, value, component_id FROM region")
def building_components(spark, sf):
    px, geo = raster(spark, sf)
    return regions.components(_buildings(px), geo.n_cols)


@query("building_summary", f"""WITH RECURSIVE {PX_CTE}, {REGION_CTE} SELECT component_id, 1 AS value, count(*) AS pixel_count,
    min(row_idx) AS min_row, max(row_idx) AS max_row, min(col_idx) AS min_col, max(col_idx) AS max_col
    FROM region GROUP BY component_id""")
def building_summary(spark, sf):
    px, geo = raster(spark, sf)
    return regions.component_summary(_buildings(px), geo.n_cols, block=32)


@query("component_edges", f"""WITH RECURSIVE {PX_CTE}, {REGION_CTE}, {EDGE_CTE}
    SELECT component_id, row_idx, col_idx, side, x1, y1, x2, y2 FROM edge""")
def component_edges(spark, sf):
    px, geo = raster(spark, sf)
    return regions.component_edges(regions.components(_buildings(px), geo.n_cols))


RING_CTE = """
e AS MATERIALIZED (SELECT *, row_idx * 4294967296 + col_idx * 4 + side AS id,
        count(*) OVER (PARTITION BY component_id, x1, y1) AS n_out,
        count(*) OVER (PARTITION BY component_id, x2, y2) AS n_in FROM edge),
succ AS MATERIALIZED (SELECT a.component_id, a.id, b.id AS nxt, a.side <> b.side AS turns, a.x2, a.y2 FROM e a JOIN e b
    ON b.component_id = a.component_id AND b.x1 = a.x2 AND b.y1 = a.y2 AND (a.n_in = 1 OR b.side = (a.side + 3) % 4)),
walk(start, id, seq) AS (SELECT id, nxt, 1 FROM succ UNION ALL
    SELECT w.start, s.nxt, w.seq + 1 FROM walk w JOIN succ s ON s.id = w.id WHERE w.id > w.start),
ring AS MATERIALIZED (SELECT start AS ring_id, CASE WHEN id = start THEN 0 ELSE seq END AS seq, id FROM walk
    WHERE start IN (SELECT start FROM walk WHERE id = start)),
corner AS MATERIALIZED (SELECT s.component_id, r.ring_id, CAST(r.seq AS BIGINT) AS seq, s.x2 AS x, s.y2 AS y
    FROM ring r JOIN succ s ON s.nxt = r.id WHERE s.turns)"""


@query("component_rings", f"""WITH RECURSIVE {PX_CTE}, {REGION_CTE}, {EDGE_CTE}, {RING_CTE}
    SELECT component_id, ring_id, seq, x, y FROM corner""")
def component_rings(spark, sf):
    px, geo = raster(spark, sf)
    return regions.component_rings(regions.component_edges(regions.components(_buildings(px), geo.n_cols)))


def _wkt_sql(page):
    return f"""WITH RECURSIVE {PX_CTE}, {REGION_CTE}, {EDGE_CTE}, {RING_CTE},
    spot AS (SELECT component_id, ring_id, seq, seq // {page} AS page,
        regexp_replace(CAST(500000 + x * 0.5::DOUBLE AS VARCHAR), '\\.0$', '') || ' '
        || regexp_replace(CAST(4750000 - y * 0.5::DOUBLE AS VARCHAR), '\\.0$', '') AS t FROM corner),
    piece AS (SELECT component_id, ring_id, page, string_agg(t, ', ' ORDER BY seq) AS text, min_by(t, seq) AS head
        FROM spot GROUP BY component_id, ring_id, page)
    SELECT component_id, ring_id, row_number() OVER ring - 1 AS part,
        ring_id <> min(ring_id) OVER (PARTITION BY component_id) AS hole,
        'LINESTRING (' || text || ', ' || coalesce(lead(head) OVER ring, first_value(head) OVER ring) || ')' AS wkt
    FROM piece WINDOW ring AS (PARTITION BY component_id, ring_id ORDER BY page)"""


def _wkt(spark, sf, **page):
    px, geo = raster(spark, sf)
    labelled = regions.components(_buildings(px), geo.n_cols)
    return regions.component_wkt(regions.component_rings(regions.component_edges(labelled)), geo, **page)


@query("component_wkt", _wkt_sql(10_000))
def component_wkt(spark, sf):
    return _wkt(spark, sf)


@query("component_wkt_pages", _wkt_sql(4))
def component_wkt_pages(spark, sf):
    """The same outlines cut after every four unit edges."""
    return _wkt(spark, sf, page=4)


def _polygons_sql(page):
    """Parts of each polygon's text, cut after as many unit edges of a ring."""
    return f"""WITH RECURSIVE {PX_CTE}, {REGION_CTE}, {EDGE_CTE}, {RING_CTE},
    spot AS (SELECT component_id, ring_id, seq, seq // {page} AS page,
        regexp_replace(CAST(500000 + x * 0.5::DOUBLE AS VARCHAR), '\\.0$', '') || ' '
        || regexp_replace(CAST(4750000 - y * 0.5::DOUBLE AS VARCHAR), '\\.0$', '') AS t FROM corner),
    piece AS (SELECT component_id, ring_id, page, string_agg(t, ', ' ORDER BY seq) AS text FROM spot GROUP BY ALL),
    head AS (SELECT component_id, ring_id, min_by(t, seq) AS head FROM spot GROUP BY ALL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY ring_id, page) - 1 AS part,
        row_number() OVER (PARTITION BY component_id ORDER BY ring_id DESC, page DESC) AS back,
        row_number() OVER (PARTITION BY component_id, ring_id ORDER BY page) AS first,
        row_number() OVER (PARTITION BY component_id, ring_id ORDER BY page DESC) AS last FROM piece JOIN head USING (component_id, ring_id))
    SELECT component_id, part, CASE WHEN part = 0 THEN 'POLYGON (' ELSE ', ' END || CASE WHEN first = 1 THEN '(' ELSE '' END || text
        || CASE WHEN last = 1 THEN ', ' || head || ')' ELSE '' END || CASE WHEN back = 1 THEN ')' ELSE '' END AS text FROM numbered"""


def _polygons(spark, sf, **page):
    px, geo = raster(spark, sf)
    labelled = regions.components(_buildings(px), geo.n_cols)
    return regions.component_polygons(regions.component_rings(regions.component_edges(labelled)), geo, **page)


@query("component_polygons", _polygons_sql(10_000))
def component_polygons(spark, sf):
    return _polygons(spark, sf)


@query("component_polygons_pages", _polygons_sql(4))
def component_polygons_pages(spark, sf):
    """The same polygons in parts of four unit edges of a ring."""
    return _polygons(spark, sf, page=4)


@query("component_areas", f"""WITH RECURSIVE {PX_CTE}, {REGION_CTE}, {EDGE_CTE},
    size AS (SELECT component_id, count(*) AS area FROM region GROUP BY component_id),
    around AS (SELECT component_id, count(*) AS perimeter FROM edge GROUP BY component_id)
    SELECT component_id, area, perimeter FROM size JOIN around USING (component_id)""")
def component_areas(spark, sf):
    """Areas by the outline alone; they equal the numbers of pixels."""
    px, geo = raster(spark, sf)
    return regions.component_areas(regions.component_edges(regions.components(_buildings(px), geo.n_cols)))


INSIDE_CTE = f"""
poly AS ({sql(POLY)}), size AS (SELECT max(row_idx) + 1 AS n_rows FROM px),
inside AS MATERIALIZED (
    SELECT p.polygon_id, f.row_idx, f.col_idx FROM poly p JOIN (
        SELECT r AS row_idx, c AS col_idx FROM (SELECT unnest(range(n_rows)) AS r FROM size) a, range({WIDTH}) b(c)) f
      ON f.row_idx + 0.5 >= least(p.y1, p.y2) AND f.row_idx + 0.5 < greatest(p.y1, p.y2)
     AND p.x1 + (f.row_idx + 0.5::DOUBLE - p.y1) * (p.x2 - p.x1) / (p.y2 - p.y1) <= f.col_idx + 0.5
    GROUP BY p.polygon_id, f.row_idx, f.col_idx HAVING count(*) % 2 = 1)"""


@query("rasterize_polygons", f"WITH {PX_CTE}, {INSIDE_CTE} SELECT DISTINCT row_idx, col_idx, 2 AS value FROM inside")
def rasterize_polygons(spark, sf):
    _, geo = raster(spark, sf)
    return polygons.rasterize_polygons(read(spark, sf, POLY), geo)


def _fractions(zone, source):
    share = lambda k: f"round(count(*) FILTER (WHERE surface = {k}) * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE surface IN (0, 1, 2)), 0), 6)"
    return (f"SELECT {zone}, {share(0)} AS perc_impervious, {share(1)} AS perc_pervious, {share(2)} AS perc_buildings "
            f"FROM {source} GROUP BY {zone}")


def _zonal_sql(inside):
    return f"""WITH {PX_CTE}, {inside}, v AS (SELECT i.polygon_id, {SURFACE} AS surface
    FROM inside i JOIN px USING (row_idx, col_idx)), f AS ({_fractions('polygon_id', 'v')})
    SELECT polygon_id, perc_impervious, perc_pervious, perc_buildings
    FROM (SELECT DISTINCT polygon_id FROM poly) p LEFT JOIN f USING (polygon_id)"""


@query("zonal_polygons", _zonal_sql(INSIDE_CTE))
def zonal_polygons(spark, sf):
    px, geo = raster(spark, sf)
    return rounded(polygons.zonal_polygons(read(spark, sf, POLY), _surface(px), geo))


@query("zonal_polygons_cover", _zonal_sql(INSIDE_CTE))
def zonal_polygons_cover(spark, sf):
    px, geo = raster(spark, sf)
    return rounded(polygons.zonal_polygons_cover(read(spark, sf, POLY), polygons.class_counts(_surface(px), geo, block=16)))


# A tenth of the size: most of these lie between pixel centres and have no pixel.
TINY = f"""SELECT polygon_id, edge, x1 / 10 AS x1, y1 / 10 AS y1, x2 / 10 AS x2, y2 / 10 AS y2 FROM ({POLY}) big"""


@query("zonal_polygons_tiny", _zonal_sql(INSIDE_CTE.replace(sql(POLY), sql(TINY))))
def zonal_polygons_tiny(spark, sf):
    px, geo = raster(spark, sf)
    return rounded(polygons.zonal_polygons(read(spark, sf, TINY), _surface(px), geo))


# --- grid --------------------------------------------------------------------------------------

@query("make_grid", f"""WITH {PX_CTE}, n AS (SELECT CAST(ceil((max(row_idx) + 1) * 0.5 / 3.5) AS BIGINT) AS r FROM px)
    SELECT i * 15 + j AS cell_id, i AS cell_row, j AS cell_col, round(500000 + j * 3.5::DOUBLE, 6) AS "left",
           round(4750000 - i * 3.5::DOUBLE, 6) AS top, round(500000 + j * 3.5::DOUBLE + 3.5, 6) AS "right",
           round(4750000 - i * 3.5::DOUBLE - 3.5, 6) AS bottom
    FROM (SELECT unnest(range(r)) AS i FROM n) a, range(15) b(j)""")
def make_grid(spark, sf):
    _, geo = raster(spark, sf)
    return rounded(grid.make_grid(spark, grid_over(geo, CELL_UNEVEN)))


@query("make_grid_tenths", f"""WITH {PX_CTE}, n AS (SELECT (max(row_idx) + 3) // 3 AS r FROM px)
    SELECT i * 34 + j AS cell_id, i AS cell_row, j AS cell_col
    FROM (SELECT unnest(range(r)) AS i FROM n) a, range(34) b(j)""")
def make_grid_tenths(spark, sf):
    """Pixels of 0.1 in cells of 0.3: three to a side, though neither number is exact in binary."""
    _, geo = raster(spark, sf)
    tenths = replace(geo, px_x=0.1, px_y=0.1)
    return grid.make_grid(spark, GridSpec.over(tenths, 0.3)).select("cell_id", "cell_row", "cell_col")


@query("assign_cells_tenths", f"WITH {PX_CTE} SELECT row_idx, col_idx, row_idx // 3 * 34 + col_idx // 3 AS cell_id FROM px")
def assign_cells_tenths(spark, sf):
    px, geo = raster(spark, sf)
    tenths = replace(geo, px_x=0.1, px_y=0.1)
    return grid.assign_cells(px.select("row_idx", "col_idx"), tenths, GridSpec.over(tenths, 0.3))


@query("grid_sink", f"""WITH {PX_CTE}, n AS (SELECT CAST(ceil((max(row_idx) + 1) * 0.5 / 3.5) AS BIGINT) AS r FROM px)
    SELECT i * 15 + j AS cell_id, true AS refused FROM (SELECT unnest(range(r)) AS i FROM n) a, range(15) b(j)""")
def grid_sink(spark, sf):
    """A grid as it is read back after a second write to its place was refused."""
    _, geo = raster(spark, sf)
    path = f"{scratch_dir(spark)}/grid-{uuid.uuid4().hex}"
    cells = grid.make_grid(spark, grid_over(geo, CELL_UNEVEN)).select("cell_id")
    tiles.write_grid(cells, path)
    try:
        tiles.write_grid(cells.limit(1), path)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


@query("ensured_fields", f"WITH {PX_CTE} SELECT row_idx, col_idx, mask, CAST(NULL AS DOUBLE) AS note FROM px")
def ensured_fields(spark, sf):
    """A missing field is added as NULL, a present one stays, and a required one is there."""
    px, _ = raster(spark, sf)
    both = ensure_column(ensure_column(px.select("row_idx", "col_idx", "mask"), "mask", "INT"), "note", "DOUBLE")
    return require_columns(both, "mask", "note")


@query("layer_extent", f"""WITH {PX_CTE}, l AS (SELECT 'dsm' AS layer, row_idx, col_idx FROM px UNION ALL
        SELECT 'mask', row_idx, col_idx FROM px WHERE mask = 1 UNION ALL SELECT 'class', row_idx, col_idx FROM px)
    SELECT layer, 500000 + min(col_idx) * 0.5::DOUBLE AS x_min, 4750000 - (max(row_idx) + 1) * 0.5::DOUBLE AS y_min,
           500000 + (max(col_idx) + 1) * 0.5::DOUBLE AS x_max, 4750000 - min(row_idx) * 0.5::DOUBLE AS y_max
    FROM l GROUP BY layer""")
def layer_extent(spark, sf):
    px, geo = raster(spark, sf)
    return grid.layer_extent(_long(px), geo)


@query("assign_cells", f"WITH {PX_CTE} SELECT row_idx, col_idx, {UNEVEN_ID} AS cell_id FROM px")
def assign_cells(spark, sf):
    px, geo = raster(spark, sf)
    return grid.assign_cells(px.select("row_idx", "col_idx"), geo, grid_over(geo, CELL_UNEVEN))


@query("window_pixels", f"""WITH {PX_CTE} SELECT row_idx, col_idx, round(dsm, 6) AS dsm FROM px
    WHERE 500000 + (col_idx + 0.5) * 0.5 >= 500010.2 AND 500000 + (col_idx + 0.5) * 0.5 < 500031.9
      AND 4750000 - (row_idx + 0.5) * 0.5 <= 4749995.1 AND 4750000 - (row_idx + 0.5) * 0.5 > 4749961.3""")
def window_pixels(spark, sf):
    px, geo = raster(spark, sf)
    out = grid.window_pixels(px, geo, left=500010.2, top=4749995.1, right=500031.9, bottom=4749961.3)
    return out.select("row_idx", "col_idx", r6("dsm").alias("dsm"))


BUILT_CTE = f"""cellpx AS MATERIALIZED (SELECT *, {CELL_ID} AS cell_id, {SURFACE} AS surface FROM px),
built AS (SELECT cell_id, count(*) AS n_built FROM cellpx WHERE mask = 1 GROUP BY cell_id),
cells AS (SELECT DISTINCT cell_id FROM cellpx)"""


def _cellpx(spark, sf):
    px, geo = raster(spark, sf)
    spec = grid_over(geo)
    return grid.assign_cells(px, geo, spec), geo, spec


def _built(pixels):
    return pixels.where("mask = 1").groupBy("cell_id").agg(F.count("*").alias("n_built"))


@query("attach_stats", f"WITH {PX_CTE}, {BUILT_CTE} SELECT cell_id, n_built FROM cells LEFT JOIN built USING (cell_id)")
def attach_stats(spark, sf):
    pixels, _, spec = _cellpx(spark, sf)
    return grid.attach_stats(grid.make_grid(spark, spec).select("cell_id"), _built(pixels))


@query("cells_without_stats", f"WITH {PX_CTE}, {BUILT_CTE} SELECT cell_id FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM built)")
def cells_without_stats(spark, sf):
    pixels, _, spec = _cellpx(spark, sf)
    return grid.cells_without_stats(grid.make_grid(spark, spec).select("cell_id"), _built(pixels))


# --- zonal statistics --------------------------------------------------------------------------

@query("class_fractions", f"WITH {PX_CTE}, {BUILT_CTE} {_fractions('cell_id', 'cellpx')}")
def class_fractions(spark, sf):
    px, geo = raster(spark, sf)
    return rounded(pipeline.surface_fractions(px, geo, grid_over(geo)))


@query("class_fractions_uneven", f"""WITH {PX_CTE}, c AS (SELECT {UNEVEN_ID} AS cell_id, {SURFACE} AS surface FROM px)
    {_fractions('cell_id', 'c')}""")
def class_fractions_uneven(spark, sf):
    px, geo = raster(spark, sf)
    return rounded(pipeline.surface_fractions(px, geo, grid_over(geo, CELL_UNEVEN)))


@query("fraction_summary", f"""WITH {PX_CTE}, {BUILT_CTE}, f AS ({_fractions('cell_id', 'cellpx')}),
    l AS (UNPIVOT f ON perc_impervious, perc_pervious, perc_buildings INTO NAME field VALUE v)
    SELECT field, round(min(v), 6) AS min_value, round(max(v), 6) AS max_value, round(avg(v), 6) AS mean_value,
           count(v) AS n_values FROM l GROUP BY field""")
def fraction_summary(spark, sf):
    px, geo = raster(spark, sf)
    return rounded(zonal.fraction_summary(pipeline.surface_fractions(px, geo, grid_over(geo))))


DIST_CELLS = f"d AS (SELECT {CELL_ID} AS cell_id, distance FROM dist)"


def _distance_cells(spark, sf):
    px, geo = raster(spark, sf)
    spec = grid_over(geo)
    return grid.assign_cells(proximity(px, geo), geo, spec), spec.max_pixels_per_cell(geo)


@query("median_dist", f"""WITH {PX_CTE}, {DIST_CTE}, {DIST_CELLS}
    SELECT cell_id, round(median(CASE WHEN distance <> 0 THEN distance END), 6) AS median_dist FROM d GROUP BY cell_id""")
def median_dist(spark, sf):
    return rounded(zonal.median_dist(*_distance_cells(spark, sf)))


@query("median_dist_large", f"""WITH {PX_CTE}, {DIST_CTE}, {DIST_CELLS}
    SELECT cell_id, round(median(CASE WHEN distance <> 0 THEN distance END), 6) AS median_dist FROM d GROUP BY cell_id""")
def median_dist_large(spark, sf):
    """The plan for zones without a small bound on their pixels."""
    pixels, _ = _distance_cells(spark, sf)
    return rounded(zonal.median_dist(pixels, zonal.BUFFER_PIXELS + 1))


@query("median_dist_floor", f"""WITH {PX_CTE}, {DIST_CTE}, {DIST_CELLS}
    SELECT cell_id, round(coalesce(median(CASE WHEN distance <> 0 THEN distance END), 0.001), 6) AS median_dist FROM d GROUP BY cell_id""")
def median_dist_floor(spark, sf):
    return rounded(zonal.median_dist_floor(*_distance_cells(spark, sf)))


PRODUCT = "CAST(CAST(dsm * mask AS FLOAT) AS DOUBLE)"


def _bounds(geo, spec):
    return (spec.max_pixels_per_cell(geo),)


@query("masked_height_median", f"""WITH {PX_CTE}, {BUILT_CTE}
    SELECT cell_id, round(coalesce(median({PRODUCT}), 0), 6) AS med_median FROM cellpx GROUP BY cell_id""")
def masked_height_median(spark, sf):
    pixels, geo, spec = _cellpx(spark, sf)
    product = algebra.raster_product(F.col("dsm"), F.col("mask"))
    return rounded(zonal.masked_height(pixels, product, "median", *_bounds(geo, spec)))


@query("masked_height_mean", f"""WITH {PX_CTE}, {BUILT_CTE}
    SELECT cell_id, round(coalesce(avg({PRODUCT}), 0), 6) AS med_mean FROM cellpx GROUP BY cell_id""")
def masked_height_mean(spark, sf):
    pixels, geo, spec = _cellpx(spark, sf)
    product = algebra.raster_product(F.col("dsm"), F.col("mask"))
    return rounded(zonal.masked_height(pixels, product, "mean", *_bounds(geo, spec)))


@query("zonal_median", f"WITH {PX_CTE}, {BUILT_CTE} SELECT cell_id, round(median(dsm), 6) AS dsm_median FROM cellpx GROUP BY cell_id")
def zonal_median(spark, sf):
    pixels, geo, spec = _cellpx(spark, sf)
    return rounded(zonal.zonal_median(pixels, F.col("dsm"), "dsm_median", *_bounds(geo, spec)))


@query("zonal_median_large", f"WITH {PX_CTE}, {BUILT_CTE} SELECT cell_id, round(median(dsm), 6) AS dsm_median FROM cellpx GROUP BY cell_id")
def zonal_median_large(spark, sf):
    """The plan for zones without a small bound on their pixels."""
    pixels, _, spec = _cellpx(spark, sf)
    return rounded(zonal.zonal_median(pixels, F.col("dsm"), "dsm_median", zonal.BUFFER_PIXELS + 1))


MODE_SQL = f"""WITH {PX_CTE}, {BUILT_CTE}, n AS (SELECT cell_id, albedo, count(*) AS c FROM cellpx WHERE albedo IS NOT NULL GROUP BY ALL),
    best AS (SELECT cell_id, albedo FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY c DESC, albedo) AS rn FROM n) WHERE rn = 1)
    SELECT cell_id, best.albedo AS albedo_majority FROM cells LEFT JOIN best USING (cell_id)"""


@query("zonal_majority", MODE_SQL)
def zonal_majority(spark, sf):
    pixels, geo, spec = _cellpx(spark, sf)
    return zonal.zonal_majority(pixels, F.col("albedo"), "albedo_majority", spec.max_pixels_per_cell(geo))


@query("zonal_majority_large", MODE_SQL)
def zonal_majority_large(spark, sf):
    """The plan for zones without a small bound on their pixels."""
    pixels, _, _ = _cellpx(spark, sf)
    return zonal.zonal_majority(pixels, F.col("albedo"), "albedo_majority", zonal.BUFFER_PIXELS + 1)


# The pipeline's ground level leaves building pixels out instead of counting them as 0.
PROFILE_CTE = f"""{SLOPE_CTE},
cg AS MATERIALIZED (SELECT *, {CELL_ID} AS cell_id, {SURFACE} AS surface,
        CASE WHEN mask <> 1 THEN filtered END AS dtm FROM ground),
level AS (SELECT cell_id, median(dtm) AS dtm_median, median(dsm) AS dsm_median,
        avg(dsm) FILTER (WHERE mask = 1) AS built FROM cg GROUP BY cell_id),
mode_n AS (SELECT cell_id, albedo, count(*) AS c FROM cg WHERE albedo IS NOT NULL GROUP BY ALL),
mode_1 AS (SELECT cell_id, albedo AS albedo_majority FROM (
        SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY c DESC, albedo) AS rn FROM mode_n) WHERE rn = 1),
frac AS ({_fractions('cell_id', 'cg').replace('round(', '(').replace(', 6)', ')')}),
profile AS MATERIALIZED (SELECT f.*, l.dtm_median, l.dsm_median, m.albedo_majority, l.built - l.dtm_median AS mean_build_height
    FROM frac f JOIN level l USING (cell_id) LEFT JOIN mode_1 m USING (cell_id))"""


def _ground_cells(spark, sf):
    px, geo = raster(spark, sf)
    spec = grid_over(geo)
    ready = px.select("row_idx", "col_idx", "dsm", "mask", "albedo", pipeline.surface_code().alias("surface"))
    ground = focal.dtm(ready, geo.px_x, geo.px_y, masked="null")
    return grid.assign_cells(ground, geo, spec), geo, spec


@query("mean_build_height", f"WITH {PX_CTE}, {PROFILE_CTE} SELECT cell_id, round(mean_build_height, 9) AS mean_build_height FROM profile")
def mean_build_height(spark, sf):
    pixels, geo, spec = _ground_cells(spark, sf)
    return rounded(zonal.mean_build_height(pixels, *_bounds(geo, spec)), 9)


PROFILE_SQL = f"""WITH {PX_CTE}, {PROFILE_CTE} SELECT cell_id, round(perc_impervious, 9) AS perc_impervious,
    round(perc_pervious, 9) AS perc_pervious, round(perc_buildings, 9) AS perc_buildings, round(dtm_median, 9) AS dtm_median,
    round(dsm_median, 9) AS dsm_median, albedo_majority, round(mean_build_height, 9) AS mean_build_height FROM profile"""


@query("cell_profile", PROFILE_SQL)
def cell_profile(spark, sf):
    pixels, geo, spec = _ground_cells(spark, sf)
    return rounded(zonal.cell_profile(pixels, *_bounds(geo, spec)), 9)


@query("cell_profile_large", PROFILE_SQL)
def cell_profile_large(spark, sf):
    """The plan for zones without a small bound on their pixels."""
    pixels, _, _ = _ground_cells(spark, sf)
    return rounded(zonal.cell_profile(pixels, zonal.BUFFER_PIXELS + 1), 9)


@query("roughness_height", f"WITH {PX_CTE}, {PROFILE_CTE} SELECT cell_id, round(dsm_median - dtm_median, 6) + 0.0 AS Height_rou FROM profile")
def roughness_height(spark, sf):
    pixels, geo, spec = _ground_cells(spark, sf)
    return rounded(derive.roughness_height(zonal.cell_profile(pixels, *_bounds(geo, spec))).select("cell_id", "Height_rou"))


@query("roughness_audit", f"""WITH {PX_CTE}, {PROFILE_CTE} SELECT count(*) AS total, count(dsm_median - dtm_median) AS success,
    CAST(0 AS BIGINT) AS error, count(*) - count(dsm_median - dtm_median) AS missing FROM profile""")
def roughness_audit(spark, sf):
    pixels, geo, spec = _ground_cells(spark, sf)
    return derive.roughness_audit(derive.roughness_height(zonal.cell_profile(pixels, *_bounds(geo, spec))))


SPACING_CTE = f"{DIST_CTE}, {DIST_CELLS}, spacing AS (SELECT cell_id, median(CASE WHEN distance <> 0 THEN distance * 0.5 END) AS median_dist FROM d GROUP BY cell_id)"
RATIO = "mean_build_height / greatest(coalesce(median_dist, 1), 1)"


@query("aspect_ratio", f"""WITH {PX_CTE}, {PROFILE_CTE}, {SPACING_CTE} SELECT cell_id, round(median_dist, 9) AS median_dist,
    round(greatest(coalesce(median_dist, 1), 1), 9) AS median_dist_used, round({RATIO}, 9) AS aspect_ratio
    FROM profile LEFT JOIN spacing USING (cell_id)""")
def aspect_ratio(spark, sf):
    px, geo = raster(spark, sf)
    cells = pipeline.cell_statistics(px, geo, grid_over(geo))
    return rounded(cells.select("cell_id", "median_dist", "median_dist_used", "aspect_ratio"), 9)
