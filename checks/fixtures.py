"""Raster, tile, area, polygon and parameter inputs derived from the given tables.

Each text is one SELECT that both Spark and the SQL oracle run unchanged; ``{name}`` stands for a
given table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonalis.schemas import Georef, GridSpec, georef_of

WIDTH = 100
GEO = dict(x_min=500000.0, y_max=4750000.0, px_x=0.5, px_y=0.5, crs="local")
CELL, CELL_UNEVEN = 5.0, 3.5

PX = f"""
SELECT row_idx, col_idx, mask, class,
       CAST(50 AS DOUBLE) + row_idx * CAST(0.02 AS DOUBLE) + col_idx * CAST(0.01 AS DOUBLE)
         + CASE WHEN mask = 1 THEN CAST(6 + k % 5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS dsm,
       CASE WHEN k % 97 = 0 THEN NULL
            ELSE CAST(1000 + CAST(FLOOR(row_idx / 10) AS BIGINT) * 100 + (k % 3) * 50 AS DOUBLE) END AS albedo
FROM (SELECT k, row_idx, col_idx,
             CASE WHEN (CAST(FLOOR(row_idx / 6) AS BIGINT) + CAST(FLOOR(col_idx / 8) AS BIGINT)) % 4 = 0
                   AND st <> 'P' THEN 1 ELSE 0 END AS mask,
             CAST((k * 7 + row_idx * 3) % 11 AS INT) AS class
      FROM (SELECT o_orderkey AS k, o_orderstatus AS st,
                   CAST(FLOOR(o_orderkey / {WIDTH}) AS BIGINT) AS row_idx, o_orderkey % {WIDTH} AS col_idx
            FROM {{orders}}) a) b
"""

# The same raster with pixels missing here and there.
PX_HOLES = f"SELECT * FROM ({PX}) h WHERE (row_idx * 31 + col_idx) % 53 <> 0"

# A raster of few rows and many columns, with buildings at both ends only.
WIDE = 1500
PX_WIDE = f"""
SELECT row_idx, col_idx,
       CASE WHEN (CAST(FLOOR(row_idx / 6) AS BIGINT) + CAST(FLOOR(col_idx / 8) AS BIGINT)) % 4 = 0
             AND st <> 'P' AND (col_idx < 150 OR col_idx >= 1400) THEN 1 ELSE 0 END AS mask
FROM (SELECT o_orderstatus AS st, CAST(FLOOR(o_orderkey / {WIDE}) AS BIGINT) AS row_idx, o_orderkey % {WIDE} AS col_idx
      FROM {{orders}}) a
"""

# The raster as a tile table holds it: elevation in 32 bits.
PX_STORED = f"""SELECT row_idx, col_idx, mask, class, CAST(CAST(dsm AS FLOAT) AS DOUBLE) AS dsm, albedo FROM ({PX}) s"""

TILES = """
SELECT vec_id AS tile_id, 'dsm' AS layer, 1 AS band, label AS priority,
       CAST(FLOOR(vec_id / 10) AS BIGINT) * 8 AS row0, (vec_id % 10) * 6 AS col0,
       8 AS n_rows, 8 AS n_cols, embedding AS data
FROM {embeddings}
"""

AOI = """
SELECT s_suppkey AS aoi_id,
       CAST(40 AS DOUBLE) + (s_suppkey % 50) * CAST(0.1 AS DOUBLE) AS north,
       CAST(39.99 AS DOUBLE) + (s_suppkey % 50) * CAST(0.1 AS DOUBLE) - (s_suppkey % 4) * CAST(0.01 AS DOUBLE) AS south,
       CAST(10 AS DOUBLE) + (s_suppkey % 90) * CAST(0.2 AS DOUBLE) AS west,
       CAST(10.012 AS DOUBLE) + (s_suppkey % 90) * CAST(0.2 AS DOUBLE) AS east
FROM {supplier}
"""

_CORNERS = ((0, 0), (9.3, 2.1), (3.7, 8.9))
POLY = " UNION ALL ".join(f"""
SELECT s_suppkey AS polygon_id, {i + 1} AS edge,
       CAST((s_suppkey * 13) % 90 AS DOUBLE) + CAST(0.25 AS DOUBLE) + CAST({_CORNERS[i][0]} AS DOUBLE) AS x1,
       CAST((s_suppkey * 7) % 100 AS DOUBLE) + CAST(0.25 AS DOUBLE) + CAST({_CORNERS[i][1]} AS DOUBLE) AS y1,
       CAST((s_suppkey * 13) % 90 AS DOUBLE) + CAST(0.25 AS DOUBLE) + CAST({_CORNERS[(i + 1) % 3][0]} AS DOUBLE) AS x2,
       CAST((s_suppkey * 7) % 100 AS DOUBLE) + CAST(0.25 AS DOUBLE) + CAST({_CORNERS[(i + 1) % 3][1]} AS DOUBLE) AS y2
FROM {{supplier}}""" for i in range(3))

PARAM = """
SELECT k AS cell_id,
       CAST(k % 101 AS DOUBLE) / 100 AS sky_view_factor,
       CAST(p_size AS DOUBLE) / 20 AS aspect_ratio,
       CAST(b AS DOUBLE) AS building_surface_fraction,
       CAST(i AS DOUBLE) AS impervious_surface_fraction,
       CAST(100 - b - i AS DOUBLE) AS pervious_surface_fraction,
       CAST((k * 3) % 40 AS DOUBLE) AS height_roughness,
       CAST(1 + k % 8 AS DOUBLE) AS terrain_roughness,
       CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(600 + (k * 37) % 2000 AS DOUBLE) END AS surface_admittance,
       CAST((k * 11) % 40 AS DOUBLE) / 100 AS surface_albedo,
       CASE WHEN k % 5 = 0 THEN NULL ELSE CAST((k * 17) % 400 AS DOUBLE) END AS anthropogenic_heat
FROM (SELECT k, p_size, b, (k * 7) % (101 - b) AS i
      FROM (SELECT p_partkey AS k, p_size,
                   CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 5 + p_partkey % 60 END AS b FROM {part}) a) t
"""

# Rows that must fail the input check.
PARAM_BAD = f"""
SELECT cell_id, sky_view_factor, aspect_ratio,
       CASE WHEN cell_id % 10 = 7 THEN NULL ELSE building_surface_fraction END AS building_surface_fraction,
       CASE WHEN cell_id % 10 = 3 THEN impervious_surface_fraction + 1 ELSE impervious_surface_fraction END AS impervious_surface_fraction,
       CASE WHEN cell_id % 10 = 5 THEN NULL ELSE pervious_surface_fraction END AS pervious_surface_fraction,
       height_roughness, terrain_roughness, surface_admittance, surface_albedo, anthropogenic_heat
FROM ({PARAM}) p
"""

# Overlapping boxes, some of them partly or wholly off the raster.
BOXES = """
SELECT p_partkey AS box_id,
       CAST(499995 AS DOUBLE) + (p_partkey * 7) % 55 AS x0,
       CAST(4750004 AS DOUBLE) - (p_partkey * 11) % 83 AS y1,
       CAST(499995 AS DOUBLE) + (p_partkey * 7) % 55 + CAST(0.4 AS DOUBLE) + p_size AS x1,
       CAST(4750004 AS DOUBLE) - (p_partkey * 11) % 83 - CAST(0.3 AS DOUBLE) - (p_partkey * 3) % 29 AS y0
FROM {part}
"""

# Ranges by the thousand, which overlap and leave gaps.
RANGES = """
SELECT CAST(45 AS DOUBLE) + (o_orderkey * 37) % 5003 * CAST(0.004 AS DOUBLE) AS lo,
       CAST(45 AS DOUBLE) + (o_orderkey * 37) % 5003 * CAST(0.004 AS DOUBLE) + (o_orderkey % 7) * CAST(0.0015 AS DOUBLE) AS hi,
       CAST(o_orderkey % 911 AS DOUBLE) AS new_val
FROM {orders}
"""

# Parameters that no cell attribute gives, for part of the cells of the raster's grid.
EXTERNAL = """
SELECT p_partkey AS cell_id, CAST(p_partkey % 101 AS DOUBLE) / 100 AS sky_view_factor,
       CAST(1 + p_partkey % 8 AS DOUBLE) AS terrain_roughness
FROM {part} WHERE p_partkey % 3 <> 0
"""

# One project per order, one loaded layer per line.
CATALOG = """
SELECT l_orderkey AS project_id, l_linenumber AS load_order,
       CASE l_suppkey % 8 WHEN 0 THEN 'rgb' WHEN 1 THEN 'dsm' WHEN 2 THEN 'mask' WHEN 3 THEN 'class'
            WHEN 4 THEN 'buildings' WHEN 5 THEN 'grid' WHEN 6 THEN 'dtm' ELSE 'albedo' END AS name,
       CASE WHEN (l_suppkey % 8 IN (4, 5)) <> (l_partkey % 20 = 0) THEN 'vector' ELSE 'raster' END AS type
FROM {lineitem}
"""

RESPONSE = """
SELECT c_custkey AS req_id,
       concat('{{"dsmUrl":"http://t/dsm/', CAST(c_custkey AS VARCHAR(20)),
              '","rgbUrl":"http://t/rgb/', CAST(c_custkey AS VARCHAR(20)),
              '","maskUrl":"http://t/mask/', CAST(c_custkey AS VARCHAR(20)), '"}}') AS body
FROM {customer}
"""

NAMES = dict(orders="orders", embeddings="embeddings", supplier="supplier", part="part",
             lineitem="lineitem", customer="customer")


def read(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a fixture on the tables under ``sf_dir``."""
    used = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in NAMES if "{%s}" % n in text}
    return spark.sql(text, **used)


def sql(text: str) -> str:
    """The fixture as the oracle reads it."""
    return text.format(**NAMES)


def raster(spark: SparkSession, sf_dir: str, text: str = PX) -> tuple[DataFrame, Georef]:
    px = read(spark, sf_dir, text)
    return px, georef_of(px, **GEO)


def grid_over(geo: Georef, size: float = CELL) -> GridSpec:
    return GridSpec.over(geo, size)
