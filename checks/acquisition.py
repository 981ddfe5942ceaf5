"""Tile planning, audit, catalog and tile tables."""

from pyspark.sql import functions as F

from checks.fixtures import AOI, CATALOG, RESPONSE, TILES, read, sql
from checks.registry import query, r6, rounded
from zonalis.schemas import Georef
from zonalis.sources import acquisition, catalog, overlaps, tiles

ENDPOINT, KEY = "https://tiles.example/v1/layers:get", "KEY"

TILE_CTE = f"""
aoi AS ({sql(AOI)}),
box AS (SELECT *, CAST(195.0 AS DOUBLE) / 111320 AS d_lat,
               CAST(195.0 AS DOUBLE) / (CAST(111320.0 AS DOUBLE) * cos(north * CAST(3.141592653589793 AS DOUBLE) / 180)) AS d_lng FROM aoi),
counted AS (SELECT *, CAST(ceil((north - south) / d_lat) AS BIGINT) AS n_lat,
                   CAST(ceil((east - west) / d_lng) AS BIGINT) AS n_lng FROM box),
lat AS (SELECT *, unnest(range(n_lat)) AS i FROM counted),
lng AS (SELECT *, unnest(range(n_lng)) AS j FROM lat),
tile AS (SELECT aoi_id, i * n_lng + j AS tile_ord,
                (north - i * d_lat) - d_lat / 2 AS center_lat, (west + j * d_lng) + d_lng / 2 AS center_lng,
                north - i * d_lat AS top, west + j * d_lng AS "left",
                (north - i * d_lat) - d_lat AS bottom, (west + j * d_lng) + d_lng AS "right" FROM lng),
named AS (SELECT t.*, l.layer_ord, l.layer,
                 l.layer || '_' || regexp_replace(CAST(center_lat AS VARCHAR), '\\.0$', '') || '_'
                   || regexp_replace(CAST(center_lng AS VARCHAR), '\\.0$', '') || '.tif' AS file_name
          FROM tile t CROSS JOIN (VALUES (0, 'dsm'), (1, 'rgb'), (2, 'mask')) l(layer_ord, layer)),
present AS (SELECT * FROM named WHERE (tile_ord + layer_ord) % 5 <> 0)
"""


def _tiles(spark, sf):
    return acquisition.aoi_tiles(read(spark, sf, AOI))


def _manifest(spark, sf):
    return acquisition.tile_manifest(_tiles(spark, sf))


def _present(manifest):
    return manifest.where("(tile_ord + layer_ord) % 5 <> 0")


@query("aoi_tiles", f"""WITH {TILE_CTE} SELECT aoi_id, tile_ord, round(center_lat, 6) AS center_lat,
    round(center_lng, 6) AS center_lng, round(top, 6) AS top, round("left", 6) AS "left",
    round(bottom, 6) AS bottom, round("right", 6) AS "right" FROM tile""")
def aoi_tiles(spark, sf):
    return rounded(_tiles(spark, sf))


@query("aoi_coordinate_text", f"""WITH {TILE_CTE} SELECT aoi_id, min(tile_ord) AS part,
    CASE WHEN min(tile_ord) = 0 THEN 'getCoordinate: ' ELSE '; ' END ||
    string_agg(printf('%.5f,%.5f', center_lat, center_lng), '; ' ORDER BY tile_ord) AS coordinate_text
    FROM tile GROUP BY aoi_id, top""")
def aoi_coordinate_text(spark, sf):
    return acquisition.aoi_coordinate_text(_tiles(spark, sf))


# Fixed value: the request's parameter text.
URL_SQL = f"""'{ENDPOINT}?location.latitude=' || regexp_replace(CAST(center_lat AS VARCHAR), '\\.0$', '')
    || '&location.longitude=' || regexp_replace(CAST(center_lng AS VARCHAR), '\\.0$', '')
    || '&radiusMeters=100&view=FULL_LAYERS&requiredQuality=HIGH&pixelSizeMeters=0.5&key={KEY}'"""


@query("tile_request_urls", f"WITH {TILE_CTE} SELECT aoi_id, tile_ord, {URL_SQL} AS url FROM tile")
def tile_request_urls(spark, sf):
    return acquisition.tile_request_urls(_tiles(spark, sf), ENDPOINT, KEY)


@query("parse_request_urls", f"""WITH {TILE_CTE} SELECT aoi_id, tile_ord, round(center_lat, 6) AS lat,
    round(center_lng, 6) AS lng FROM tile""")
def parse_request_urls(spark, sf):
    urls = acquisition.tile_request_urls(_tiles(spark, sf), ENDPOINT, KEY)
    return acquisition.parse_request_urls(urls).select("aoi_id", "tile_ord", r6("lat").alias("lat"), r6("lng").alias("lng"))


@query("tile_manifest", f"WITH {TILE_CTE} SELECT aoi_id, tile_ord, layer_ord, layer, file_name FROM named")
def tile_manifest(spark, sf):
    return _manifest(spark, sf)


@query("parse_tile_names", f"""WITH {TILE_CTE} SELECT file_name, layer, round(center_lat, 6) AS lat,
    round(center_lng, 6) AS lng FROM named""")
def parse_tile_names(spark, sf):
    names = _manifest(spark, sf).select("file_name")
    other = read(spark, sf, AOI).select(F.explode(F.array(F.lit("dsm_unito.tif"), F.lit("notes.txt"))).alias("file_name"))
    return rounded(acquisition.parse_tile_names(names.unionByName(other)))


@query("fetch_progress", f"""WITH {TILE_CTE} SELECT n.aoi_id, count(*) AS total_files, count(p.file_name) AS processed_files,
    printf('%.2f%%', count(p.file_name) * 100.0::DOUBLE / count(*)) AS progress_text
    FROM named n LEFT JOIN (SELECT DISTINCT file_name FROM present) p USING (file_name) GROUP BY n.aoi_id""")
def fetch_progress(spark, sf):
    manifest = _manifest(spark, sf)
    return acquisition.fetch_progress(manifest, _present(manifest))


@query("missing_tiles", f"""WITH {TILE_CTE} SELECT aoi_id, tile_ord, layer_ord, layer, file_name FROM named
    WHERE file_name NOT IN (SELECT file_name FROM present)""")
def missing_tiles(spark, sf):
    manifest = _manifest(spark, sf)
    return acquisition.missing_tiles(manifest, _present(manifest))


@query("fetch_response_urls", f"""WITH r AS ({sql(RESPONSE)})
    SELECT req_id, layer, json_extract_string(body, '$.' || layer || 'Url') || '&key={KEY}' AS url
    FROM r CROSS JOIN (VALUES ('dsm'), ('rgb'), ('mask')) l(layer)""")
def fetch_response_urls(spark, sf):
    return acquisition.fetch_response_urls(read(spark, sf, RESPONSE), KEY)


REQUIRED_SQL = ", ".join(
    f"('{step}', '{name}', '{kind}')" for step, layers in catalog.REQUIRED_LAYERS.items() for name, kind in layers)


@query("missing_layers", f"""WITH c AS ({sql(CATALOG)}), need(step, name, type) AS (VALUES {REQUIRED_SQL})
    SELECT p.project_id, n.step, n.name, n.type FROM (SELECT DISTINCT project_id FROM c) p CROSS JOIN need n
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.project_id = p.project_id AND c.name = n.name AND c.type = n.type)""")
def missing_layers(spark, sf):
    return catalog.missing_layers(read(spark, sf, CATALOG))


def _dedupe_sql(way):
    return f"""WITH c AS ({sql(CATALOG)}) SELECT project_id, name, load_order, type FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id, name ORDER BY load_order {way}, type {way}) AS rn FROM c)
        WHERE rn = 1"""


@query("dedupe_layers", _dedupe_sql("ASC"))
def dedupe_layers(spark, sf):
    return catalog.dedupe_layers(read(spark, sf, CATALOG), keep="first")


@query("dedupe_layers_last", _dedupe_sql("DESC"))
def dedupe_layers_last(spark, sf):
    return catalog.dedupe_layers(read(spark, sf, CATALOG), keep="last")


PIXEL_CTE = f"""
tile AS ({sql(TILES)}),
flat AS (SELECT *, unnest(data) AS v, unnest(range(len(data))) AS pos FROM tile),
pixel AS (SELECT tile_id, priority, layer, band, row0 + CAST(floor(pos / n_cols) AS BIGINT) AS row_idx,
                 col0 + pos % n_cols AS col_idx, CAST(v AS DOUBLE) AS value FROM flat),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY layer, band, row_idx, col_idx
                       ORDER BY priority DESC, tile_id DESC) AS rn FROM pixel) WHERE rn = 1)
"""


def _pixels(spark, sf):
    return tiles.tiles_to_pixels(read(spark, sf, TILES))


@query("tiles_to_pixels", f"""WITH {PIXEL_CTE} SELECT tile_id, priority, layer, band, row_idx, col_idx,
    round(value, 6) AS value FROM pixel""")
def tiles_to_pixels(spark, sf):
    return rounded(_pixels(spark, sf))


MOSAIC_SQL = f"WITH {PIXEL_CTE} SELECT layer, band, row_idx, col_idx, round(value, 6) AS value FROM won"
FILLED_SQL = f"""WITH {PIXEL_CTE}, top AS (SELECT max(row_idx) AS r FROM pixel)
    SELECT 'dsm' AS layer, 1 AS band, f.row_idx, f.col_idx, round(coalesce(w.value, 0), 6) AS value
    FROM (SELECT i AS row_idx, j AS col_idx FROM (SELECT unnest(range(r + 1)) AS i FROM top) a, range(70) b(j)) f
    LEFT JOIN won w ON w.row_idx = f.row_idx AND w.col_idx = f.col_idx"""


@query("mosaic", MOSAIC_SQL)
def mosaic(spark, sf):
    return rounded(tiles.mosaic(_pixels(spark, sf)))


@query("mosaic_filled", FILLED_SQL)
def mosaic_filled(spark, sf):
    pixels = _pixels(spark, sf)
    n_rows = pixels.agg(F.max("row_idx")).first()[0] + 1
    return rounded(tiles.mosaic(pixels, Georef(0.0, 0.0, 1.0, 1.0, n_rows, 70), fill=0.0))


@query("mosaic_tiles", MOSAIC_SQL)
def mosaic_tiles(spark, sf):
    return rounded(overlaps.mosaic_tiles(read(spark, sf, TILES)))


@query("mosaic_tiles_blocks", MOSAIC_SQL)
def mosaic_tiles_blocks(spark, sf):
    """Overlaps swept in blocks that part the tiles."""
    return rounded(overlaps.mosaic_tiles(read(spark, sf, TILES), block=5))


@query("mosaic_tiles_filled", FILLED_SQL)
def mosaic_tiles_filled(spark, sf):
    table = read(spark, sf, TILES)
    n_rows = table.agg(F.max(F.col("row0") + F.col("n_rows"))).first()[0]
    return rounded(overlaps.mosaic_tiles(table, Georef(0.0, 0.0, 1.0, 1.0, n_rows, 70), fill=0.0, block=16))


@query("pixels_to_tiles", f"""WITH {PIXEL_CTE}, sq AS (SELECT layer, band, CAST(floor(row_idx / 16) AS BIGINT) AS tr,
        CAST(floor(col_idx / 16) AS BIGINT) AS tc, (row_idx % 16) * 16 + col_idx % 16 AS pos, value FROM won),
    tiles AS (SELECT DISTINCT layer, band, tr, tc FROM sq),
    dense AS (SELECT t.layer, t.band, t.tr, t.tc, p.pos, s.value FROM tiles t CROSS JOIN range(256) p(pos)
        LEFT JOIN sq s ON s.layer = t.layer AND s.band = t.band AND s.tr = t.tr AND s.tc = t.tc AND s.pos = p.pos)
    SELECT layer, band, tr * 16 AS row0, tc * 16 AS col0, CAST(count(*) AS INTEGER) AS n_values,
           CAST(count(value) AS INTEGER) AS n_known,
           string_agg(CASE WHEN value IS NULL THEN '-' ELSE CAST(CAST(round(value * 1000, 0) AS BIGINT) AS VARCHAR) END,
                      ',' ORDER BY pos) AS data_text
    FROM dense GROUP BY layer, band, tr, tc""")
def pixels_to_tiles(spark, sf):
    packed = tiles.pixels_to_tiles(tiles.mosaic(_pixels(spark, sf)), tile_size=16)
    text = F.transform("data", lambda v: F.coalesce(
        F.round(v.cast("double") * 1000, 0).cast("bigint").cast("string"), F.lit("-")))
    return packed.select(
        "layer", "band", "row0", "col0", F.size("data").alias("n_values"),
        F.size(F.filter("data", lambda v: v.isNotNull())).alias("n_known"), F.array_join(text, ",").alias("data_text"))


@query("cast_layer_types", f"""WITH {PIXEL_CTE}, two AS (
        SELECT tile_id, row_idx, col_idx, CASE WHEN tile_id % 2 = 0 THEN 'dsm' ELSE 'mask' END AS layer,
               value * 300 AS value FROM pixel)
    SELECT tile_id, row_idx, col_idx, layer,
           CAST(CASE WHEN layer = 'mask' THEN least(greatest(round(value), 0), 255) END AS SMALLINT) AS byte_value,
           round(CAST(CASE WHEN layer = 'dsm' THEN CAST(value AS FLOAT) END AS DOUBLE), 4) AS float_value FROM two""")
def cast_layer_types(spark, sf):
    two = _pixels(spark, sf).select(
        "tile_id", "row_idx", "col_idx", F.when(F.col("tile_id") % 2 == 0, "dsm").otherwise("mask").alias("layer"),
        (F.col("value") * 300).alias("value"))
    out = tiles.cast_layer_types(two)
    return out.select("tile_id", "row_idx", "col_idx", "layer", "byte_value",
                      (F.round(F.col("float_value").cast("double"), 4) + 0.0).alias("float_value"))
