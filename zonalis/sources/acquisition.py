"""Plan the tiles that cover an area, name their files, and audit what has arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.ranges import explode_range
from zonalis.functions.text import number_text, percent_text
from zonalis.schemas import require_columns

# Tile side, metres per degree, file layers, request parameters, name pattern.
TILE_SIDE_M = 195.0
METRES_PER_DEGREE = 111320.0
FILE_LAYERS = ("dsm", "rgb", "mask")
FILES_PER_TILE = 3
REQUEST_QUERY = (
    "?location.latitude=%s&location.longitude=%s&radiusMeters=100&view=FULL_LAYERS"
    "&requiredQuality=HIGH&pixelSizeMeters=0.5&key=%s"
)
LATITUDE_IN_URL = r"location\.latitude=([^&]+)"
LONGITUDE_IN_URL = r"location\.longitude=([^&]+)"
FILE_NAME = r"^(dsm|rgb|mask)_(-?[0-9.]+)_(-?[0-9.]+)\.tif$"
COORDINATE_PREFIX = "getCoordinate: "
RESPONSE_URLS = "dsmUrl STRING, rgbUrl STRING, maskUrl STRING"


def aoi_tiles(aoi: DataFrame, size_m: float = TILE_SIDE_M) -> DataFrame:
    """Cover each box (aoi_id, north, south, west, east) with squares, row by row from its NW corner.

    The longitude step uses the latitude of the northern edge, and the last row and column may reach
    beyond the box. Tiles are numbered from 0 within their area.
    """
    require_columns(aoi, "aoi_id", "north", "south", "west", "east")
    boxes = aoi.select(
        "aoi_id", "north", "west",
        F.lit(size_m / METRES_PER_DEGREE).alias("d_lat"),
        (F.lit(size_m) / (F.lit(METRES_PER_DEGREE) * F.cos(F.col("north") * F.lit(3.141592653589793) / 180))).alias("d_lng"),
        "south", "east",
    ).withColumns({
        "n_lat": F.ceil((F.col("north") - F.col("south")) / F.col("d_lat")),
        "n_lng": F.ceil((F.col("east") - F.col("west")) / F.col("d_lng")),
    })
    # One area may own most tiles: its rows of tiles are spread before they are expanded.
    # A count of partitions is given because adaptive execution would merge the short rows again.
    tasks = int(aoi.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = explode_range(boxes, "lat_idx", F.lit(0), F.col("n_lat") - 1).repartition(tasks, "aoi_id", "lat_idx")
    tiles = explode_range(rows, "lng_idx", F.lit(0), F.col("n_lng") - 1)
    top = F.col("north") - F.col("lat_idx") * F.col("d_lat")
    left = F.col("west") + F.col("lng_idx") * F.col("d_lng")
    return tiles.select(
        "aoi_id",
        (F.col("lat_idx") * F.col("n_lng") + F.col("lng_idx")).alias("tile_ord"),
        (top - F.col("d_lat") / 2).alias("center_lat"),
        (left + F.col("d_lng") / 2).alias("center_lng"),
        top.alias("top"), left.alias("left"),
        (top - F.col("d_lat")).alias("bottom"), (left + F.col("d_lng")).alias("right"),
    )


def aoi_coordinate_text(tiles: DataFrame) -> DataFrame:
    """The area's centre coordinates as one line of text, five decimals each, in parts.

    Every area has one part per row of its tiles, named by the number of the row's first tile;
    joining the parts in that order gives the whole line.
    """
    grouped = (
        tiles.groupBy("aoi_id", "top")
        .agg(F.min("tile_ord").alias("part"), F.sort_array(F.collect_list(F.struct(
            "tile_ord", F.format_string("%.5f,%.5f", "center_lat", "center_lng").alias("s")))).alias("c"))
    )
    lead = F.when(F.col("part") == 0, F.lit(COORDINATE_PREFIX)).otherwise(F.lit("; "))
    return grouped.select("aoi_id", "part", F.concat(lead, F.array_join("c.s", "; ")).alias("coordinate_text"))


def tile_request_urls(tiles: DataFrame, endpoint: str, api_key: str) -> DataFrame:
    """The metadata request of each tile. Endpoint and key come from the caller and are not kept."""
    url = F.format_string(
        endpoint.replace("%", "%%") + REQUEST_QUERY,
        number_text(F.col("center_lat")), number_text(F.col("center_lng")), F.lit(api_key),
    )
    return tiles.select("aoi_id", "tile_ord", url.alias("url"))


def tile_manifest(tiles: DataFrame) -> DataFrame:
    """The three files expected for each tile, in download order."""
    files = F.explode(F.array(*[
        F.struct(F.lit(i).alias("layer_ord"), F.lit(layer).alias("layer")) for i, layer in enumerate(FILE_LAYERS)
    ]))
    name = F.concat_ws(
        "_", "f.layer", number_text(F.col("center_lat")), number_text(F.col("center_lng")))
    return tiles.withColumn("f", files).select(
        "aoi_id", "tile_ord", "f.layer_ord", "f.layer", F.concat(name, F.lit(".tif")).alias("file_name"))


def parse_request_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """Read the tile centre back from a request URL."""
    part = lambda pattern: F.regexp_extract(column, pattern, 1).try_cast("double")
    return urls.withColumns({"lat": part(LATITUDE_IN_URL), "lng": part(LONGITUDE_IN_URL)})


def parse_tile_names(files: DataFrame, column: str = "file_name") -> DataFrame:
    """Layer and coordinates from ``layer_lat_lon.tif``; other names, such as merged outputs, drop out."""
    part = lambda i: F.regexp_extract(column, FILE_NAME, i)
    return files.where(F.col(column).rlike(FILE_NAME)).withColumns({
        "layer": part(1), "lat": part(2).cast("double"), "lng": part(3).cast("double")})


def _arrived(present: DataFrame) -> DataFrame:
    """The distinct names of the files that have arrived, for a join by sorting.

    Spark measures a list of files that was made by expanding areas as small as the areas are, and
    would broadcast all of it.
    """
    return present.select("file_name").distinct().hint("merge")


def fetch_progress(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Files received, files expected, and the percentage shown to the user, per area."""
    seen = _arrived(present).withColumn("_seen", F.lit(True))
    counted = manifest.select("aoi_id", "file_name").join(seen, "file_name", "left").groupBy("aoi_id").agg(
        F.count("_seen").alias("processed_files"), F.count("*").alias("total_files"))
    return counted.withColumn("progress_text", percent_text(F.col("processed_files"), F.col("total_files")))


def missing_tiles(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Manifest rows whose file has not arrived."""
    return manifest.join(_arrived(present), "file_name", "left_anti")


def fetch_response_urls(responses: DataFrame, api_key: str, body: str = "body") -> DataFrame:
    """The three download URLs in each metadata response, with the key appended."""
    parsed = responses.withColumn("_r", F.from_json(body, RESPONSE_URLS))
    urls = F.explode(F.array(*[
        F.struct(F.lit(layer).alias("layer"), F.col(f"_r.{layer}Url").alias("url")) for layer in FILE_LAYERS
    ]))
    keyed: Column = F.concat("u.url", F.lit("&key="), F.lit(api_key))
    return parsed.withColumn("u", urls).select("req_id", "u.layer", keyed.alias("url"))
