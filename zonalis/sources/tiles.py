"""Tile arrays and pixel rows: read, write, cast, mosaic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions.ranges import lattice
from zonalis.schemas import NODATA, TILES, Georef


def clean(value: Column) -> Column:
    """NaN and the nodata code become NULL."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (value != NODATA), value)


def read_tiles(spark: SparkSession, path: str, layers=None) -> DataFrame:
    """Scan a tile table written by :func:`write_tiles`; ``layers`` prunes its partitions."""
    tiles = spark.read.schema(TILES).parquet(path)
    return tiles if layers is None else tiles.where(F.col("layer").isin(list(layers)))


def write_tiles(tiles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a tile table, one folder per layer, neighbouring tiles near each other."""
    tiles.repartitionByRange("layer", "row0", "col0").sortWithinPartitions("layer", "row0", "col0") \
        .write.mode(mode).partitionBy("layer").parquet(path)


def write_grid(cells: DataFrame, path: str) -> None:
    """Write a grid. An existing grid is never replaced."""
    cells.write.mode("errorifexists").parquet(path)


def tiles_to_pixels(tiles: DataFrame, keep=()) -> DataFrame:
    """One row per pixel. Array positions run row by row from the tile's upper-left pixel.

    ``keep`` names further columns of the tile that every pixel carries.
    """
    pixels = tiles.select("*", F.posexplode("data").alias("pos", "v"))
    return pixels.select(
        "tile_id", "priority", "layer", "band",
        (F.col("row0") + F.expr("pos div n_cols")).alias("row_idx"),
        (F.col("col0") + F.expr("pos % n_cols")).alias("col_idx"),
        clean(F.col("v")).alias("value"), *keep,
    )


def pixels_to_tiles(pixels: DataFrame, tile_size: int = 256) -> DataFrame:
    """Pack pixels into square tiles; a group never exceeds ``tile_size`` squared values.

    Positions without a pixel become NULL: every value is preceded by as many NULLs as positions
    were skipped before it.
    """
    n = tile_size * tile_size
    keyed = pixels.select(
        "layer", "band",
        F.expr(f"row_idx div {tile_size}").alias("tr"), F.expr(f"col_idx div {tile_size}").alias("tc"),
        F.expr(f"cast((row_idx % {tile_size}) * {tile_size} + col_idx % {tile_size} as int)").alias("pos"),
        F.col("value").cast("float").alias("v"),
    )
    packed = keyed.groupBy("layer", "band", "tr", "tc").agg(
        F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("p"))
    nothing = F.lit(None).cast("float")
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("p"), i - 1)["pos"])
    filled = F.flatten(F.transform(
        "p", lambda x, i: F.concat(F.array_repeat(nothing, x["pos"] - before(i) - 1), F.array(x["v"]))))
    tail = F.array_repeat(nothing, F.lit(n - 1) - F.element_at("p", -1)["pos"])
    return packed.select(
        # Cantor pairing: one id per tile position without knowing the raster's width.
        F.expr("(tr + tc) * (tr + tc + 1) div 2 + tc").alias("tile_id"),
        "layer", "band", F.lit(0).alias("priority"),
        (F.col("tr") * tile_size).alias("row0"), (F.col("tc") * tile_size).alias("col0"),
        F.lit(tile_size).alias("n_rows"), F.lit(tile_size).alias("n_cols"),
        F.when(F.size("p") == n, F.col("p.v")).otherwise(F.concat(filled, tail)).alias("data"),
    )


def mosaic(pixels: DataFrame, frame: Georef | None = None, fill: float | None = None) -> DataFrame:
    """One value per (layer, band, row, col): the highest (priority, tile_id) that has a value wins.

    With ``frame`` and ``fill``, positions of the frame that no tile covers get ``fill``. The two
    order columns are packed in one decimal so that the aggregation stays a hash aggregation.
    """
    # Twice the span of tile_id, so that any priority step outweighs any tile_id.
    span = F.lit("20000000000000000000").cast("decimal(20,0)")
    order = (F.col("priority").cast("decimal(10,0)") * span + F.col("tile_id").cast("decimal(19,0)")).cast("decimal(38,0)")
    offers = pixels.where("value IS NOT NULL").select(
        "layer", "band", "row_idx", "col_idx", "value", order.alias("_o"))
    if frame is not None and fill is not None:
        lowest = F.lit("-99999999999999999999999999999999999999").cast("decimal(38,0)")
        spark = pixels.sparkSession
        bands = pixels.select("layer", "band").distinct()
        places = lattice(spark, frame.n_rows, frame.n_cols, "row_idx", "col_idx")
        # Layers and bands are a handful; each frame position carries them as one short array.
        named = bands.agg(F.collect_set(F.struct("layer", "band")).alias("b"))
        blank = places.select("row_idx", "col_idx", F.explode(named.scalar()).alias("b")).select(
            "b.layer", "b.band", "row_idx", "col_idx", F.lit(float(fill)).alias("value"), lowest.alias("_o"))
        offers = offers.unionByName(blank)
    return offers.groupBy("layer", "band", "row_idx", "col_idx").agg(F.max_by("value", "_o").alias("value"))


def as_float(value: Column) -> Column:
    """Store as 32-bit float."""
    return value.cast("float")


def as_byte(value: Column) -> Column:
    """Store as unsigned byte: round, then clamp to 0..255."""
    clamped = F.least(F.greatest(F.round(value), F.lit(0.0)), F.lit(255.0))
    return F.when(value.isNotNull(), clamped.cast("short"))


def cast_layer_types(pixels: DataFrame, byte_layers=("rgb", "mask")) -> DataFrame:
    """Add the value as stored: unsigned byte for imagery and masks, 32-bit float for the rest."""
    is_byte = F.col("layer").isin(list(byte_layers))
    return pixels.withColumns({
        "byte_value": F.when(is_byte, as_byte(F.col("value"))),
        "float_value": F.when(~is_byte, as_float(F.col("value"))),
    })
