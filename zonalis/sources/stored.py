"""Pixel tables stored by block, so that layers meet without another shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions.blocks import BLOCK, add_block
from zonalis.operators.algebra import align_layers

BLOCK_KEY = ["br", "bc"]
# Pixels of the first layers in a bucket, on average: one task sorts or aligns a bucket.
BUCKET_PIXELS = 500_000


def bucket_count(pixels: DataFrame, table: str) -> int:
    """The buckets that ``table`` has, or those that a new table needs for ``pixels``."""
    spark = pixels.sparkSession
    if spark.catalog.tableExists(table):
        described = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
        return int(described.data_type)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pixels.count() // BUCKET_PIXELS))


def store_blocks(pixels: DataFrame, table: str, buckets: int | None = None, block: int = BLOCK, path: str | None = None) -> None:
    """Write pixels (layer, band, row_idx, col_idx, value) as a table bucketed and sorted by block, a folder per layer.

    The pixels are shuffled once, here. All layers of one table share its ``buckets``, whenever they
    are added: a later call with the same ``buckets`` and ``block`` appends its layers. Without a
    number, a new table gets as many as there are shuffle partitions, and more where the first
    layers' pixels would be too many for a task; later calls take the table's. So the fullest layer
    comes first. ``path`` puts the files elsewhere than the warehouse.
    """
    if buckets is None:
        buckets = bucket_count(pixels, table)
    placed = add_block(pixels, block).select("layer", "band", *BLOCK_KEY, "row_idx", "col_idx", "value")
    writer = placed.repartition(buckets, *BLOCK_KEY).write.mode("append").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.partitionBy("layer").bucketBy(buckets, *BLOCK_KEY).sortBy(*BLOCK_KEY, "row_idx", "col_idx").saveAsTable(table)


def read_blocks(spark: SparkSession, table: str, layers=None) -> DataFrame:
    """The stored pixels with their block (br, bc); ``layers`` prunes folders."""
    stored = spark.table(table)
    return stored if layers is None else stored.where(F.col("layer").isin(list(layers)))


def align_stored(spark: SparkSession, table: str, layers, band: int = 1, how: str = "inner") -> DataFrame:
    """Like :func:`align_layers`, with the block (br, bc), from a stored table: no shuffle at all.

    What follows by block, such as per-block operators, finds its rows in place too.
    """
    return align_layers(read_blocks(spark, table, layers), layers, band, how, by=(*BLOCK_KEY, "row_idx", "col_idx"))
