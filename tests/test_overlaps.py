"""The mosaic of tiles against the mosaic of their pixels."""

import random

import pytest
from pyspark.sql import functions as F

from zonalis.schemas import TILES, Georef
from zonalis.sources import overlaps, tiles


def table(spark, seed, n, spread, layers=("a", "b")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        h, w = rng.randint(1, 9), rng.randint(1, 9)
        data = [rng.choice([None, -9999.0, float("nan"), 1.0, 2.5, float(i)]) for _ in range(h * w)]
        rows.append((i, rng.choice(layers), 1, rng.randint(0, 3), rng.randrange(spread), rng.randrange(spread), h, w, data))
    return spark.createDataFrame(rows, TILES)


def rows(df):
    return sorted((r.layer, r.band, r.row_idx, r.col_idx, r.value) for r in df.collect())


@pytest.mark.parametrize("seed,n,spread,block", [(1, 40, 30, 256), (2, 40, 30, 4), (3, 60, 6, 7), (4, 5, 200, 16), (5, 1, 1, 3)])
def test_equals_the_mosaic_of_pixels(spark, seed, n, spread, block):
    some = table(spark, seed, n, spread)
    assert rows(overlaps.mosaic_tiles(some, block=block)) == rows(tiles.mosaic(tiles.tiles_to_pixels(some)))
    frame = Georef(0.0, 0.0, 1.0, 1.0, 23, 19)
    assert rows(overlaps.mosaic_tiles(some, frame, 0.5, block)) == rows(tiles.mosaic(tiles.tiles_to_pixels(some), frame, 0.5))


def test_only_shared_boxes_are_sent(spark):
    """Tiles side by side share nothing; a strip of two columns is all that a shifted one shares."""
    grid = spark.range(9).selectExpr(
        "id AS tile_id", "'a' AS layer", "1 AS band", "0 AS priority", "id div 3 * 8 AS row0", "id % 3 * 8 AS col0",
        "8 AS n_rows", "8 AS n_cols", "array_repeat(float(1), 64) AS data")
    assert overlaps.shared_parts(grid).collect() == []
    shifted = grid.withColumn("col0", F.col("tile_id") % 3 * 6)
    for r in overlaps.shared_parts(shifted).collect():
        assert sum((s.r1 - s.r0) * (s.c1 - s.c0) for s in r.shared) == (16 if r.tile_id % 3 != 1 else 32)


def test_many_small_boxes_become_one(spark):
    big = (0, "a", 1, 0, 0, 0, 100, 100, [0.0] * 10_000)
    small = [(i, "a", 1, 1, 2 * (i % 40), 3 * (i // 40), 1, 1, [float(i)]) for i in range(1, 100)]
    some = spark.createDataFrame([big, *small], TILES)
    assert {r.tile_id: len(r.shared) for r in overlaps.shared_parts(some).collect()}[0] <= overlaps.BOXES
    assert rows(overlaps.mosaic_tiles(some)) == rows(tiles.mosaic(tiles.tiles_to_pixels(some)))


def test_no_tiles(spark):
    none = spark.createDataFrame([], TILES)
    assert overlaps.mosaic_tiles(none).collect() == []
