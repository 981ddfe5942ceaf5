"""What must not grow with the input on one machine: broadcasts, single tasks, tasks' memory."""

import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from zonalis.operators import lcz, sky
from zonalis.sources import acquisition, overlaps, stored


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_arrived_files_are_not_broadcast(spark):
    """The list of files comes from few areas, so Spark measures it small whatever its length."""
    aoi = spark.range(3).selectExpr("id AS aoi_id", "40D + id AS north", "39.99D + id AS south", "10D AS west", "10.02D AS east")
    manifest = acquisition.tile_manifest(acquisition.aoi_tiles(aoi))
    present = manifest.where("(tile_ord + layer_ord) % 5 <> 0")
    missing = acquisition.missing_tiles(manifest, present.unionByName(present))
    assert "Broadcast" not in _plan(missing)
    names = lambda df: sorted(r.file_name for r in df.collect())
    assert names(missing) == names(manifest.where("(tile_ord + layer_ord) % 5 = 0")) != []
    assert "Broadcast" not in _plan(acquisition.fetch_progress(manifest, present))


def _cells(spark):
    """Valid cells as a small file holds them: in one partition."""
    return spark.range(0, 200, 1, 1).selectExpr(
        "id AS cell_id", "id % 11 / 10D AS sky_view_factor", "IF(id % 3 = 0, NULL, id % 5 / 2D) AS aspect_ratio",
        "CAST(IF(id % 4 = 0, 0, 40) AS DOUBLE) AS building_surface_fraction", "30D AS impervious_surface_fraction",
        "CAST(IF(id % 4 = 0, 70, 30) AS DOUBLE) AS pervious_surface_fraction", "CAST(id % 30 AS DOUBLE) AS height_roughness")


@pytest.mark.parametrize("operator", [lcz.lcz_eligible, lcz.lcz_contributions, lcz.lcz_matches, lcz.lcz_scores, lcz.lcz_all_results])
def test_cells_are_spread_before_they_are_expanded(spark, operator):
    out = operator(_cells(spark))
    own = [len(part) for part in out.rdd.glom().collect()]
    assert len(own) == 4 and min(own) > 0
    assert sum(own) == out.count()


@pytest.mark.parametrize("operator", [lcz.lcz_ranked, lcz.lcz_explain])
def test_cells_are_spread_before_they_are_ranked(spark, operator):
    own = [len(part) for part in operator(_cells(spark)).rdd.glom().collect()]
    assert len(own) == 4 and min(own) > 0


def test_hulls_are_handed_on_without_the_whole_line():
    """Answers come before the line has ended, so that a task never holds all of it."""
    read, n = [0], 400

    def batches():
        for first in range(0, n, 10):
            read[0] += 10
            bc = list(range(n - 1 - first, n - 11 - first, -1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(([0] * 10, [1] * 10, [5] * 10, [0] * 10, bc, bc, [float(b % 7) for b in bc], [-1.0] * 10), sky.HULL_SCHEMA)],
                schema=sky.HULL_SCHEMA)

    rows, after, sky.ROWS, kept = [], [], 50, sky.ROWS
    try:
        for batch in sky._hand_on(batches()):
            after.append(read[0])
            rows += batch.to_pylist()
    finally:
        sky.ROWS = kept
    assert after[0] < n / 2
    # Every block but the last on the line is sent something, and the nearest peak is in it.
    assert {r["bc"] for r in rows} == set(range(n - 1))
    assert all(r["pos"] > r["bc"] for r in rows)


def test_buckets_follow_the_pixels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "BUCKET_PIXELS", 100)
    name = f"t_{uuid.uuid4().hex}"
    long = spark.range(1800).selectExpr(
        "IF(id < 900, 'a', 'b') AS layer", "1 AS band", "id % 900 div 30 AS row_idx", "id % 30 AS col_idx", "double(id) AS value")
    try:
        for layer in ("a", "b"):
            stored.store_blocks(long.where(F.col("layer") == layer), name, block=4, path=str(tmp_path / "t"))
        assert stored.bucket_count(long, name) == 9
        out = stored.align_stored(spark, name, ["a", "b"])
        assert "Exchange" not in _plan(out) and out.rdd.getNumPartitions() == 9
        assert sorted((r.row_idx, r.col_idx, r.b - r.a) for r in out.collect()) == [(r, c, 900.0) for r in range(30) for c in range(30)]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    few = long.limit(10)
    assert stored.bucket_count(few, "none_" + name) == 4


@pytest.mark.parametrize("step", [8, 6])
def test_tiles_are_dealt_out_before_they_are_expanded(spark, monkeypatch, step):
    """Side by side or overlapping, the tiles of one small file are expanded by many tasks."""
    monkeypatch.setattr(overlaps, "TASK_PIXELS", 100)
    table = spark.range(0, 64, 1, 1).selectExpr(
        "id AS tile_id", "'a' AS layer", "1 AS band", "0 AS priority", f"id div 8 * {step} AS row0", f"id % 8 * {step} AS col0",
        "8 AS n_rows", "8 AS n_cols", "array_repeat(float(id), 64) AS data")
    out = overlaps.mosaic_tiles(table)
    side = 7 * step + 8
    assert out.count() == side * side
    own = [len(part) for part in out.rdd.glom().collect()]
    assert sum(own) == side * side and sum(n > 0 for n in own) > 20
