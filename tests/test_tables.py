import math

import pytest
from pyspark.sql import functions as F

from zonalis import schemas
from zonalis.functions import counted, scratch, skew, text
from zonalis.functions.ranges import explode_range, lattice
from zonalis.operators import algebra, derive, grid, zonal
from zonalis.sources import acquisition, catalog, tiles
from zonalis.streaming.progress import live_progress


def test_reclass_range_ends(raster):
    px = raster([[0.0, 5.0, 9.0, 10.0, -9999.0, 0.5]], "v", "DOUBLE")
    one = [r.x for r in px.orderBy("col_idx").select(algebra.reclassify(F.col("v")).alias("x")).collect()]
    table = px.sparkSession.createDataFrame(list(algebra.SURFACE_RANGES), "lo DOUBLE, hi DOUBLE, new_val DOUBLE")
    two = [r.x for r in algebra.reclassify_by_table(px, table, "v", "x").orderBy("col_idx").collect()]
    assert one == two == [0.0, 1.0, 0.0, 10.0, None, 1.0]


def test_nan_and_nodata_become_null(spark):
    df = spark.createDataFrame([(math.nan,), (-9999.0,), (0.0,)], "v DOUBLE")
    assert [r.x for r in df.select(tiles.clean(F.col("v")).alias("x")).collect()] == [None, None, 0.0]


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(1, v) for v in (3.0, 2.0, 3.0, 2.0)] + [(2, None)], "cell_id BIGINT, v DOUBLE")
    for bound in (4, zonal.BUFFER_PIXELS + 1):
        got = {r.cell_id: r.m for r in zonal.zonal_majority(df, F.col("v"), "m", bound).collect()}
        assert got == {1: 2.0, 2: None}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_large_median_equals_plain(spark, parts):
    """One hot key over many range partitions, ties around the middle, an empty key, keys of one row."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 10 < 8, 1).otherwise(2 + F.col("id") % 500).cast("bigint").alias("cell_id"),
        F.when(F.col("id") % 3 == 0, 500.0).otherwise((F.col("id") * 7919 % 1000).cast("double")).alias("v"))
    df = df.unionByName(spark.createDataFrame([(-3, None), (-4, -0.5), (-5, 1.0), (-5, 2.0)], "cell_id BIGINT, v DOUBLE"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plain = {r.cell_id: r.m for r in zonal.zonal_median(df, F.col("v"), "m", 10).collect()}
        large = {r.cell_id: r.m for r in zonal.zonal_median(df, F.col("v"), "m", zonal.BUFFER_PIXELS + 1).collect()}
        table = counted.count_values(df, "cell_id", {"v": F.col("v")})
        hot = table.where("cell_id = 1").select("part").distinct().count()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert plain == large and plain[-3] is None and plain[-5] == 1.5
    assert (hot > 1) == (parts > 1)


def test_profile_plans_agree(spark):
    df = spark.range(4000).selectExpr(
        "id % 7 AS cell_id", "CAST(id % 3 AS DOUBLE) AS surface", "CAST(id * 31 % 101 AS DOUBLE) AS dsm",
        "IF(id % 5 = 0, NULL, CAST(id * 17 % 97 AS DOUBLE)) AS dtm", "CAST(id % 2 AS INT) AS mask", "CAST(id % 11 AS DOUBLE) AS albedo")
    small, large = (sorted(zonal.cell_profile(df, n).collect()) for n in (10, zonal.BUFFER_PIXELS + 1))
    assert small == large


def test_large_profile_reads_its_pixels_once(spark):
    """Whatever is behind the pixels runs once, and no join is on a cell alone."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(3000).selectExpr(
        "id % 7 AS cell_id", "CAST(id % 3 AS DOUBLE) AS surface", "CAST(id % 101 AS DOUBLE) AS dsm", "CAST(id % 97 AS DOUBLE) AS dtm",
        "CAST(id % 2 AS INT) AS mask", "CAST(id % 11 AS DOUBLE) AS albedo")
    out = zonal.cell_profile(df.mapInArrow(count, df.schema), zonal.BUFFER_PIXELS + 1)
    assert len(out.collect()) == 7 and seen.value == 3000
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert joins and all("part#" in line for line in joins)


def test_lookup_hot_and_cold(spark):
    left = spark.range(400).selectExpr("id", "IF(id < 300, 1, id) AS k")
    right = spark.range(350).selectExpr("id AS k", "id * 2 AS v")
    want = sorted(left.join(right, "k", "left").select("id", "k", "v").collect())
    got = skew.lookup(left, "k", right, 400, hot_rows=10)
    assert sorted(got.select("id", "k", "v").collect()) == want


def test_grid_that_does_not_divide_the_extent(spark):
    geo = schemas.Georef(100.0, 200.0, 0.5, 0.5, 9, 13)
    spec = schemas.GridSpec.over(geo, 2.0)
    assert (spec.n_rows, spec.n_cols) == (3, 4)
    px = lattice(spark, 9, 13, "row_idx", "col_idx")
    cells = {r.cell_id: r for r in grid.make_grid(spark, spec).collect()}
    rows = grid.assign_cells(px, geo, spec).collect()
    assert len(rows) == 9 * 13
    for r in rows:
        x, y, c = 100 + (r.col_idx + 0.5) * 0.5, 200 - (r.row_idx + 0.5) * 0.5, cells[r.cell_id]
        assert c.left <= x < c.right and c.bottom < y <= c.top
    per_cell = grid.assign_cells(px, geo, spec).groupBy("cell_id").count().agg(F.max("count")).first()[0]
    assert per_cell <= spec.max_pixels_per_cell(geo)
    with pytest.raises(ValueError):
        schemas.GridSpec.over(geo, 0.01)


def test_fractions_sum_to_hundred(spark):
    df = spark.range(500).selectExpr("id % 9 AS cell_id", "CAST(id * 13 % 5 AS INT) AS surface")
    rows = zonal.class_fractions(df, "surface").collect()
    assert all(abs(r.perc_impervious + r.perc_pervious + r.perc_buildings - 100) < 1e-9 for r in rows)
    none = zonal.class_fractions(df.withColumn("surface", F.lit(7)), "surface").collect()
    assert all(r.perc_buildings is None for r in none)


def test_aspect_ratio_floor(spark):
    df = spark.createDataFrame([(1, 0.2, 6.0), (2, None, 6.0), (3, 3.0, 6.0)], "cell_id BIGINT, median_dist DOUBLE, mean_build_height DOUBLE")
    assert [r.aspect_ratio for r in derive.aspect_ratio(df).orderBy("cell_id").collect()] == [6.0, 6.0, 2.0]
    with pytest.raises(ValueError, match="median_dist"):
        derive.aspect_ratio(df.drop("median_dist"))


def test_columns(spark):
    df = spark.range(1)
    assert schemas.ensure_column(df, "x", "double").dtypes == [("id", "bigint"), ("x", "double")]
    assert schemas.ensure_column(df, "id", "double") is df
    with pytest.raises(ValueError, match="missing columns: a, b"):
        schemas.require_columns(df, "b", "id", "a")


def test_explode_range_in_chunks(spark):
    df = spark.createDataFrame([(1, 0, 9), (2, 5, 4), (3, 7, 7)], "k INT, lo BIGINT, hi BIGINT")
    got = explode_range(df, "i", F.col("lo"), F.col("hi"), chunk=4).collect()
    assert sorted((r.k, r.i) for r in got) == [(1, i) for i in range(10)] + [(3, 7)]


def test_mosaic_ties_nulls_and_fill(spark):
    rows = [(1, 5, 0, 0, 1.0), (2, 5, 0, 0, 2.0), (9, 6, 0, 0, None), (3, 1, 0, 1, 4.0), (2, -7, 0, 1, 5.0)]
    px = spark.createDataFrame([(t, p, "dsm", 1, r, c, v) for t, p, r, c, v in rows],
                               "tile_id BIGINT, priority INT, layer STRING, band INT, row_idx BIGINT, col_idx BIGINT, value DOUBLE")
    got = {(r.row_idx, r.col_idx): r.value for r in tiles.mosaic(px).collect()}
    assert got == {(0, 0): 2.0, (0, 1): 4.0}
    filled = {(r.row_idx, r.col_idx): r.value
              for r in tiles.mosaic(px.repartition(7), schemas.Georef(0, 0, 1, 1, 2, 2), fill=0.0).collect()}
    assert filled == {(0, 0): 2.0, (0, 1): 4.0, (1, 0): 0.0, (1, 1): 0.0}


def test_tile_round_trip(spark, tmp_path):
    px = spark.createDataFrame([("dsm", 1, r, c, float(r * 10 + c)) for r in range(7) for c in range(9) if (r + c) % 4],
                               schemas.PIXELS)
    path = str(tmp_path / "tiles")
    tiles.write_tiles(tiles.pixels_to_tiles(px, 4), path)
    back = tiles.tiles_to_pixels(tiles.read_tiles(spark, path, ["dsm"])).where("value IS NOT NULL")
    assert sorted(back.select(*px.columns).collect()) == sorted(px.collect())
    assert tiles.read_tiles(spark, path, ["rgb"]).count() == 0
    with pytest.raises(Exception, match="(?i)already exists"):
        tiles.write_grid(px, path)


def test_byte_cast_clamps(spark):
    df = spark.createDataFrame([(-3.0,), (254.6,), (300.0,), (None,)], "v DOUBLE")
    assert [r.b for r in df.select(tiles.as_byte(F.col("v")).alias("b")).collect()] == [0, 255, 255, None]


def test_number_text(spark):
    values = [0.0, 1.0, -2.5, 0.00087580, 123456789.0, 40.00175, 1e-7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v DOUBLE").orderBy("i")
    got = [r.t for r in df.select(text.number_text(F.col("v")).alias("t")).collect()]
    assert got == ["0", "1", "-2.5", "0.0008758", "123456789", "40.00175", "0.0000001"]


def test_long_coordinate_text_continues_in_parts(spark):
    aoi = spark.createDataFrame([(1, 40.0, 39.99, 10.0, 10.012)], "aoi_id BIGINT, north DOUBLE, south DOUBLE, west DOUBLE, east DOUBLE")
    found = acquisition.aoi_tiles(aoi)
    centres = [f"{r.center_lat:.5f},{r.center_lng:.5f}" for r in found.orderBy("tile_ord").collect()]
    parts = acquisition.aoi_coordinate_text(found).orderBy("part").collect()
    assert len(parts) == found.select("top").distinct().count() > 1
    assert "".join(p.coordinate_text for p in parts) == "getCoordinate: " + "; ".join(centres)


def test_large_area_is_spread(spark):
    aoi = spark.createDataFrame([(1, 41.0, 40.0, 10.0, 10.3)], "aoi_id BIGINT, north DOUBLE, south DOUBLE, west DOUBLE, east DOUBLE")
    sizes = [r["count"] for r in acquisition.aoi_tiles(aoi).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_required_layers(spark):
    rows = [(1, i, n, "raster") for i, n in enumerate(("rgb", "dsm", "mask", "class"))] + [(2, 1, "rgb", "vector")]
    cat = spark.createDataFrame(rows, "project_id BIGINT, load_order INT, name STRING, type STRING")
    got = {(r.project_id, r["name"]) for r in catalog.missing_layers(cat, ("import",)).collect()}
    assert got == {(2, n) for n in ("rgb", "dsm", "mask", "class")}
    assert catalog.require_layers(cat.where("project_id = 1"), "import") is not None
    with pytest.raises(ValueError, match="project 2"):
        catalog.require_layers(cat, "import")
    with pytest.raises(ValueError):
        catalog.dedupe_layers(cat, keep="any")


def test_materialize_uses_the_session_folder(spark):
    folder = scratch.scratch_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert folder == (named or spark.sparkContext.getCheckpointDir() or scratch.scratch_dir(spark))
    table = scratch.materialize(spark.range(5))
    assert table.count() == 5
    assert all(folder in path for path in table.inputFiles())
    scratch.discard(table)
    with pytest.raises(Exception):
        spark.read.schema(table.schema).parquet(table.scratch_path).count()


def test_live_progress(spark, tmp_path):
    source = tmp_path / "in"
    names = ["dsm_1.5_2.5.tif", "rgb_1.5_2.5.tif", "dsm_1.5_2.5.tif", "notes.txt", "dsm_9.5_9.5.tif"]
    spark.createDataFrame([(1, n) for n in names], "aoi_id BIGINT, file_name STRING").write.json(str(source))
    arrivals = spark.readStream.schema("aoi_id BIGINT, file_name STRING").json(str(source))
    expected = [f"{layer}_{at}.tif" for layer in ("dsm", "rgb", "mask") for at in ("1.5_2.5", "1.5_3.5")]
    manifest = spark.createDataFrame([(1, n) for n in expected], "aoi_id BIGINT, file_name STRING")
    q = (live_progress(arrivals, manifest).writeStream.outputMode("complete").format("memory").queryName("progress")
         .option("checkpointLocation", str(tmp_path / "cp")).start())
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("progress").collect()] == [(1, 2, 6, "33.33%")]
