from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.functions import skew
from zonalis.operators import regions
from zonalis.operators.polygons import rasterize_polygons
from zonalis.schemas import Georef


def flood(value, n_cols):
    """Smallest pixel id of each pixel's 4-connected region of equal value."""
    label = {}
    for start in sorted(value):
        if start in label:
            continue
        stack, name = [start], start[0] * n_cols + start[1]
        label[start] = name
        while stack:
            r, c = stack.pop()
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if p in value and p not in label and value[p] == value[start]:
                    label[p] = name
                    stack.append(p)
    return label


def labels(df):
    return {(r.row_idx, r.col_idx): r.component_id for r in df.collect()}


def test_diagonal_contact_is_two_regions(raster):
    px = raster([[1, 0], [0, 1]]).where("value = 1")
    assert labels(regions.components(px, 2)) == {(0, 0): 0, (1, 1): 3}


def test_region_across_block_border(raster):
    assert set(labels(regions.components(raster([[1] * 8]), 8, block=4)).values()) == {0}


@pytest.mark.parametrize("block,hot_rows", [(3, 3), (8, skew.HOT_ROWS), (64, skew.HOT_ROWS)])
def test_all_values_with_background(spark, block, hot_rows, monkeypatch):
    rng = np.random.default_rng(block)
    value = {(r, c): int(rng.random() < 0.4) for r in range(20) for c in range(26) if rng.random() < 0.95}
    px = spark.createDataFrame([(r, c, v) for (r, c), v in value.items()], "row_idx BIGINT, col_idx BIGINT, value INT")
    plain = regions.connect
    small = 0 if hot_rows == 3 else regions.SMALL_GRAPH
    monkeypatch.setattr(regions, "connect", lambda pairs: plain(pairs, hot_rows, small))
    want = flood(value, 26)
    assert labels(regions.components(px, 26, block=block)) == want
    got = {r.component_id: r for r in regions.component_summary(px, 26, block=block).collect()}
    assert {k: r.pixel_count for k, r in got.items()} == Counter(want.values())
    for k, r in got.items():
        places = [p for p, v in want.items() if v == k]
        assert (r.min_row, r.max_row) == (min(p[0] for p in places), max(p[0] for p in places))
        assert (r.min_col, r.max_col) == (min(p[1] for p in places), max(p[1] for p in places))


@pytest.mark.parametrize("hot_rows,small", [(skew.HOT_ROWS, regions.SMALL_GRAPH), (skew.HOT_ROWS, 20), (2, 0)])
def test_connect_path_and_star(spark, hot_rows, small):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(500, 540)]
    pairs = spark.createDataFrame(path + star + [(b, a) for a, b in star], "a BIGINT, b BIGINT")
    got = {r.label: r.component for r in regions.connect(pairs, hot_rows, small).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(500, 540)}}


def test_connect_without_pairs(spark):
    assert regions.connect(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


RING = [[0, 0, 0, 0, 0], [0, 1, 1, 1, 0], [0, 1, 0, 1, 0], [0, 1, 1, 1, 0], [0, 0, 0, 0, 0]]
# Two pixels of one region touch at a corner only, and enclose a hole there.
PINCH = [[1, 1, 1], [1, 0, 1], [1, 1, 0]]


def ring_map(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.ring_id, r.seq)):
        out[r.component_id, r.ring_id].append((r.x, r.y))
    return list(out.values())


@pytest.mark.parametrize("task_edges", [regions.TASK_EDGES, 10])
def test_rings_close_and_fill_back(spark, raster, task_edges):
    # A ring, a pinched ring, a single pixel and two that touch at a corner: 2 + 2 + 1 + 2 rings.
    gap = [[0]] * 5
    pad = lambda rows: [r + [0] * (3 - len(r)) for r in rows] + [[0] * 3] * (5 - len(rows))
    rows = [sum(line, []) for line in zip(RING, gap, pad(PINCH), gap, pad([[1]]), gap, pad([[1, 0], [0, 1]]))]
    n_rings, n = 7, len(rows[0])
    mask = raster(rows).where("value = 1")
    rings = ring_map(regions.component_rings(
        regions.component_edges(regions.components(mask, n), block=2), task_edges))
    assert len(rings) == n_rings
    for ring in rings:
        turns = [(x2 - x1, y2 - y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])]
        assert all((dx == 0) != (dy == 0) for dx, dy in turns)
    edges = [(1, float(x1), float(y1), float(x2), float(y2))
             for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])]
    df = spark.createDataFrame(edges, "polygon_id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    back = {(r.row_idx, r.col_idx) for r in rasterize_polygons(df, Georef(0, 0, 1, 1, len(rows), n)).collect()}
    assert back == {(r.row_idx, r.col_idx) for r in mask.collect()}


def test_long_outlines_come_in_parts(raster):
    mask = raster(RING).where("value = 1")
    geo = Georef(100.0, 50.0, 0.5, 0.5, 5, 5)
    rings = regions.component_rings(regions.component_edges(regions.components(mask, 5)))
    whole = regions.component_wkt(rings, geo).collect()
    assert {(r.component_id, r.part, r.hole, r.wkt) for r in whole} == {
        (6, 0, False, "LINESTRING (100.5 49.5, 102 49.5, 102 48, 100.5 48, 100.5 49.5)"),
        (6, 0, True, "LINESTRING (101.5 49, 101 49, 101 48.5, 101.5 48.5, 101.5 49)")}
    joined = {}
    for r in regions.component_wkt(rings, geo, page=2).orderBy("ring_id", "part").collect():
        line = r.wkt.removeprefix("LINESTRING (").removesuffix(")").split(", ")
        before = joined.setdefault(r.ring_id, line[:1])
        assert before[-1] == line[0]
        before.extend(line[1:])
    assert joined == {r.ring_id: r.wkt.removeprefix("LINESTRING (").removesuffix(")").split(", ") for r in whole}


def test_unmatched_hot_key_is_spread(spark):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, -1).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, 20_000, 10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = skew.lookup(left, "k", right, 20_000, hot_rows=500)
    assert {(r.id, r.k, r.v) for r in joined.collect()} == {
        (i, i if i % 10 == 0 else -1, 2 * i if i % 10 == 0 else None) for i in range(20_000)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in skew.lookup(left, "k", right, 20_000, hot_rows=500).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(sizes) < 2 * 20_000 / 4


def test_plan_of_connect_stays_flat(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    done = regions.connect(path, hot_rows=3, small=0)
    assert {r.component for r in done.collect()} == {0}
    assert len(done._jdf.queryExecution().analyzed().toString().split("\n")) < 80


def test_rasterize_clips_and_takes_pixel_centres(spark):
    square = [(9, -2.0, -2.0, 1.5, -2.0), (9, 1.5, -2.0, 1.5, 1.5), (9, 1.5, 1.5, -2.0, 1.5), (9, -2.0, 1.5, -2.0, -2.0)]
    df = spark.createDataFrame(square, "polygon_id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    got = {(r.row_idx, r.col_idx, r.value) for r in rasterize_polygons(df, Georef(0, 0, 1, 1, 9, 9)).collect()}
    assert got == {(0, 0, 2)}


def test_polygons_of_any_page_are_the_same(raster):
    mask = raster(RING).where("value = 1")
    geo = Georef(100.0, 50.0, 0.5, 0.5, 5, 5)
    edges = regions.component_edges(regions.components(mask, 5))
    rings = regions.component_rings(edges)
    texts = []
    for page in (1, 2, 3, 10_000):
        parts = regions.component_polygons(rings, geo, page).orderBy("component_id", "part").collect()
        assert [r.part for r in parts] == list(range(len(parts)))
        texts.append("".join(r.text for r in parts))
    assert set(texts) == {"POLYGON ((100.5 49.5, 102 49.5, 102 48, 100.5 48, 100.5 49.5), (101.5 49, 101 49, 101 48.5, 101.5 48.5, 101.5 49))"}
    assert [tuple(r) for r in regions.component_areas(edges).collect()] == [(6, 8, 16)]
