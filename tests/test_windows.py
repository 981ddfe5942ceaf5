"""Box sums against a sum over the pixels of every box."""

import random

import pytest

from zonalis.operators import polygons, windows
from zonalis.schemas import Georef

BOX = "box_id BIGINT, left DOUBLE, top DOUBLE, right DOUBLE, bottom DOUBLE, n_pixels INT"


def brute(cells, geo, boxes):
    out = {}
    for k, left, top, right, bottom, _ in boxes:
        held = [v for (r, c), v in cells.items() if v is not None
                and left <= geo.x_min + (c + 0.5) * geo.px_x < right and top >= geo.y_max - (r + 0.5) * geo.px_y > bottom]
        out[k] = (len(held), sum(held), sum(held) / len(held) if held else None)
    return out


@pytest.mark.parametrize("block", [3, 8, 64])
def test_boxes_of_any_place(spark, block):
    rng = random.Random(block)
    geo = Georef(10.0, 20.0, 0.5, 0.25, 21, 17)
    # A hole larger than a block, and pixels without a value.
    cells = {(r, c): rng.choice([None, 1.0, 2.0, 7.0]) for r in range(21) for c in range(17) if not (4 <= r < 14 and 5 <= c < 13)}
    side = lambda a, b: rng.randint(4 * a, 4 * b) / 4
    boxes = []
    for k in range(120):
        x, y = side(8, 19), side(13, 22)
        boxes.append((k, x, y, x + side(0, 8), y - side(0, 6), 0))
    boxes += [(500 + k, 10.0, 20.0, 18.5, 14.75, 0) for k in range(60)] + [(900, 0.0, 99.0, 99.0, 0.0, 0), (901, 12.0, 18.0, 11.0, 19.0, 0)]
    px = spark.createDataFrame([(*k, v) for k, v in cells.items()], "row_idx BIGINT, col_idx BIGINT, v DOUBLE")
    sums = windows.prefix_sums(px, geo, "row_idx", "v", block=block)
    got = {r.box_id: (r.v_n, r.v_total, r.v_mean) for r in windows.window_sums(sums, spark.createDataFrame(boxes, BOX)).collect()}
    want = brute(cells, geo, boxes)
    assert got.keys() == want.keys()
    for k, (n, total, mean) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(total) and (got[k][2] == pytest.approx(mean) if n else got[k][2] is None)


def test_nothing(spark):
    geo = Georef(0.0, 0.0, 1.0, 1.0, 4, 4)
    px = spark.createDataFrame([], "row_idx BIGINT, col_idx BIGINT, v DOUBLE")
    sums = windows.prefix_sums(px, geo, "v", block=2)
    one = spark.createDataFrame([(1, 0.0, 0.0, 4.0, -4.0, 0)], BOX)
    assert [tuple(r) for r in windows.window_sums(sums, one).collect()] == [(1, 0, 0.0, None)]
    assert windows.window_sums(sums, one.limit(0)).collect() == []


def test_polygons_with_holes_take_rows_by_their_outline(spark):
    geo = Georef(0.0, 60.0, 1.0, 1.0, 60, 60)
    ring = lambda k, *p: [(k, *a, *b) for a, b in zip(p, p[1:] + p[:1])]
    edges = ring(1, (3.2, 4.1), (50.3, 7.7), (44.0, 55.5), (9.9, 50.2)) + ring(1, (20.0, 20.0), (30.0, 20.0), (30.0, 33.0), (20.0, 33.0))
    edges += ring(2, (-10.0, -5.0), (70.0, 30.0), (-20.0, 80.0)) + ring(3, (200.0, 1.0), (210.0, 9.0), (205.0, 20.0)) + ring(4, (1.1, 1.1), (1.3, 1.2), (1.2, 1.3))
    edges = spark.createDataFrame(edges, "polygon_id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    px = spark.range(3600).where("id % 31 <> 0").selectExpr("id div 60 AS row_idx", "id % 60 AS col_idx", "IF(id % 13 = 0, NULL, double(id % 4)) AS surface")
    rows = lambda df: sorted((r.polygon_id, r.perc_impervious, r.perc_pervious, r.perc_buildings) for r in df.collect())
    counts = polygons.class_counts(px, geo, block=16)
    assert rows(polygons.zonal_polygons_cover(edges, counts)) == rows(polygons.zonal_polygons(edges, px, geo))
    assert polygons.polygon_spans(edges, geo).count() < polygons.polygon_pixels(edges, geo).count() / 15
