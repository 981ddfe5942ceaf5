import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.operators import focal
from zonalis.operators.proximity import proximity
from zonalis.schemas import Georef


def by_place(rows, name):
    return {(r.row_idx, r.col_idx): r[name] for r in rows}


def test_slope_of_a_plane(raster):
    plane = [[c * math.tan(math.radians(30)) for c in range(5)] for _ in range(5)]
    got = by_place(focal.slope(raster(plane, "dsm", "DOUBLE")).collect(), "slope")
    assert all(got[r, c] == pytest.approx(30) for r in (1, 2, 3) for c in (1, 2, 3))


def horn(z, r, c):
    v = lambda i, j: z.get((i, j)) if z.get((i, j)) is not None else z[r, c]
    n = {(i, j): v(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    gx = ((n[-1, 1] + 2 * n[0, 1] + n[1, 1]) - (n[-1, -1] + 2 * n[0, -1] + n[1, -1])) / 8
    gy = ((n[1, -1] + 2 * n[1, 0] + n[1, 1]) - (n[-1, -1] + 2 * n[-1, 0] + n[-1, 1])) / 8
    return math.degrees(math.atan(math.hypot(gx, gy)))


@pytest.mark.parametrize("density", [0.95, 0.6, 0.2])
def test_slope_with_missing_and_null_pixels(spark, density):
    rng = np.random.default_rng(7)
    z = {(r, c): (None if rng.random() < 0.1 else float(rng.integers(0, 9)))
         for r in range(23) for c in range(19) if rng.random() < density}
    px = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row_idx BIGINT, col_idx BIGINT, dsm DOUBLE")
    got = by_place(focal.slope(px, block=5).collect(), "slope")
    assert set(got) == set(z)
    for (r, c), v in z.items():
        if v is None:
            assert got[r, c] is None
        else:
            assert got[r, c] == pytest.approx(horn(z, r, c))


def test_dtm_masks_by_zero_or_null(raster):
    px = raster([[5.0] * 4] * 4, "dsm", "DOUBLE").withColumn("mask", (F.col("col_idx") == 0).cast("int"))
    zero = by_place(focal.dtm(px).collect(), "dtm")
    null = by_place(focal.dtm(px, masked="null").collect(), "dtm")
    assert zero[1, 0] == 0.0 and zero[1, 2] == 5.0
    assert null[1, 0] is None and null[1, 2] == 5.0
    with pytest.raises(ValueError):
        focal.dtm(px, masked="other")


def test_no_target_gives_null(raster):
    got = proximity(raster([[0] * 4] * 4, "mask"), Georef(0, 0, 1, 1, 4, 4)).collect()
    assert len(got) == 16 and all(r.distance is None for r in got)


@pytest.mark.parametrize("n_targets,block", [(1, 4), (3, 4), (3, 7), (40, 4), (40, 64), (400, 8)])
def test_proximity_equals_brute_force(spark, n_targets, block):
    rng = np.random.default_rng(n_targets * 100 + block)
    h, w = 37, 45
    targets = {(int(rng.integers(h)), int(rng.integers(w))) for _ in range(n_targets)}
    # Holes larger than a block, so that blocks without any pixel lie between targets and pixels.
    places = [(r, c) for r in range(h) for c in range(w) if (r, c) in targets or not (9 <= r < 21 and 8 <= c < 30)]
    px = spark.createDataFrame([(r, c, int((r, c) in targets)) for r, c in places], "row_idx BIGINT, col_idx BIGINT, mask INT")
    got = by_place(proximity(px, Georef(0, 0, 1, 1, h, w), block=block).collect(), "distance")
    t = np.array(sorted(targets))
    assert set(got) == set(places)
    for r, c in places:
        assert got[r, c] == pytest.approx(np.sqrt(((t - (r, c)) ** 2).sum(1).min()))


def test_map_units(raster):
    px = raster([[1, 0, 0]], "mask")
    got = by_place(proximity(px, Georef(0, 0, 0.5, 0.5, 1, 3), units="map").collect(), "distance")
    assert got[0, 2] == 1.0
    with pytest.raises(ValueError):
        proximity(px, Georef(0, 0, 0.5, 0.25, 1, 3), units="map")
    with pytest.raises(ValueError):
        proximity(px, Georef(0, 0, 1, 1, 1, 3), units="feet")
