"""Sky view against all lines of sight."""

import random

import numpy as np
import pytest

from zonalis.operators import sky
from zonalis.schemas import Georef, GridSpec


def brute(z, px):
    out = {}
    for (r, c), h in z.items():
        total = 0.0
        for dr, dc in [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]:
            rise = 0.0
            for k in range(1, 60):
                far = z.get((r + k * dr, c + k * dc))
                if far is not None:
                    rise = max(rise, (far - h) / (k * px * np.hypot(dr, dc)))
            total += 1 / (1 + rise ** 2)
        out[r, c] = total / 8
    return out


@pytest.mark.parametrize("block", [4, 7, 64])
@pytest.mark.parametrize("kind", ["towers", "hill", "noise", "flat"])
def test_equals_all_lines_of_sight(spark, block, kind):
    rng = random.Random(3)
    height = {
        "towers": lambda r, c: 30.0 if rng.random() < 0.05 else 0.0, "hill": lambda r, c: 40 - ((r - 11) ** 2 + (c - 9) ** 2) / 8,
        "noise": lambda r, c: rng.random() * 9, "flat": lambda r, c: 2.0}[kind]
    z = {(r, c): height(r, c) for r in range(23) for c in range(31) if not (8 <= r < 17 and 10 <= c < 20) and rng.random() > 0.05}
    df = spark.createDataFrame([(*k, v, 0) for k, v in z.items()] + [(12, 12, None, 0), (12, 13, float("nan"), 0)], "row_idx BIGINT, col_idx BIGINT, dsm DOUBLE, z INT")
    geo = Georef(0.0, 0.0, 0.5, 0.5, 23, 31)
    got = {(r.row_idx, r.col_idx): r.sky_view for r in sky.sky_view(df, geo, block=block).collect()}
    assert got == pytest.approx(brute(z, 0.5))


def test_cells_and_refusals(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0)], "row_idx BIGINT, col_idx BIGINT, dsm DOUBLE")
    geo = Georef(0.0, 1.0, 1.0, 1.0, 1, 2)
    got = sky.sky_view_cells(df, geo, GridSpec.over(geo, 2.0)).collect()
    assert [(r.cell_id, r.sky_view_factor) for r in got] == [(0, pytest.approx((7.5 / 8 + 1) / 2))]
    with pytest.raises(ValueError):
        sky.sky_view(df, Georef(0.0, 1.0, 1.0, 2.0, 1, 2))
    assert sky.sky_view(df.limit(0), geo).collect() == []
