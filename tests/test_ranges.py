"""Range tables of any size against the plain first match."""

import random

import pytest
from pyspark.sql import functions as F

from zonalis.functions import intervals
from zonalis.operators import algebra

RANGES = "lo DOUBLE, hi DOUBLE, new_val DOUBLE"


def some_ranges(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lo = rng.randint(0, 40) / 2
        out.append((lo, lo + rng.choice([-1, 0, 0.5, 1, 4, 30]), rng.choice([None, 1.0, 2.0, 3.0])))
    return out + [(None, 5.0, 1.0), (5.0, None, 1.0)] + out[:3]


@pytest.mark.parametrize("seed,n", [(1, 3), (2, 12), (3, 60), (4, 0)])
def test_joined_ranges_equal_the_array(spark, monkeypatch, seed, n):
    ranges = spark.createDataFrame(some_ranges(seed, n), RANGES)
    values = [None, float("nan"), -9999.0, -0.0, 0.0] + [k / 4 for k in range(-4, 130)] * 2
    px = spark.createDataFrame([(i, v, 0) for i, v in enumerate(values)], "row_idx BIGINT, v DOUBLE, new_val INT")
    rows = lambda: sorted(map(str, algebra.reclassify_by_table(px, ranges, "v", "out").select("row_idx", "v", "new_val", "out").collect()))
    plain = rows()
    monkeypatch.setattr(algebra, "MAX_RANGES", 0)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows() == plain
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_intervals_are_disjoint(spark):
    got = sorted(map(tuple, intervals.first_match_intervals(spark.createDataFrame(some_ranges(7, 80), RANGES)).collect()))
    assert got and all(a < b for a, b, _ in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
