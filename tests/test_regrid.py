"""Regridding against a brute force over all pairs of pixels, and its plans."""

import random
from collections import defaultdict
from fractions import Fraction

import pytest

from zonalis.operators import regrid
from zonalis.plans import pipeline
from zonalis.schemas import Georef, GridSpec

SCHEMA = "row_idx BIGINT, col_idx BIGINT, value DOUBLE"


def exact_span(start, size, k):
    return Fraction(str(start)) + k * Fraction(str(size)), Fraction(str(start)) + (k + 1) * Fraction(str(size))


def brute(cells, source, target, how):
    """Every target pixel against every source pixel, in exact fractions measured down and to the right."""
    out = {}
    down = Fraction(str(target.y_max)) - Fraction(str(source.y_max))
    right = Fraction(str(source.x_min)) - Fraction(str(target.x_min))
    for r in range(target.n_rows):
        for c in range(target.n_cols):
            met = []
            for (i, j), v in cells.items():
                y, x = [(s + k * Fraction(str(p)), s + (k + 1) * Fraction(str(p))) for s, k, p in ((down, i, source.px_y), (right, j, source.px_x))]
                ty, tx = exact_span(0, target.px_y, r), exact_span(0, target.px_x, c)
                if how == "nearest":
                    if y[0] <= sum(ty) / 2 < y[1] and x[0] <= sum(tx) / 2 < x[1]:
                        met.append((v, 1))
                else:
                    h, w = min(y[1], ty[1]) - max(y[0], ty[0]), min(x[1], tx[1]) - max(x[0], tx[0])
                    if h > 0 and w > 0:
                        met.append((v, h * w))
            if not met:
                continue
            known = [(v, w) for v, w in met if v is not None]
            if not known:
                out[r, c] = None
            elif how == "majority":
                area = defaultdict(Fraction)
                for v, w in known:
                    area[v] += w
                out[r, c] = min(area, key=lambda v: (-area[v], v))
            else:
                out[r, c] = float(sum(Fraction(v) * w for v, w in known) / sum(w for _, w in known))
    return out


@pytest.mark.parametrize("how", regrid.METHODS)
@pytest.mark.parametrize("sizes", [(0.5, 0.75, 0.3, -0.2), (2.0, 0.3, -1.1, 0.7), (0.1, 0.3, 0.0, 0.0), (1.0, 0.5, 2.0, -1.5), (0.7, 5.0, -3.3, 2.2)])
def test_against_all_pairs(spark, how, sizes):
    px, into, dx, dy = sizes
    rng = random.Random(7)
    cells = {(i, j): rng.choice([None, 1.0, 2.0, 2.0, 5.0]) for i in range(9) for j in range(7) if rng.random() > 0.1}
    source = Georef(100.0, 50.0, px, px, 9, 7)
    target = Georef(100.0 + dx, 50.0 + dy, into, into, 8, 10)
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], SCHEMA)
    got = {(r.row_idx, r.col_idx): r.value for r in regrid.regrid(df, source, target, how=how).collect()}
    want = brute(cells, source, target, how)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) if want[k] is not None else got[k] is None for k in want)
    assert got


def test_rectangular_pixels_and_unknown_method(spark):
    source, target = Georef(0.0, 10.0, 1.0, 2.0, 2, 3), Georef(0.0, 10.0, 1.5, 1.0, 4, 2)
    cells = {(i, j): float(3 * i + j) for i in range(2) for j in range(3)}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], SCHEMA)
    got = {(r.row_idx, r.col_idx): r.value for r in regrid.regrid(df, source, target, how="mean").collect()}
    assert got == pytest.approx(brute(cells, source, target, "mean"))
    with pytest.raises(ValueError):
        regrid.regrid(df, source, target, how="cubic")


def test_outer_keeps_what_one_layer_lacks(spark):
    lattice = Georef(0.0, 4.0, 1.0, 1.0, 4, 4)
    a = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], SCHEMA)
    b = spark.createDataFrame([(0, 0, 3.0)], SCHEMA)
    layers = {"a": (a, lattice, "mean"), "b": (b, Georef(0.0, 4.0, 2.0, 2.0, 2, 2), "nearest")}
    rows = lambda how: sorted((r.row_idx, r.col_idx, r.a, r.b) for r in regrid.align_regridded(layers, lattice, how).collect())
    assert rows("inner") == [(0, 0, 1.0, 3.0), (1, 1, 2.0, 3.0)]
    assert rows("outer") == [(0, 0, 1.0, 3.0), (0, 1, None, 3.0), (1, 0, None, 3.0), (1, 1, 2.0, 3.0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    px = spark.range(100).selectExpr("id div 10 AS row_idx", "id % 10 AS col_idx", "double(id) AS value")
    source, target = Georef(0.0, 10.0, 0.5, 0.5, 10, 10), Georef(0.3, 9.8, 0.75, 0.75, 6, 6)
    layers = {"a": (px, source, "mean"), "b": (px, target, "nearest"), "c": (px, target, "mean")}
    text = plan(regrid.align_regridded(layers, target))
    assert text.count("Exchange") == 1 and "Join" not in text
    finer = Georef(0.0, 10.0, 0.25, 0.25, 20, 20)
    for how in regrid.METHODS:
        assert "Exchange" not in plan(regrid.regrid(px, source, finer, how=how))


def test_zones_from_layers_of_several_lattices(spark):
    """Layers cut finer and brought back give the zones of the layers themselves."""
    px = spark.range(400).selectExpr(
        "id div 20 AS row_idx", "id % 20 AS col_idx", "50D + id % 7 AS dsm", "int(id % 11 = 0) AS mask", "double(id % 9) AS class", "1000D + id % 3 AS albedo").cache()
    geo = Georef(0.0, 10.0, 0.5, 0.5, 20, 20)
    spec = GridSpec.over(geo, 5.0)
    finer = Georef(0.0, 10.0, 0.25, 0.25, 40, 40)
    layers = {}
    for name in ("dsm", "mask", "class", "albedo"):
        own = px.selectExpr("row_idx", "col_idx", f"double({name}) AS value")
        layers[name] = (regrid.regrid(own, geo, finer), finer, "majority") if name in ("class", "mask") else (own, geo, "mean")
    rows = lambda df: sorted(map(str, df.drop("description").collect()))
    assert rows(pipeline.lcz_grid_from_layers(layers, geo, spec)) == rows(pipeline.lcz_grid(px, geo, spec))
