import math

import pytest
from pyspark.sql import functions as F

from zonalis.operators import lcz

SAMPLE = dict(
    sky_view_factor=0.736596167, aspect_ratio=0.072062784, building_surface_fraction=5.0,
    impervious_surface_fraction=85.0, pervious_surface_fraction=10.0, height_roughness=9.564424038,
    terrain_roughness=1.703751326, surface_admittance=None, surface_albedo=0.26990354,
    anthropogenic_heat=999999999999999.0)


def cells(spark, *rows):
    return spark.createDataFrame(
        [(i, *[{**SAMPLE, **r}[p] for p in lcz.PARAMETERS]) for i, r in enumerate(rows)],
        "cell_id BIGINT, " + ", ".join(f"{p} DOUBLE" for p in lcz.PARAMETERS))


def test_class_table(spark):
    rows = lcz.lcz_ranges(spark).collect()
    assert len(rows) == 170
    assert sum(math.isinf(r.max_val) for r in rows) == 6
    assert sum((r.min_val if math.isinf(r.max_val) else r.min_val + r.max_val) == 0 for r in rows) == 7
    assert [c for c, _, _ in lcz.CLASSES] == [*map(str, range(1, 11)), *"ABCDEFG"]
    assert all(r.min_val <= r.max_val for r in rows)


def test_sample_cell(spark):
    df = cells(spark, {})
    row = lcz.lcz_describe(lcz.lcz_classify(df)).first()
    assert (row.lcz_class, row.perfect_matches, row.available_params) == ("10", 3, 9)
    assert row.lcz_score == pytest.approx(0.284824, abs=1e-6)
    assert row.description == "Heavy industry"
    assert lcz.lcz_classify(df, denominator="target").first().lcz_score == pytest.approx(0.101529, abs=1e-6)
    ranked = lcz.lcz_ranked(df).orderBy("rank").collect()
    assert [(r.rank, r.lcz_class) for r in ranked] == [(1, "10"), (2, "8")]
    assert ranked[1].score == pytest.approx(0.308716, abs=1e-6)
    with pytest.raises(ValueError):
        lcz.lcz_classify(df, denominator="other")


def test_status_and_tolerance(spark):
    df = cells(spark, {}, {"building_surface_fraction": None}, {"pervious_surface_fraction": None},
               {"impervious_surface_fraction": 84.0}, {"impervious_surface_fraction": 85.0000001})
    exact = [r.lcz_status for r in lcz.lcz_input_status(df).orderBy("cell_id").collect()]
    assert exact == ["ok", "missing_building", "missing_fraction", "bad_sum", "bad_sum"]
    assert lcz.lcz_input_status(df, 1e-6).orderBy("cell_id").collect()[4].lcz_status == "ok"
    out = lcz.lcz_classify(df).orderBy("cell_id").collect()
    assert [r.lcz_class is None for r in out] == [False, True, True, True, True]


def test_natural_classes_need_no_buildings(spark):
    df = cells(spark, {"building_surface_fraction": 0.0, "impervious_surface_fraction": 5.0, "pervious_surface_fraction": 95.0})
    assert {r.lcz_class for r in lcz.lcz_eligible(df).collect()} == set("ABCDEFG")
    results = {r.lcz_class: r for r in lcz.lcz_all_results(df).collect()}
    assert len(results) == 17
    assert results["1"].score is None and results["1"].perfect_matches == 0 and results["1"].error_contributions == {}
    # Heat above a target of 0: an infinite contribution that the score leaves out.
    assert results["D"].error_contributions["anthropogenic_heat"] == math.inf
    assert math.isfinite(results["D"].score)


def test_only_undefined_errors_rank_last(spark):
    zero = {p: None for p in lcz.PARAMETERS} | {
        "building_surface_fraction": 50.0, "impervious_surface_fraction": 50.0, "pervious_surface_fraction": 0.0,
        "sky_view_factor": 0.0}
    scores = {r.lcz_class: r.score for r in lcz.lcz_scores(cells(spark, zero)).collect()}
    # Class 1 holds everything but a sky view of 0, whose relative error is undefined.
    assert scores["1"] is None
    row = lcz.lcz_classify(cells(spark, zero)).first()
    assert row.lcz_class != "1" or row.lcz_score is None


def test_explanation(spark):
    rows = {(r.lcz_class, r.param): r.explanation for r in lcz.lcz_explain(cells(spark, {})).collect()}
    assert rows["10", "sky_view_factor"] == "perfect match"
    assert rows["10", "aspect_ratio"] == "(0.2, 0.5)"
    assert rows["8", "anthropogenic_heat"] == "(0, 50)"
    assert ("10", "surface_admittance") not in rows


def test_attach_parameters_checks_names(spark):
    with pytest.raises(ValueError, match="colour"):
        lcz.attach_parameters(cells(spark, {}), spark.range(1).select(F.col("id").alias("cell_id"), F.lit(1).alias("colour")))


def test_unknown_description(spark):
    df = spark.createDataFrame([("Z",)], "lcz_class STRING")
    assert lcz.lcz_describe(df).first().description == lcz.UNKNOWN_CLASS
