import pytest
from pyspark.sql import functions as F

from zonalis.operators import zonal
from zonalis.plans import pipeline
from zonalis.schemas import Georef, GridSpec


@pytest.fixture(scope="module")
def pixels(spark):
    return spark.range(40 * 52).selectExpr(
        "id div 52 AS row_idx", "id % 52 AS col_idx", "CAST(id * 7 % 11 AS INT) AS class",
        "CAST((id div 52 div 6 + id % 52 div 8) % 4 = 0 AS INT) AS mask",
        "CAST(1000 + id % 5 * 50 AS DOUBLE) AS albedo",
    ).withColumn("dsm", F.expr("50D + row_idx * 0.03125D + mask * (6 + row_idx % 5)")).cache()


GEO = Georef(0.0, 0.0, 0.5, 0.5, 40, 52)


def result(pixels, block):
    out = pipeline.lcz_grid(pixels, GEO, GridSpec.over(GEO, 3.5), block=block)
    return sorted(tuple(r) for r in out.collect())


def test_blocks_and_partitions_do_not_matter(pixels):
    whole = result(pixels, 256)
    assert len(whole) == 6 * 8
    assert result(pixels.repartition(5, "class"), 7) == whole


def test_large_cells_give_the_same_zones(pixels, monkeypatch):
    whole = result(pixels, 256)
    monkeypatch.setattr(zonal, "BUFFER_PIXELS", 0)
    assert result(pixels, 256) == whole


def test_missing_column(pixels):
    with pytest.raises(ValueError, match="albedo"):
        pipeline.lcz_grid(pixels.drop("albedo"), GEO, GridSpec.over(GEO, 3.5))


def test_cells_outside_the_raster_have_no_class(pixels):
    wide = GridSpec(0.0, 0.0, 5.0, 5, 6)
    rows = pipeline.lcz_grid(pixels, GEO, wide).collect()
    empty = [r for r in rows if r.perc_buildings is None]
    assert len(rows) == 30 and empty
    assert all(r.lcz_status == "missing_building" and r.lcz_class is None for r in empty)
    assert all(r.lcz_status == "ok" and r.lcz_class for r in rows if r.perc_buildings is not None)
