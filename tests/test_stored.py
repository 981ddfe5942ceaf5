"""Layers stored by block meet without a shuffle."""

import uuid

import pytest
from pyspark.sql import functions as F

from zonalis.operators import algebra
from zonalis.sources import stored


@pytest.fixture
def layers(spark, tmp_path):
    long = spark.range(6000).selectExpr(
        "IF(id % 3 = 0, 'dsm', IF(id % 3 = 1, 'class', 'rest')) AS layer", "1 AS band", "id div 3 div 50 AS row_idx", "id div 3 % 50 AS col_idx",
        "IF(id % 7 = 0, NULL, double(id)) AS value").where("layer <> 'class' OR row_idx <> 5")
    name = f"t_{uuid.uuid4().hex}"
    for layer in ("dsm", "class", "rest"):
        stored.store_blocks(long.where(F.col("layer") == layer), name, 6, block=16, path=str(tmp_path / "t"))
    yield long, name
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("how", ["inner", "outer"])
def test_same_rows_and_no_exchange(spark, layers, how):
    long, name = layers
    out = stored.align_stored(spark, name, ["dsm", "class"], how=how)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    rows = lambda df: sorted(((r.row_idx, r.col_idx, r.dsm, r["class"]) for r in df.collect()), key=lambda x: [(v is None, v) for v in x])
    plain = rows(algebra.align_layers(long, ["dsm", "class"], how=how))
    assert rows(out) == plain
    assert len(plain) == (1950 if how == "inner" else 2000)


def test_block_groups_stay_in_place(spark, layers):
    _, name = layers
    per_block = stored.read_blocks(spark, name, ["dsm"]).groupBy("br", "bc").agg(F.count("*").alias("n"))
    assert "Exchange" not in per_block._jdf.queryExecution().executedPlan().toString()
    assert {(r.br, r.bc): r.n for r in per_block.collect()}[0, 0] == 256
