"""Eigenvalues of scenes much wider in one direction than in the others."""

from __future__ import annotations

from parcella.plans.queries import QUERIES


def orders(spark, path, rows):
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_a_wide_scene_keeps_its_small_variances(spark, tmp_path):
    # x is 0 or 89999.98, y 0 or 28.8, all combinations, and z 0: the variances are x * x / 4, y * y / 4 and 0
    rows = [(key, 1, price) for key in (0, 8999998) for price in (0.0, 288000.0)]
    got = tuple(QUERIES["pca_condition"](spark, orders(spark, tmp_path, rows)).first())
    assert got == (round(89999.98**2 / 4, 3), 207.36, 0.0)


def test_one_place_and_none(spark, tmp_path):
    one = QUERIES["pca_condition"](spark, orders(spark, tmp_path / "one", [(7, 1, 3.0)])).first()
    assert tuple(one) == (0.0, 0.0, 0.0)
    none = QUERIES["pca_condition"](spark, orders(spark, tmp_path / "none", [])).first()
    assert tuple(none) == (None, None, None)
