import math

import pytest
from pyspark.sql import functions as F

from varve.operators import cleaning
from varve.operators.scaling import ExactRobustScaler, ExactRobustScalerModel


def test_rows_that_differ_only_in_the_reference_survive(spark):
    df = spark.createDataFrame(
        [(1, 2.0), (1, 2.0), (2, 2.0), (None, 3.0), (3, math.nan), (3, None)], "ref int, v double"
    )
    assert sorted(r["v"] for r in cleaning.clean_table(df).collect()) == [2.0, 2.0]


def test_fence_keeps_both_ends(spark):
    # Quartiles 2 and 4, fence [-1, 7].
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5]], "v double")
    assert cleaning.fence(df, "v") == (-1.0, 7.0)
    wide = df.union(spark.createDataFrame([(-1.0,), (7.0,), (7.5,), (-1.5,)], "v double"))
    lo, hi = cleaning.fence(wide, "v")
    kept = sorted(r["v"] for r in cleaning.within_fence(wide, "v").collect())
    assert kept == sorted(v for v in [1, 2, 3, 4, 5, -1, 7, 7.5, -1.5] if lo <= v <= hi)
    on_first = cleaning.within_fence(wide, "v", fit_on=F.col("v").isin(1.0, 2.0, 3.0, 4.0, 5.0))
    assert sorted(r["v"] for r in on_first.collect()) == [-1, 1, 2, 3, 4, 5, 7]


def test_features_must_be_numeric(spark):
    df = spark.createDataFrame([("k", 1.0, 2, 3.0)], "key string, `C7+` double, n int, y double")
    assert cleaning.feature_columns(df, "y", ["key"]) == ["C7+", "n"]
    with pytest.raises(TypeError):
        cleaning.feature_columns(df, "y")


def test_composition_of_symbols(spark):
    names = cleaning.COMPOSITION
    schema = ", ".join(f"`{n}` double" for n in names)
    df = spark.createDataFrame([tuple(float(i) for i in range(10)), (0.0,) * 10, (None,) + (1.0,) * 9], schema)
    rows = [r.asDict() for r in cleaning.normalise_composition(df, names).collect()]
    assert sum(rows[0].values()) == pytest.approx(100)
    assert all(v is None for v in rows[1].values())
    assert rows[2]["N2 (mol%)"] is None and rows[2]["C7+"] == pytest.approx(100 / 9)


def test_clipper_keeps_missing_values_missing(spark, tmp_path):
    df = spark.createDataFrame([(float(v), "x") for v in [1, 2, 3, 4, 5, 100]] + [(None, "x")], "v double, t string")
    model = cleaning.FenceClipper().fit(df.where("v < 50"))
    model.write().save(str(tmp_path / "m"))
    again = cleaning.FenceClipperModel.load(str(tmp_path / "m"))
    for m in (model, again):
        out = [r["v"] for r in m.transform(df).collect()]
        assert out == [1, 2, 3, 4, 5, 7, None]


def test_clipper_coerces_and_normalises(spark):
    df = spark.createDataFrame([("1", 1.0), ("3", 3.0), ("x", 5.0), ("0", 0.0)], "a string, b double")
    out = cleaning.FenceClipper(inputCols=["a", "b", "absent"]).fit(df).transform(df).collect()
    assert [(r["a"], r["b"]) for r in out] == [(50, 50), (50, 50), (None, 100), (None, None)]


def test_scaler_is_exact_and_keeps_constant_columns(spark, tmp_path):
    df = spark.createDataFrame([(float(v), 7.0) for v in [1, 2, 3, 4]], "`x (%)` double, z double")
    model = ExactRobustScaler(inputCols=["x (%)", "z"], outputCols=["sx", "sz"]).fit(df)
    assert model.getOrDefault("centres") == [2.5, 7.0]
    assert model.getOrDefault("scales") == [1.5, 1.0]
    model.write().save(str(tmp_path / "s"))
    out = ExactRobustScalerModel.load(str(tmp_path / "s")).transform(df).collect()
    assert [r["sx"] for r in out] == pytest.approx([-1, -1 / 3, 1 / 3, 1])
    assert {r["sz"] for r in out} == {0.0}
