import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varve.functions.labels import interval_labels
from varve.operators import diagnostics
from varve.operators.evaluation import METRICS, ErrorEvaluator, cross_validated_score, report


def _table(spark, pairs, model="m"):
    return spark.createDataFrame([(model, float(y), float(p)) for y, p in pairs], "model string, y_true double, y_pred double")


def _one(spark, pairs, **kw):
    return report(_table(spark, pairs), by=["model"], **kw).first().asDict()


@pytest.mark.parametrize("limit", [10**6, 50])
def test_metrics_against_numpy(spark, limit):
    rng = np.random.default_rng(3)
    y = rng.normal(50, 10, 501)
    p = y + rng.normal(0, 3, 501)
    got = _one(spark, zip(y, p), limit=limit)
    e = y - p
    want = {
        "r2": 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(), "mae": abs(e).mean(), "mse": (e**2).mean(),
        "medae": np.median(abs(e)), "rmse": (e**2).mean() ** 0.5, "mape": (abs(e) / abs(y)).mean() * 100,
    }
    assert {m: got[m] for m in METRICS} == pytest.approx(want, rel=1e-12)


def test_zero_and_constant_targets(spark):
    assert _one(spark, [(0, 1)])["mape"] == pytest.approx(100 / 2.220446049250313e-16)
    assert _one(spark, [(0, 1)])["r2"] is None
    assert _one(spark, [(3, 3), (3, 3)])["r2"] == 1.0
    assert _one(spark, [(3, 3), (3, 4)])["r2"] == 0.0


def test_missing_values_take_part_in_no_metric(spark):
    rows = [("m", 1.0, 1.5), ("m", 2.0, 2.0), ("m", 4.0, 3.0), ("m", 50.0, None), ("m", 60.0, float("nan")), ("m", None, 7.0)]
    df = spark.createDataFrame(rows, "model string, y_true double, y_pred double")
    got = report(df, by=["model"]).first()
    want = report(df.limit(3), by=["model"]).first()
    assert (got["n"], got["n_missing"], want["n_missing"]) == (3, 3, 0)
    assert [got[m] for m in METRICS] == pytest.approx([want[m] for m in METRICS]) and got["r2"] < 1
    with pytest.raises(ValueError, match="lack"):
        ErrorEvaluator(metric="mae", labelCol="y_true", predictionCol="y_pred").evaluate(df)
    folds = df.withColumn("fold", F.lit(0))
    assert cross_validated_score(folds).first()["score"] is None


def test_evaluator(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 1.0)], "label double, prediction double")
    assert ErrorEvaluator(metric="medae").evaluate(df) == 1.0
    assert ErrorEvaluator(metric="mae").evaluate(df) == pytest.approx(4 / 3)
    assert ErrorEvaluator(metric="r2").isLargerBetter() and not ErrorEvaluator(metric="mape").isLargerBetter()
    ErrorEvaluator(metric="mape").write().save(str(tmp_path / "e"))
    assert ErrorEvaluator.load(str(tmp_path / "e")).evaluate(df) == pytest.approx(100 * (1 + 0.75) / 3)


def test_folds_count_alike_in_the_cross_validated_score(spark):
    df = spark.createDataFrame(
        [("m", 0, 0.0, 1.0), ("m", 0, 0.0, 1.0), ("m", 0, 0.0, 1.0), ("m", 1, 0.0, 5.0)],
        "model string, fold int, y_true double, y_pred double",
    )
    assert cross_validated_score(df).first()["score"] == -3.0


TIES = [1, 1, 1, 2, 2, 3, 4, 5, 6, 10]


def test_bins_with_ties_and_labels(spark):
    df = _table(spark, [(v, v) for v in TIES])
    out = diagnostics.with_quantile_bins(df, "y_true", 5, ["model"]).orderBy("y_true").collect()
    assert [r["bin"] for r in out] == [0, 0, 0, 0, 0, 1, 2, 2, 3, 3]
    assert sorted({r["label"] for r in out}) == ["(0.999, 2.0]", "(2.0, 3.4]", "(3.4, 5.2]", "(5.2, 10.0]"]


@pytest.mark.parametrize("q", [2, 5, 10])
def test_bins_equal_pandas(spark, q):
    rng = np.random.default_rng(q)
    for values in [rng.normal(size=300), np.round(rng.lognormal(1, 1, 200), 1), rng.integers(0, 4, 100) * 0.0001 + 1]:
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        out = sorted(map(tuple, diagnostics.with_quantile_bins(df, "v", q).select("v", "bin", "label").collect()))
        s = pd.Series(np.sort(values))
        bins, labels = pd.qcut(s, q, labels=False, duplicates="drop"), pd.qcut(s, q, duplicates="drop").astype(str)
        assert out == [(float(v), int(b), t) for v, b, t in zip(s, bins, labels)]


def test_close_edges_get_more_decimals(spark):
    df = spark.createDataFrame([(1.0001,), (1.0002,), (1.0003,), (1.0004,)], "v double")
    labels = [r["label"] for r in diagnostics.with_quantile_bins(df, "v", 2).orderBy("v").collect()]
    assert labels[0] == str(pd.qcut(pd.Series([1.0001, 1.0002, 1.0003, 1.0004]), 2).iloc[0])


def test_label_rounds_ties_to_even():
    values = [860.8045, 2000.0, 3000.0, 4000.0]
    cells = pd.qcut(pd.Series(values), 1)
    assert interval_labels([860.8045, 4000.0]) == [str(cells.iloc[0])] == ["(860.803, 4000.0]"]


def test_constant_predictions_have_no_deciles(spark):
    df = _table(spark, [(v, 5) for v in range(6)])
    out = diagnostics.with_quantile_bins(df, "y_pred", 10, ["model"]).collect()
    assert [r["bin"] for r in out] == [None] * 6
    assert diagnostics.calibration(df).count() == 0


def test_calibration_and_range_errors_equal_pandas(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(100, 20, 400)
    p = y + rng.normal(0, 5, 400)
    pdf = pd.DataFrame({"yt": y, "yp": p})
    want = pdf.groupby(pd.qcut(pdf.yp, 10, labels=False)).agg(yp=("yp", "mean"), yt=("yt", "mean"))
    got = diagnostics.calibration(_table(spark, zip(y, p))).toPandas()
    assert got["mean_pred"].to_numpy() == pytest.approx(want["yp"].to_numpy())
    assert got["mean_true"].to_numpy() == pytest.approx(want["yt"].to_numpy())
    cells = pd.qcut(pdf.yt, 5)
    errors = (pdf.yt - pdf.yp).abs() / pdf.yt.abs() * 100
    ranged = diagnostics.error_by_range(_table(spark, zip(y, p))).toPandas()
    assert list(ranged["label"]) == [str(c) for c in cells.cat.categories]
    assert ranged["mape"].to_numpy() == pytest.approx(errors.groupby(cells, observed=True).mean().to_numpy())


def test_limits_ranking_and_parity(spark):
    df = _table(spark, [(10, 20), (30, 5)], "a").union(_table(spark, [(10, 10), (30, 31)], "b"))
    limits = {r["model"]: (r["lower"], r["upper"]) for r in diagnostics.axis_limits(df).collect()}
    assert limits["a"] == pytest.approx((5 * 0.97, 30 * 1.03))
    assert limits["(all)"] == pytest.approx((5 * 0.97, 31 * 1.03))
    assert [r["model"] for r in diagnostics.rank_by_error(df).orderBy("rank").collect()] == ["b", "a"]
    parity = diagnostics.parity_table(df)
    assert parity.count() == 4 and parity.select(F.countDistinct("r2")).first()[0] == 2
