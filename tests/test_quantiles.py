import math

import numpy as np
import pytest

from varve.operators.quantiles import exact_quantiles, quantile_table

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def _rows():
    rng = np.random.default_rng(7)
    # Skewed values; a third of group a is one value; group c has one row.
    a = np.concatenate([rng.lognormal(3, 2, 4000), np.full(2000, 5.5)])
    b = rng.normal(0, 1e-3, 3000)
    groups = [("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("c", 4.25)]
    return groups + [("a", None), ("b", math.nan)]


@pytest.mark.parametrize("limit", [10**6, 10_000, 20])
def test_equals_numpy(spark, limit):
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {(r["g"], r["p"]): r["value"] for r in exact_quantiles(df, ["v"], PROBABILITIES, ["g"], limit).collect()}
    assert len(found) == 3 * len(PROBABILITIES)
    for g in "abc":
        values = [v for h, v in rows if h == g and v is not None and not math.isnan(v)]
        for p in PROBABILITIES:
            assert found[(g, p)] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-15)


@pytest.mark.parametrize("limit", [10**6, 5])
def test_several_columns_without_groups(spark, limit):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(800, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "x double, `y (%)` double")
    found = quantile_table(df, ["x", "y (%)"], [0.25, 0.75], limit=limit)
    for i, c in enumerate(["x", "y (%)"]):
        assert found[c] == pytest.approx(np.quantile(data[:, i], [0.25, 0.75]), rel=1e-12)


def test_narrowing_through_several_passes(spark):
    # More distinct values than two grids can tell apart, with an extreme one.
    df = spark.range(60_000).selectExpr("cast(id * id as double) as v").union(
        spark.sql("select cast(1e300 as double) as v")
    )
    values = np.append(np.arange(60_000, dtype=float) ** 2, 1e300)
    found = quantile_table(df, ["v"], [0.3, 0.5, 0.999], limit=3)["v"]
    assert found == pytest.approx(np.quantile(values, [0.3, 0.5, 0.999]), rel=1e-12)


def test_empty_table(spark):
    df = spark.createDataFrame([], "v double")
    assert quantile_table(df, ["v"], [0.5])["v"] == [None]


def test_a_bracket_whose_ends_hold_nearly_all_rows(spark):
    # The median lies among a few thousand values between two hot ones.
    values = np.concatenate([np.zeros(30_000), np.linspace(0.25, 0.75, 3001), np.ones(30_000)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for p in (0.1, 0.4, 0.5, 0.52, 0.9):
        assert quantile_table(df, ["v"], [p], limit=50)["v"] == pytest.approx([np.quantile(values, p)], rel=1e-12)


def test_groups_with_null_keys_and_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", None), ("b", 5.0)], "g string, v double")
    assert {r["g"]: r["value"] for r in exact_quantiles(df, ["v"], [0.5], ["g"]).collect()} == {None: 1.5, "b": 5.0}


def test_signs_zeros_infinities_and_tiny_differences(spark):
    values = [-math.inf, -1e300, -1.0, np.nextafter(-1.0, 0), -5e-324, -0.0, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2), 1e300, math.inf]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    ranks = [i / (len(values) - 1) for i in range(len(values))]
    found = quantile_table(df, ["v"], ranks)["v"]
    assert found == sorted(values) and math.copysign(1, found[5]) == 1.0


def test_sets_of_labels_equal_quantiles_of_their_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 5), float(v)) for i, v in enumerate(rng.lognormal(0, 2, 4000))] + [(None, 1e9)]
    df = spark.createDataFrame(rows, "fold int, v double").repartition(6)
    sets = {"all": [0, 1, 2, 3, 4, None], **{f"not {k}": [j for j in range(5) if j != k] for k in range(5)}, "no rows": [9]}
    members = spark.createDataFrame([(j, n) for n, labels in sets.items() for j in labels], "label int, member_of string")
    found = exact_quantiles(df, ["v"], [0.25, 0.5, 0.75], ["fold"], members=members).collect()
    have = {(r["member_of"], r["p"]): r["value"] for r in found}
    assert len(have) == 18
    for name, labels in sets.items():
        for p in (0.25, 0.5, 0.75):
            values = [v for k, v in rows if k in labels]
            assert not values or have[name, p] == pytest.approx(np.quantile(values, p), rel=1e-12)
