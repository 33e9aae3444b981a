import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from varve.operators import extra_trees, importance, permute, scaling, search, splitting
from varve.operators.ensemble import EnsembleModel, FoldStack, HoldoutBlend, column_stack, out_of_fold, study_scalers
from varve.operators.extra_trees import ExtraTreesLearner, ExtraTreesModel
from varve.operators.learners import HuberLearner, add_prediction, base_learners, fit_all, scaled
from varve.operators.scaling import ExactRobustScaler
from varve.sources.model_store import load_models, save_models

SMALL = {
    "xgb": {"n_estimators": 3, "max_depth": 3}, "rf": {"n_estimators": 4, "max_depth": 4},
    "lgb": {"n_estimators": 3, "num_leaves": 8, "min_child_samples": 2}, "et": {"n_estimators": 3, "max_depth": 4},
}
FEATURES = ["C1", "T (F)"]


def _data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 2))
    return x, 3 * x[:, 0] + np.where(x[:, 1] > 0.2, 5.0, 0.0) + 20


@pytest.fixture(scope="module")
def rows(spark):
    x, y = _data()
    table = [(f"k{i}", float(a), float(b), float(t), i % 5) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(table, "key string, C1 double, `T (F)` double, y double, fold int").coalesce(2).cache()


def _vectors(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(a), float(t)) for a, t in zip(x, y)], ["features", "label"])


def _check_tree(forest, x, y, node, index, smallest):
    """Each split lies between its rows' values, and node facts match the rows."""
    assert forest.count[node] == len(index)
    assert forest.value[node] == pytest.approx(y[index].mean())
    f = forest.feature[node]
    if f < 0:
        return 1
    v, cut = x[index, f], forest.threshold[node]
    assert v.min() <= cut <= v.max()
    left, right = index[v <= cut], index[v > cut]
    assert min(len(left), len(right)) >= smallest
    sse = lambda i: ((y[i] - y[i].mean()) ** 2).sum()
    assert forest.gain[node] == pytest.approx(sse(index) - sse(left) - sse(right), rel=1e-6, abs=1e-6)
    child = forest.left[node]
    return _check_tree(forest, x, y, child, left, smallest) + _check_tree(forest, x, y, child + 1, right, smallest)


@pytest.mark.parametrize("portion", [4_000_000, 9])
def test_extra_trees_against_brute_force(spark, monkeypatch, portion):
    monkeypatch.setattr("varve.operators.extra_trees.PORTION_NUMBERS", portion)
    x, y = _data(150)
    model = ExtraTreesLearner(numTrees=2, maxDepth=4, minInstancesPerNode=3).fit(_vectors(spark, x, y).repartition(3))
    model.forest.value[: model.forest.trees] = y.mean()  # the root's own mean
    for t in range(2):
        assert _check_tree(model.forest, x, y, t, np.arange(len(x)), 3) > 4


def test_extra_trees_learn_and_do_not_depend_on_partitions(spark, tmp_path):
    x, y = _data(600)
    df = _vectors(spark, x, y)
    one, many = (ExtraTreesLearner(numTrees=8, maxDepth=8).fit(df.repartition(n)) for n in (1, 7))
    assert np.array_equal(one.forest.feature, many.forest.feature)
    assert one.forest.threshold == pytest.approx(many.forest.threshold, rel=1e-9)
    scored = one.transform(df).toPandas()
    assert np.corrcoef(scored["label"], scored["prediction"])[0, 1] ** 2 > 0.97
    shares = one.featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and (shares > 0.1).all()
    one.write().save(str(tmp_path / "et"))
    again = ExtraTreesModel.load(str(tmp_path / "et")).transform(df).toPandas()
    assert np.array_equal(again["prediction"], scored["prediction"])


def test_portions_do_not_change_the_forest(spark, monkeypatch):
    x, y = _data(200)
    df = _vectors(spark, x, y).repartition(3).cache()
    whole = ExtraTreesLearner(numTrees=3, maxDepth=6).fit(df).forest
    monkeypatch.setattr("varve.operators.extra_trees.PORTION_NUMBERS", 7)
    parts = ExtraTreesLearner(numTrees=3, maxDepth=6).fit(df).forest
    assert np.array_equal(whole.feature, parts.feature) and whole.threshold == pytest.approx(parts.threshold, rel=1e-12)


def test_extra_trees_score_empty_batches(spark):
    x, y = _data(50)
    df = _vectors(spark, x, y)
    model = ExtraTreesLearner(numTrees=2, maxDepth=3).fit(df.where("label > 0").repartition(30))
    assert model.transform(df.where("label < -1000")).count() == 0


def test_extra_trees_stop_on_constant_rows(spark):
    constant = _vectors(spark, np.ones((5, 2)), np.arange(5.0))
    model = ExtraTreesLearner(numTrees=2, maxDepth=3).fit(constant)
    assert {r["prediction"] for r in model.transform(constant).collect()} == {2.0}
    pure = _vectors(spark, np.arange(10.0).reshape(5, 2), np.full(5, 4.0))
    assert len(ExtraTreesLearner(numTrees=2, maxDepth=3).fit(pure).forest.feature) == 2


def test_huber_is_a_stationary_point_of_the_published_objective(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = x @ [2.0, -1.0] + 0.5 + rng.normal(0, 0.3, 300)
    y[:30] += 20
    model = HuberLearner().fit(_vectors(spark, x, y))
    w, c, s = model.coefficients.toArray(), model.intercept, model.scale
    assert w == pytest.approx([2, -1], abs=0.1)

    def objective(v):
        r = (y - x @ v[:2] - v[2]) / v[3]
        loss = np.where(abs(r) < 1.35, r**2, 2 * 1.35 * abs(r) - 1.35**2)
        return (v[3] + loss * v[3]).sum() + 1e-4 * (v[:2] ** 2).sum()

    at, h = np.array([*w, c, s]), 1e-6
    gradient = [(objective(at + h * e) - objective(at - h * e)) / (2 * h) for e in np.eye(4)]
    assert np.abs(gradient).max() < 0.05


def test_base_learners_share_one_scaler_and_predict(spark, rows):
    fitted = fit_all({n: (p, rows) for n, p in base_learners(FEATURES, "y", SMALL).items()})
    assert len({id(m.stages[0]) for m in fitted.values()}) == 1
    for name, model in fitted.items():
        out = add_prediction(model, rows, name)
        assert out.columns == [*rows.columns, name]
        assert out.stat.corr("y", name) > 0.9
    gains = importance.impurity_importance(spark, fitted, FEATURES)
    totals = gains.groupBy("model").agg(F.sum("importance").alias("s")).collect()
    assert [r["s"] for r in totals] == pytest.approx([1, 1, 1, 1])


def _mean_learner(name):
    """Predicts the mean of the rows it saw."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=["zero"], outputCol="features"),
        LinearRegression(labelCol="y", predictionCol=name),
    ])


def test_no_row_is_predicted_by_a_model_that_saw_it(spark):
    df = spark.range(100).select(
        F.col("id").cast("string").alias("key"), (F.col("id") % 5).cast("int").alias("fold"), F.lit(0.0).alias("zero")
    ).withColumn("y", F.col("fold").cast("double"))
    out, fitted = out_of_fold({"mean": _mean_learner("mean")}, df)
    got = {(r["fold"], round(r["mean"], 9)) for r in out.collect()}
    assert got == {(k, round((10 - k) / 4, 9)) for k in range(5)}
    assert out.count() == 100 and out.select("key").distinct().count() == 100 and len(fitted) == 5


@pytest.mark.parametrize("passthrough", [True, False])
def test_stack(spark, rows, passthrough, tmp_path):
    bases = base_learners(FEATURES, "y", SMALL, ["rf", "xgb"])
    model = FoldStack(bases, FEATURES, "y", passthrough=passthrough).fit(rows)
    assert model.getInputCols() == ["rf", "xgb"] + (FEATURES if passthrough else [])
    assert model.evaluate(rows) > 0.9
    model.write().save(str(tmp_path / "s"))
    a, b = model.transform(rows), EnsembleModel.load(str(tmp_path / "s")).transform(rows)
    assert sorted(a.collect()) == sorted(b.collect())


def test_blend_and_store(spark, rows, tmp_path):
    bases = base_learners(FEATURES, "y", SMALL, ["rf", "et"])
    fitted = fit_all({n: (p, rows) for n, p in bases.items()})
    blend = HoldoutBlend(bases, "key", "y", fitted=fitted).fit(rows)
    assert blend.getInputCols() == ["rf", "et"] and blend.evaluate(rows) > 0.9
    save_models(spark, {**fitted, "blend": blend}, str(tmp_path / "all"))
    loaded = load_models(spark, str(tmp_path / "all"))
    assert list(loaded) == ["rf", "et", "blend"] and isinstance(loaded["rf"], PipelineModel)
    assert loaded["blend"].bases["et"] is loaded["et"]
    assert sorted(loaded["blend"].transform(rows).collect()) == sorted(blend.transform(rows).collect())


def test_unfitted_ensembles_are_saved_copied_and_tuned(spark, rows, tmp_path):
    bases = base_learners(FEATURES, "y", SMALL, ["rf", "xgb"])
    for est in (FoldStack(bases, FEATURES, "y", passthrough=False), HoldoutBlend(bases, "key", "y", fraction=0.3)):
        path = str(tmp_path / type(est).__name__)
        est.write().save(path)
        again = type(est).load(path)
        assert list(again.bases) == ["rf", "xgb"] and again.meta.getOrDefault("epsilon") == 1.35
        assert {p.name: v for p, v in again.extractParamMap().items()} == {p.name: v for p, v in est.extractParamMap().items()}
        assert again.fit(rows).evaluate(rows) == pytest.approx(est.fit(rows).evaluate(rows), abs=1e-3)
    stack = FoldStack(bases, FEATURES, "y")
    grid = ParamGridBuilder().addGrid(stack.passthrough, [True, False]).build()
    assert [len(m.getInputCols()) for m in stack.fit(rows, grid)] == [4, 2]


def test_column_stack(spark):
    long = spark.createDataFrame(
        [("a", "m", 1.0), ("a", "n", 2.0), ("b", "m", 3.0)], "row_key string, model string, y_pred double"
    )
    assert sorted(map(tuple, column_stack(long, ["m", "n"]).collect())) == [("a", 1.0, 2.0), ("b", 3.0, None)]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300, 5000])
def test_values_are_lent_once_over_the_whole_table(spark, n):
    df = spark.range(n).select(F.concat(F.lit("r"), "id").alias("key"), F.col("id").cast("double").alias("v"))
    df = df.withColumn("w", F.col("v"))
    found = permute.with_lent_values(df.repartition(6), "key", ["v", "w"], repeats=4, seed=42)
    assert found.columns == ["v", "w", "which", "repeat", "lent"]
    rows = found.collect()
    pairings = {}
    for r in rows:
        pairings.setdefault((r["which"], r["repeat"]), []).append((r["v"], r["lent"]))
    assert len(pairings) == (8 if n else 0)
    for p in pairings.values():
        assert sorted(a for a, _ in p) == sorted(b for _, b in p) == [float(i) for i in range(n)]
    if n >= 300:  # a draw of its own each, of the whole table: lenders are near and far, and few rows lend to themselves
        assert len({tuple(sorted(p)) for p in pairings.values()}) == 8
        for p in pairings.values():
            far = np.corrcoef(*np.array(p).T)[0, 1]
            assert abs(far) < 0.25 and sum(a == b for a, b in p) < 12
    again = permute.with_lent_values(df.repartition(1), "key", ["v", "w"], repeats=4, seed=42)
    assert sorted(rows) == sorted(again.collect())


def test_positions_are_dense_where_keys_and_rows_repeat(spark):
    df = spark.range(900).select(F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")).alias("key"), (F.col("id") % 7).alias("v"))
    placed, n = permute.with_positions(df.repartition(5), "key", 42)
    assert n == 900 and sorted(r["position"] for r in placed.collect()) == list(range(900))
    assert placed.groupBy("key", "v").count().where("key = 'hot'").count() == 7


def test_permutation_importance_ranks_the_used_feature_first(spark, rows):
    found = importance.permutation_importance(
        rows, lambda d: d.withColumn("p", 3 * F.col("C1") + 20), ["p"], FEATURES, "y", "key", repeats=3
    )
    drop = {r["feature"]: r["importance"] for r in found.collect()}
    assert drop["C1"] > 0.3 and drop["T (F)"] == pytest.approx(0, abs=1e-12)


def test_rankings(spark):
    table = [("m", f"f{i:02d}", float(i // 2)) for i in range(20)] + [("n", f"f{i:02d}", 100.0 * (i == 3)) for i in range(20)]
    df = spark.createDataFrame(table, "model string, feature string, importance double")
    per_model = importance.top_per_model(df).where("model = 'm'").orderBy("rank").collect()
    assert [r["feature"] for r in per_model][:4] == ["f18", "f19", "f16", "f17"] and len(per_model) == 15
    raw = importance.top_overall(df, 2, normalise=False).where("rank = 1").collect()
    assert {r["feature"] for r in raw} == {"f03"} and len(raw) == 2
    shares = {r["feature"]: r["importance"] for r in importance.mean_importance(df).collect()}
    assert sum(shares.values()) == pytest.approx(1)


def test_candidates_stay_inside_their_space(spark):
    for name, space in search.SPACES.items():
        drawn = search.candidates(spark.range(500).withColumnRenamed("id", "trial"), space).toPandas()
        for p, kind in space.items():
            if isinstance(kind, search.Choice):
                assert set(drawn[p]) == {str(o) for o in kind.options}
            else:
                assert drawn[p].between(kind.low, kind.high).all(), (name, p)
            if isinstance(kind, search.Whole):
                assert set(drawn[p]) <= set(range(kind.low, kind.high + 1, kind.step)) and drawn[p].nunique() > 2


def test_search_finds_the_better_setting(spark, rows):
    space = {"n_estimators": search.Whole(2, 2), "max_depth": search.Whole(1, 5)}
    trials = search.search("rf", rows, FEATURES, "y", trials=3, space=space)
    table = {r["trial"]: r for r in trials.collect()}
    best = search.best_candidate(trials).first()
    assert best["score"] == max(r["score"] for r in table.values()) < 0
    assert search.read_params(best["params"])["n_estimators"] == 2


def test_search_scales_each_fold_once(spark, rows, monkeypatch):
    fits = []
    before = ExactRobustScaler._fit
    monkeypatch.setattr(ExactRobustScaler, "_fit", lambda self, df: fits.append(1) or before(self, df))
    space = {"n_estimators": search.Whole(1, 1), "max_depth": search.Whole(0, 2), "reg_alpha": search.Real(0, 1)}
    trials = search.search("xgb", rows, FEATURES, "y", trials=4, space=space).collect()
    assert len(fits) == 5 and [r["unused"] for r in trials] == [["reg_alpha"]] * 4


def test_search_with_an_empty_fold_and_without_trials(spark, rows):
    space = {"n_estimators": search.Whole(1, 1), "max_depth": search.Whole(0, 0)}
    (some,) = search.search("xgb", rows.where("fold <> 3"), FEATURES, "y", trials=1, space=space).collect()
    assert some["score"] < 0
    assert search.search("xgb", rows, FEATURES, "y", trials=0, space=space).count() == 0


def test_trials_without_a_score_are_passed_over(spark):
    schema = "trial long, params map<string,string>, score double"
    table = [(0, {"a": "x"}, float("nan")), (1, {"a": "y"}, None), (2, {"a": "z"}, -5.0)]
    assert search.best_candidate(spark.createDataFrame(table, schema)).first()["trial"] == 2
    with pytest.raises(Exception, match="no trial has a score"):
        search.best_candidate(spark.createDataFrame(table[:2], schema)).collect()


def test_equal_scores_go_to_the_lowest_trial(spark):
    df = spark.createDataFrame(
        [(2, {"a": "x"}, -1.0), (1, {"a": "y"}, -1.0), (0, {"a": "z"}, -2.0)],
        "trial long, params map<string,string>, score double",
    )
    assert search.best_candidate(df).first()["trial"] == 1
    assert search.read_params({"a": "0.8", "b": "sqrt", "c": "7"}) == {"a": 0.8, "b": "sqrt", "c": 7}


def test_scaler_sees_only_the_rows_of_its_fit(spark, rows):
    model = scaled(LinearRegression(labelCol="y", predictionCol="p"), FEATURES).fit(rows.where("fold <> 0"))
    seen = rows.where("fold <> 0").selectExpr("median(C1) as m").first()["m"]
    assert model.stages[0].getOrDefault("centres")[0] == pytest.approx(seen)


def test_scalers_of_a_study_come_from_the_same_passes(spark, rows, monkeypatch):
    bases = base_learners(FEATURES, "y", {n: {"n_estimators": 1, "max_depth": 1, "num_leaves": 2} for n in ("xgb", "rf", "lgb", "et")})
    alone = {k: bases["xgb"].getStages()[0].fit(rows.where(F.col("fold") != k)) for k in range(5)}
    kept = rows.where(~splitting.is_holdout(F.col("key")))
    alone |= {"seen": bases["xgb"].getStages()[0].fit(kept), "all": bases["xgb"].getStages()[0].fit(rows)}
    calls, quantiles = [], scaling.exact_quantiles
    monkeypatch.setattr(scaling, "exact_quantiles", lambda *a, **k: calls.append(1) or quantiles(*a, **k))
    monkeypatch.setattr(scaling, "quantile_table", lambda *a: pytest.fail("a scaler was fitted on its own"))
    scalers = study_scalers(bases, rows, "key")
    fitted = fit_all({n: (e, rows) for n, e in bases.items()}, scalers=scalers, sets={id(rows): "all"})
    _, folds = out_of_fold(bases, rows, scalers=scalers)
    HoldoutBlend(bases, "key", "y", fitted=fitted, scalers=scalers).fit(rows)
    assert len(calls) == 1
    uid = bases["xgb"].getStages()[0].uid
    params = lambda m: (m.getOrDefault(m.centres), m.getOrDefault(m.scales), m.getInputCols(), m.getOutputCols())
    for name, model in alone.items():
        assert params(scalers[uid, f"without {name}" if isinstance(name, int) else name]) == params(model)
    assert params(folds["rf", 3].stages[0]) == params(alone[3]) and params(fitted["et"].stages[0]) == params(alone["all"])
    out_of_fold(bases, rows)
    assert len(calls) == 2


def test_settings_and_folds_grow_in_the_same_scans(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, fold = rng.integers(0, 6, 900).astype(float), rng.integers(0, 3, 900)
    y = x * x + rng.normal(size=900)
    df = spark.createDataFrame([([float(a)], float(b), int(f)) for a, b, f in zip(x, y, fold)], "x array<double>, y double, fold int")

    def expected(deep):
        maes = []
        for k in range(3):
            out, mine = fold != k, fold == k
            guess = [y[out & (x == v)].mean() if deep else y[out].mean() for v in x[mine]]
            maes.append(np.abs(y[mine] - guess).mean())
        return -np.mean(maes)

    scans, best = [], extra_trees._best_splits
    monkeypatch.setattr(extra_trees, "_best_splits", lambda *a: scans.append(1) or best(*a))
    settings = [{"n_estimators": 1 + i % 3, "max_depth": 12 * (i % 2), "min_samples_leaf": 1 + i % 2} for i in range(12)]
    few = extra_trees.cross_validated_forests(df.repartition(4), settings[:2], 5)
    before = len(scans)
    scores = extra_trees.cross_validated_forests(df.repartition(4), settings, 5)
    assert len(scans) - before <= before + 3  # levels of the deepest tree, whatever the number of settings
    assert few == pytest.approx([expected(False), expected(True)], rel=1e-9)
    assert scores == pytest.approx([expected(i % 2) for i in range(12)], rel=1e-9)
    portions = extra_trees.cross_validated_forests(df.repartition(2), settings, 5, most_nodes=50)
    assert portions == pytest.approx(scores, rel=1e-9)
    assert extra_trees.cross_validated_forests(df, [], 5) == []
    assert np.isnan(extra_trees.cross_validated_forests(df.limit(0), settings[:1], 5)).all()
    with pytest.raises(ValueError):
        extra_trees.cross_validated_forests(df.where("fold = 0"), settings[:1], 5)


def test_a_stopped_search_goes_on_where_it_ended(spark, rows, tmp_path, monkeypatch):
    space = {"max_depth": search.Whole(1, 3), "n_estimators": search.Whole(1, 1), "min_samples_leaf": search.Whole(1, 60)}
    ask = lambda **how: search.search(
        "rf", rows, FEATURES, "y", trials=3, space=space, folds=3, parallelism=1, log=str(tmp_path / "log"), **how
    )
    make, fits = search.BASE_LEARNERS["rf"], []

    def counted(*a):
        fits.append(a)
        if len(fits) == 5:
            raise RuntimeError("stopped")
        return make(*a)

    monkeypatch.setitem(search.BASE_LEARNERS, "rf", counted)
    with pytest.raises(RuntimeError):
        ask()
    kept = spark.read.parquet(str(tmp_path / "log")).count()
    assert 4 <= kept < 9
    fits.clear()
    monkeypatch.setitem(search.BASE_LEARNERS, "rf", lambda *a: fits.append(a) or make(*a))
    resumed = dict(map(tuple, ask().select("trial", "score").collect()))
    assert len(fits) == 9 - kept
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == log.select("key", "fold").distinct().count() == 9
    means = {r["trial"]: r["m"] for r in log.groupBy("trial").agg(F.avg("score").alias("m")).collect()}
    assert resumed == pytest.approx(means)
    fits.clear()
    assert dict(map(tuple, ask().select("trial", "score").collect())) == pytest.approx(resumed) and not fits
