"""Trees over binned rows against Spark's own learners, and the work that a fit takes."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from varve.operators import binned_trees, importance
from varve.operators.binned_trees import BinnedBoosting, BinnedForest
from varve.operators.learners import base_learners, fit_all


@pytest.fixture(scope="module")
def rows(spark):
    """Few values per feature, so that bins are the same whatever rows they come from."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, [6, 9, 1], (500, 3)).astype(float)
    y = x[:, 0] ** 2 - 3 * x[:, 1] * (x[:, 0] > 2) + rng.normal(size=500) + 100
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"]).repartition(3).cache()


def guesses(model, rows):
    return np.array([r["prediction"] for r in model.transform(rows).select("prediction").collect()])


def nodes(spark, model):
    table = importance.node_table(spark, model).orderBy("tree", "node").drop("left", "right", "node").collect()
    return sorted(tuple(-1e9 if v is None else round(float(v), 6) for v in r) for r in table)


@pytest.mark.parametrize("cells", [True, False])
@pytest.mark.parametrize("params", [
    {"maxIter": 4, "maxDepth": 3}, {"maxIter": 2, "maxDepth": 0}, {"maxIter": 3, "maxDepth": 4, "minInstancesPerNode": 20, "stepSize": 0.3},
])
def test_boosting_is_that_of_spark(spark, rows, monkeypatch, params, cells):
    monkeypatch.setattr(binned_trees, "CELLS", 1 << 20 if cells else 0)
    monkeypatch.setattr(binned_trees, "BLOCK", 64)
    mine, spark_s = BinnedBoosting(**params).fit(rows), GBTRegressor(**params).fit(rows)
    assert isinstance(mine, GBTRegressionModel) and mine.treeWeights == spark_s.treeWeights
    assert np.allclose(guesses(mine, rows), guesses(spark_s, rows), rtol=1e-9)
    assert nodes(spark, mine) == nodes(spark, spark_s)
    assert np.allclose(mine.featureImportances.toArray(), spark_s.featureImportances.toArray())


def test_a_tree_of_all_rows_is_that_of_spark(spark, rows):
    params = {"numTrees": 1, "maxDepth": 5, "bootstrap": False, "featureSubsetStrategy": "all", "minInfoGain": 0.05}
    mine, spark_s = BinnedForest(**params).fit(rows), RandomForestRegressor(**params).fit(rows)
    assert nodes(spark, mine) == nodes(spark, spark_s)


def test_forests_from_cells_and_from_rows_are_the_same(spark, rows, monkeypatch):
    params = {"numTrees": 5, "maxDepth": 6, "seed": 3, "featureSubsetStrategy": "all"}
    one = BinnedForest(**params).fit(rows)
    monkeypatch.setattr(binned_trees, "CELLS", 0)
    monkeypatch.setattr(binned_trees, "PORTION_NUMBERS", 200)
    two = BinnedForest(**params).fit(rows)
    monkeypatch.setattr(binned_trees, "DRIVER_BYTES", 0)
    three = BinnedForest(**params).fit(rows)
    assert nodes(spark, one) == nodes(spark, two) == nodes(spark, three)
    drawn = [r["n"] for r in importance.node_table(spark, one).where("node = 0").collect()]
    assert len(set(drawn)) > 1 and all(380 < n < 620 for n in drawn)  # a bootstrap of its own each


def test_a_share_of_the_rows_per_round(rows, monkeypatch):
    learner = BinnedBoosting(maxIter=4, maxDepth=3, subsamplingRate=0.5, seed=1)
    one = guesses(learner.fit(rows), rows)
    monkeypatch.setattr(binned_trees, "CELLS", 0)
    assert np.allclose(one, guesses(learner.fit(rows), rows))


def test_a_fit_takes_few_jobs_whatever_its_rounds(spark, rows):
    context = spark.sparkContext
    y = F.col("label")
    table = rows.select(y.alias("y"), (y * 7 % 13).alias("a"), (y % 3).alias("b"))
    params = {"xgb": {"n_estimators": 12, "max_depth": 5}, "rf": {"n_estimators": 6, "max_depth": 8}}
    for name, pipeline in base_learners(["a", "b"], "y", params, list(params)).items():
        context.setJobGroup(f"jobs of {name}", name)
        try:
            model = fit_all({0: (pipeline, table)}, 1)[0]
            assert model.stages[-1].totalNumNodes > 50
            jobs = len(context.statusTracker().getJobIdsForGroup(f"jobs of {name}"))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        assert jobs < 25  # a job per level would be 60 for the rounds of xgb


def test_learners_on_the_same_rows_count_their_values_once(rows, monkeypatch):
    reads, read = [], binned_trees.ValueSums._read
    monkeypatch.setattr(binned_trees.ValueSums, "_read", lambda self, df: reads.append(1) or read(self, df))
    table = rows.select(F.col("label").alias("y"), (F.col("label") % 3).alias("a"))
    params = {"xgb": {"n_estimators": 1, "max_depth": 1}, "rf": {"n_estimators": 1, "max_depth": 1}, "lgb": {"n_estimators": 1, "num_leaves": 2}}
    bases = base_learners(["a"], "y", params, list(params))
    fit_all({(n, i): (e, part) for i, part in enumerate([table, table.limit(400)]) for n, e in bases.items()})
    assert len(reads) == 2


def test_summaries_keep_all_counts():
    values, counts = np.unique(np.random.default_rng(1).normal(size=50_000), return_counts=True)
    few, weight = binned_trees.thinned(values, counts, 100)
    assert len(few) <= 100 and weight.sum() == 50_000 and few[-1] == values[-1] and weight.max() <= 502
    cuts = binned_trees.thresholds(few, weight, 10)
    assert len(cuts) == 9 and np.abs(np.searchsorted(values, cuts) / 50_000 - np.arange(1, 10) / 10).max() < 0.011
    assert binned_trees.thresholds(np.array([1.0, 2.0, 5.0]), np.array([1, 90, 9]), 32).tolist() == [1.5, 3.5]
    assert binned_trees.thresholds(np.array([4.0]), np.array([7]), 32).tolist() == []


def test_missing_values_are_refused(spark, rows):
    for bad in (None, float("nan")):
        broken = rows.withColumn("label", F.when(F.rand(1) < 0.5, F.lit(bad)).otherwise(F.col("label")))
        with pytest.raises(Exception, match="must not be"):
            BinnedForest(numTrees=2).fit(broken)
    with pytest.raises(ValueError, match="no rows"):
        BinnedBoosting(maxIter=1).fit(rows.limit(0))


def test_an_unfitted_learner_is_stored_as_what_it_is(tmp_path):
    learner = BinnedBoosting(maxIter=7, stepSize=0.2, labelCol="y")
    learner.write().save(str(tmp_path / "l"))
    again = BinnedBoosting.load(str(tmp_path / "l"))
    assert type(again) is BinnedBoosting and (again.getMaxIter(), again.getStepSize(), again.getLabelCol()) == (7, 0.2, "y")


@pytest.mark.parametrize("word, features", [("all", 9), ("auto", 3), ("onethird", 3), ("sqrt", 3), ("log2", 4), ("0.5", 5), ("2", 2)])
def test_features_of_a_node(word, features):
    assert binned_trees.features_of_a_node(word, 9, 5) == features
