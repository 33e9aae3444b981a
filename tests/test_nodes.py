import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from varve.operators import importance
from varve.operators.learners import base_learners


@pytest.fixture(scope="module")
def rows(spark):
    """y has steps at 4 and 8 of x in 0..11; z is constant."""
    x = F.col("id") % 12
    table = spark.range(240).select(
        F.col("id").cast("string").alias("key"), x.cast("double").alias("x"), F.lit(3.0).alias("z"),
        F.when(x < 4, 0.0).when(x < 8, 10.0).otherwise(100.0).alias("y"),
    )
    return VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(table)


def test_known_tree(spark, rows):
    model = RandomForestRegressor(labelCol="y", numTrees=1, maxDepth=2, bootstrap=False, featureSubsetStrategy="all").fit(rows)
    nodes = {r["node"]: r for r in importance.node_table(spark, model).collect()}
    assert len(nodes) == 5
    root = nodes[0]
    assert root["feature"] == 0 and root["n"] == 240 and 7 <= root["threshold"] < 8
    left, right = nodes[root["left"]], nodes[root["right"]]
    assert (left["n"], right["n"], right["value"], right["feature"]) == (160, 80, 100.0, -1)
    assert 3 <= left["threshold"] < 4 and right["threshold"] is None and right["left"] == -1
    found = {k: {r["feature"]: r["importance"] for r in importance.split_importance(spark, {"m": model}, ["x", "z"], k).collect()} for k in importance.KINDS}
    assert found["splits"] == {"x": 2.0, "z": 0.0} and found["cover"] == {"x": 400.0, "z": 0.0}
    y = np.repeat([0.0, 10.0, 100.0], 80)
    assert found["gain"]["x"] == pytest.approx(((y - y.mean()) ** 2).sum()) and found["gain"]["z"] == 0


def test_counts_agree_with_the_models_own(spark, rows):
    for learner in (GBTRegressor(labelCol="y", maxIter=3, maxDepth=3), RandomForestRegressor(labelCol="y", numTrees=4, maxDepth=3)):
        model = learner.fit(rows)
        nodes = importance.node_table(spark, model)
        assert nodes.count() == model.totalNumNodes and nodes.select("tree").distinct().count() == model.getNumTrees
    with pytest.raises(ValueError, match="kind"):
        importance.split_importance(spark, {}, ["x"], "weight")


def test_extra_trees_in_a_pipeline(spark, rows):
    model = base_learners(["x", "z"], "y", {"et": {"n_estimators": 3, "max_depth": 12}}, ["et"])["et"].fit(rows.drop("features"))
    nodes = importance.node_table(spark, model)
    # Children hold the rows of their parent.
    a, b, c = (nodes.alias(n) for n in "abc")
    both = a.join(b, (F.col("a.tree") == F.col("b.tree")) & (F.col("a.left") == F.col("b.node"))).join(
        c, (F.col("a.tree") == F.col("c.tree")) & (F.col("a.right") == F.col("c.node"))
    )
    assert both.count() == nodes.where("feature >= 0").count() > 0
    assert both.where("a.n <> b.n + c.n").count() == 0
    y = np.repeat([0.0, 10.0, 100.0], 80)
    gain = importance.split_importance(spark, {"et": model}, ["x", "z"], "gain").where("feature = 'x'").first()["importance"]
    assert gain == pytest.approx(3 * ((y - y.mean()) ** 2).sum())
