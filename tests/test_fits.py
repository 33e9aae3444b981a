"""How many fits run side by side, and trees grown from equal rows as one."""

import threading
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.operators import extra_trees, learners


class Slow(learners.ExactRobustScaler):
    """A last stage that notes how many fits run at once."""

    running, most, lock = 0, 0, threading.Lock()

    def copy(self, extra=None):
        return self

    def _fit(self, dataset):
        with Slow.lock:
            Slow.running += 1
            Slow.most = max(Slow.most, Slow.running)
        dataset.count()
        with Slow.lock:
            Slow.running -= 1
        return learners.VectorAssembler(inputCols=["v"], outputCol="o")


@pytest.mark.parametrize("room, most", [(150, 1), (250, 2), (10**6, 4)])
def test_fits_side_by_side_stay_in_memory(spark, monkeypatch, room, most):
    rows = spark.range(100).select(F.col("id").cast("double").alias("v"))
    monkeypatch.setattr(learners, "storage_bytes", lambda spark: room * learners.FIT_ROW_BYTES)
    assert learners.fits_that_fit([rows, rows.limit(5)], 4) == most
    Slow.running = Slow.most = 0
    learners.fit_all({i: (learners.Pipeline(stages=[Slow()]), rows) for i in range(6)}, 4)
    assert 1 <= Slow.most <= most


def test_memory_of_the_session(spark):
    assert learners.storage_bytes(spark) > 100 << 20


def grown(df, equal_rows, monkeypatch):
    seen, numbers = [], extra_trees._grown
    monkeypatch.setattr(extra_trees, "EQUAL_ROWS", equal_rows)
    with monkeypatch.context() as m:
        m.setattr(extra_trees, "_grown", lambda rows, *a: seen.append(rows.count()) or numbers(rows, *a))
        plan = extra_trees.Plan(np.full(6, 7), np.array([1, 1, 1, 20, 20, 1]), np.array([-1, 0, 1, -1, 0, 5]), 42)
        return (*extra_trees.grow_forest(df, plan), seen[0])


def test_equal_rows_are_grown_as_one(spark, monkeypatch):
    id_ = F.col("id")
    df = spark.range(3000).select(
        F.array((id_ % 5).cast("double"), (id_ % 3).cast("double")).alias("x"), ((id_ * id_) % 101).cast("double").alias("y"),
        (id_ % 4).cast("int").alias("fold"),
    ).persist()
    one, width, few = grown(df, 4, monkeypatch)
    each, again, all_ = grown(df, 10**9, monkeypatch)
    assert (width, again, few, all_) == (2, 2, 60, 3000)
    for field in ("feature", "left", "count", "tree"):
        assert getattr(one, field).tolist() == getattr(each, field).tolist()
    assert np.allclose(one.value, each.value) and np.allclose(one.threshold, each.threshold) and np.allclose(one.gain, each.gain)
    x = np.array([[a, b] for a in range(5) for b in range(3)], float)
    assert np.allclose(one.predict(x), each.value[each.locate(x)].mean(axis=1))


def test_a_batch_is_walked_tree_by_tree():
    forest = extra_trees.Forest.of_roots(300)
    forest.feature[:], forest.left[:] = 0, 300 + 2 * np.arange(300)
    for field, leaf in (("feature", -1), ("threshold", 0.0), ("left", -1), ("gain", 0.0), ("count", 1)):
        old = getattr(forest, field)
        setattr(forest, field, np.append(old, np.full(600, leaf, old.dtype)))
    forest.value = np.append(forest.value, np.tile([1.0, 3.0], 300))
    x = np.random.default_rng(1).normal(size=(10_000, 2))
    tracemalloc.start()
    guess = forest.predict(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(guess, np.where(x[:, 0] > 0, 3.0, 1.0))
    assert peak < 8 * x.shape[0] * 100  # far less than a number per row and tree


def test_a_walk_takes_as_many_steps_as_its_tree_is_deep():
    forest = extra_trees.Forest.of_roots(3)
    split = lambda *nodes: extra_trees.pd.DataFrame({
        "node": nodes, "feature": 0, "threshold": 0.5 / (len(forest.feature)), "gain": 1.0,
        "left_mean": 0.0, "right_mean": 1.0, "left_n": 1, "right_n": 1,
    })
    forest.grow(split(0, 2))
    forest.grow(split(4, 6))
    forest.grow(split(8))
    assert forest._steps()[3].tolist() == [3, 0, 2]
    x = np.random.default_rng(2).uniform(size=(500, 1))
    for row, found in zip(x[:, 0], forest.locate(x)):
        for tree, at in zip([0, 1, 2], found):
            node = tree
            while forest.feature[node] >= 0:
                node = forest.left[node] + int(row > forest.threshold[node])
            assert node == at


def test_best_split_of_a_slot_needs_rows_on_both_sides():
    cells = {
        "slot": [1, 1, 0, 0, 2, 3], "feature": [1, 0, 0, 1, 0, 0], "n": [10, 10, 8, 8, 5, 6], "s": [0.0, 0.0, 4.0, 4.0, 1.0, 2.0],
        "left_n": [5, 5, 1, 4, 5, 1], "left_s": [3.0, 3.0, 9.0, 3.0, 1.0, 5.0],
    }
    best = extra_trees._best(extra_trees.pa.table(cells), np.array([2, 1, 1, 1]))
    assert best["slot"].tolist() == [0, 1, 3] and best["feature"].tolist() == [1, 0, 0]
    assert best["gain"].tolist() == [9 / 4 + 1 / 4 - 2, 9 / 5 + 9 / 5, 25 + 9 / 5 - 4 / 6]
    assert best[["left_n", "right_n"]].to_numpy().tolist() == [[4, 4], [5, 5], [1, 5]]
    assert len(extra_trees._best(extra_trees.pa.table(cells).slice(0, 0), np.array([1]))) == 0


def test_a_level_takes_one_shuffle_per_scan(spark, monkeypatch):
    plans, arrow = [], type(spark.range(1)).toArrow

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return arrow(df)

    monkeypatch.setattr(type(spark.range(1)), "toArrow", noted)
    rows = spark.range(400).select(F.array(F.rand(1), F.rand(2)).alias("x"), F.rand(3).alias("y"), F.lit(-2).alias("fold"))
    extra_trees.grow_forest(rows, extra_trees.Plan.alike(2, 2, 1, 42))
    assert len(plans) == 4 and all(p.count("Exchange") == 1 for p in plans)
