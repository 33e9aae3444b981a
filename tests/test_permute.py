"""Values that rows borrow: the wide form, and the plan of the join."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varve.operators import importance, permute


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 7, 900])
def test_arrays_hold_what_the_long_rows_hold(spark, n):
    df = spark.range(n).select(
        (F.col("id") % 50).cast("string").alias("key"), "id", F.when(F.col("id") % 3 != 0, F.col("id") / 2).alias("v"), F.col("id").alias("w")
    )
    long = permute.with_lent_values(df.repartition(5), "key", ["v", "w"], 3, 42).collect()
    wide = permute.rows_with_lent_values(df.repartition(5), "key", ["v", "w"], 3, 42)
    assert wide.columns == ["id", "v", "w", "lent"]
    cells = {(r["id"], i, k + 1): x for r in wide.collect() for i, values in enumerate(r["lent"]) for k, x in enumerate(values)}
    assert cells == {(r["id"], r["which"], r["repeat"]): r["lent"] for r in long}
    assert len(long) == 6 * n and len(cells) == 6 * n


def test_lent_values_are_neither_sorted_nor_shuffled_twice(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("key"), "id", F.col("id").cast("double").alias("v"))
    for rows in (permute.with_lent_values(df, "key", ["v"], 2, 42), permute.rows_with_lent_values(df, "key", ["v"], 2, 42)):
        text = plan(rows)
        assert "ShuffledHashJoin" in text and "Sort " not in text
        assert text.count("Exchange hashpartitioning") == 2


def test_positions_that_leave_the_table_come_back(spark):
    for n in (1, 2, 3, 5, 10, 4097):
        keys = permute._keys("seed")
        x = permute._image(pa.array(range(n), pa.int64()).to_numpy(), keys, n)
        assert sorted(x.tolist()) == list(range(n))


def test_models_are_added_up_side_by_side(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("key"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    df = df.withColumn("y", 3 * F.col("a") + F.col("b"))
    forms = {"exact": F.col("y"), "sum": 3 * F.col("a") + F.col("b"), "none": F.lit(None).cast("double")}
    found = importance.permutation_importance(df, lambda d: d.withColumns(forms), list(forms), ["a", "b"], "y", "key", repeats=2)
    assert not re.search(r"keys=\[model#\d+, which", plan(found))
    drops = {(r["model"], r["feature"]): r["importance"] for r in found.collect()}
    assert drops["exact", "a"] == drops["exact", "b"] == 0 and drops["sum", "a"] > drops["sum", "b"] > 0
    assert drops["none", "a"] is None and len(drops) == 6
