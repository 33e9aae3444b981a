import math

import pytest
from pyspark.sql import functions as F

from varve.operators import splitting


def _keys(spark, n):
    return spark.range(n).select(F.concat(F.lit("k"), F.col("id")).alias("key"))


@pytest.mark.parametrize("n", [1, 7, 1000, 1001])
def test_exact_split_has_the_exact_size(spark, n):
    out = splitting.exact_split(_keys(spark, n), "key")
    assert out.where("split = 'test'").count() == math.ceil(0.2 * n)


def test_exact_folds_differ_by_one_row_at_most(spark):
    sizes = [r["count"] for r in splitting.exact_folds(_keys(spark, 1003), "key").groupBy("fold").count()
             .orderBy("fold").collect()]
    assert sizes == [201, 201, 201, 200, 200]


def test_many_buckets_give_the_same_cut(spark, monkeypatch):
    few = splitting.exact_split(_keys(spark, 2000), "key").collect()
    monkeypatch.setattr(splitting, "BUCKET_ROWS", 3)
    many = splitting.exact_split(_keys(spark, 2000), "key").collect()
    assert sorted(few) == sorted(many)


def test_keys_that_repeat_across_a_cut_are_an_error(spark):
    keys = spark.range(100).select(F.concat(F.lit("k"), (F.col("id") / 7).cast("int")).alias("key"))
    with pytest.raises(ValueError, match="unique"):
        splitting.exact_split(keys, "key")


def test_labels_do_not_depend_on_partitions(spark):
    def labels(df):
        return sorted(map(tuple, df.select(
            "key", splitting.split_label(F.col("key")), splitting.fold_index(F.col("key")),
            splitting.is_holdout(F.col("key")),
        ).collect()))

    keys = _keys(spark, 3000)
    assert labels(keys.repartition(1)) == labels(keys.repartition(17))
    share = sum(r[1] == "test" for r in labels(keys)) / 3000
    assert abs(share - 0.2) < 0.03
