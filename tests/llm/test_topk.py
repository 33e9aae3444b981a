import math
import random

import pytest
from pyspark.sql import functions as F

from varve.llm import topk

SPEC = "vec_id long, embedding array<float>, bucket string, weights string, number int"


def brute(rows, k, factor=1024):
    kept = []
    for key, vector, *_ in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((key, [math.floor(x * factor) for x in vector]))
    out = []
    for q, a in kept:
        if q is None or q % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(a, b)), c is None, c) for c, b in kept if c != q]
        for rank, (s, _, c) in enumerate(sorted(scores, key=lambda t: (t[0], t[1], t[2] or 0))[:k], 1):
            out.append((q, rank, c, max(-topk.LONGEST, min(topk.LONGEST, -s))))
    return sorted(out, key=str)


def found(spark, rows, k, **how):
    df = spark.createDataFrame([(*r, "b", "w", 1) for r in rows], SPEC)
    vectors = df.withColumn("weights", topk.integer_weights(F.col("embedding"), 1024))
    out = topk.top_inner_products(vectors, F.col("vec_id") % 100 == 0, k=k, **how)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("block, chunk, bucket", [(2048, 64, 64), (7, 2, 1)])
def test_equals_brute_force(spark, block, chunk, bucket):
    random.seed(7)
    rows = [(i * 5, [random.choice([0.0, 0.0, random.uniform(-1, 1)]) for _ in range(9)]) for i in range(180)]
    assert found(spark, rows, 10, block=block, query_block=3, bucket=bucket, chunk=chunk) == brute(rows, 10)


def test_missing_parts_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5]), (100, []), (200, [1.0]), (300, None), (400, [1.0, None]), (500, [nan, 1.0]), (600, [inf]),
        (None, [1.0, 0.5]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (3, [1.0, 0.5, 9.0]), (9, [-1.0]), (0, [1.0, 0.5]),
    ]
    want = brute(rows, 4)
    assert found(spark, rows, 4) == want and len(want) == 16
    assert found(spark, rows, 50) == brute(rows, 50)


def test_scores_beyond_a_long_are_cut_to_its_limit(spark):
    rows = [(0, [3e15, 3e15]), (1, [3e15, 3e15]), (2, [-3e15, -3e15]), (3, [3e15, -3e15]), (4, [1.0, 0.0])]
    assert found(spark, rows, 10) == brute(rows, 10)


def test_nothing_to_search(spark):
    assert found(spark, [], 10) == [] and found(spark, [(1, [1.0])], 10) == [] and found(spark, [(100, [1.0])], 10) == []


def test_a_crowd_of_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(3000)] + [(5000, [0.1, 0.1])]
    assert found(spark, rows, 10) == brute(rows, 10)
