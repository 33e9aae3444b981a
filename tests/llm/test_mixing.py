import math

from pyspark.sql import functions as F

from tests.llm.helpers import documents
from varve.llm import mixing


def rows_of(spark, sizes):
    return documents(spark, [(i, f"t{i}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))])


def test_counts_invert_the_poisson_distribution(spark):
    import hashlib

    docs = rows_of(spark, {"a": 300, "b": 50, None: 20})
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, 1.0)], "source string, weight double")
    out = mixing.mix(docs, weights, total=1000).collect()
    have = {}
    for r in out:
        have.setdefault(r["doc_id"], []).append(r["copy"])
    rates = {"a": 200 / 300, "b": 600 / 50, None: 200 / 20}
    for r in docs.collect():
        u = (int(hashlib.md5(f"16/0:{r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rate, k, c = round(rates[r["source"]], 9), 0, 0.0
        p = math.exp(-rate)
        while (c := c + p) < u:
            k += 1
            p *= rate / k
        assert sorted(have.get(r["doc_id"], [])) == list(range(k))
    assert len({r["shuffle_key"] for r in out}) == len(out)


def test_shares_come_near_their_weights_also_at_high_rates(spark):
    docs = rows_of(spark, {"big": 2000, "small": 3})
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    out = {r["source"]: r["count"] for r in mixing.mix(docs, weights, total=4000).groupBy("source").count().collect()}
    assert abs(out["big"] - 2000) < 6 * math.sqrt(2000) and abs(out["small"] - 2000) < 6 * math.sqrt(2000)


def test_edge_cases(spark):
    docs = rows_of(spark, {"a": 3, "zero": 2, "unknown": 2, None: 2})
    weights = spark.createDataFrame([("a", 1.0), ("zero", 0.0), ("other", 5.0)], "source string, weight double")
    assert {r["source"] for r in mixing.mix(docs, weights).collect()} <= {"a"}
    assert mixing.mix(rows_of(spark, {})).count() == 0
    odd = documents(spark, [(None, None, None), (5, "", "s"), (5, "", "s")])
    odd = odd.withColumns({c: F.lit(9) for c in ("of", "pieces", "cdf", "times", "copy", "n", "rate", "weight")})
    out = mixing.mix(odd, total=60).collect()
    assert out and set(r["doc_id"] for r in out) == {None, 5}
    # Other columns keep their values; a column ``copy`` is replaced by the number of the copy.
    assert {r[c] for r in out for c in ("of", "pieces", "cdf", "times", "n", "rate", "weight")} == {9}
    assert 0 in {r["copy"] for r in out} and out[0].asDict().keys() >= {"copy", "shuffle_key"}


def test_the_draw_does_not_depend_on_the_layout(spark):
    docs = rows_of(spark, {"a": 100, "b": 10})
    one = sorted(r["shuffle_key"] for r in mixing.mix(docs.coalesce(1)).collect())
    assert one == sorted(r["shuffle_key"] for r in mixing.mix(docs.repartition(7)).collect())
