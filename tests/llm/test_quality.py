import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from varve.llm import quality


def test_label_model_finds_the_accuracies_that_made_the_votes():
    rng = np.random.default_rng(3)
    good = rng.random(40_000) < 0.8
    catches = np.array([0.6, 0.5, 0.7, 0.4])  # alarms on bad documents
    false = np.array([0.02, 0.01, 0.05, 0.03])  # and on good ones
    votes = np.where(rng.random((len(good), 4)) < np.where(good[:, None], false, catches), 0, 2)
    votes[rng.random(votes.shape) < 0.1] = 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_label_model(patterns, counts.astype(float))
    assert abs(model.prior - good.mean()) < 0.03
    assert np.abs(model.chances[0, :, 0] - catches).max() < 0.05
    assert np.abs(model.chances[1, :, 0] - false).max() < 0.02
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.9


def test_agrees_with_labels_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.score(docs).join(labels, "doc_id").select("accepted", labels["quality"].alias("truth")).collect()
    good, bad = [r["accepted"] for r in out if r["truth"] == 1], [r["accepted"] for r in out if r["truth"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.05


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "word"), (5, "A plain sentence of a few words."), (None, "No id here."), (6, "x " * 100_000), (4, "word")]


def test_edge_cases_and_layout(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = documents(spark, [(i + 100, t) for i, t in rows] + ODD)
    docs = docs.withColumns({c: F.lit(1) for c in ("quality", "Votes", "order", "share", "label")})
    out = {(r["doc_id"], r["text"]): r for r in quality.score(docs.repartition(5)).collect()}
    again = {(r["doc_id"], r["text"]): r for r in quality.score(docs.coalesce(1)).collect()}
    assert len(out) == len(rows) + len(ODD) - 1
    for k, r in out.items():
        assert 0.0 <= r["quality"] <= 1.0 and abs(r["quality"] - again[k]["quality"]) < 1e-6
    assert out[1, None]["votes"] == "1" * len(quality.LABELLERS) and out[5, ODD[4][1]]["accepted"]
    assert not out[6, ODD[6][1]]["accepted"]
    left = quality.drop_rejected(docs)
    assert left.columns == docs.columns


def test_empty_table(spark):
    assert quality.score(documents(spark, [])).count() == 0
