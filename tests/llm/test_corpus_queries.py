"""The registered corpus queries against SQL, and the pipeline against brute force."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import normal
from tests.llm.helpers import components, fold, shingles
from varve.llm import quality
from varve.llm.queries import ORACLES, QUERIES


def test_all_operators_and_the_pipeline_are_registered():
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df, got = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    have, want = normal(df.columns, df.collect()), normal(got.columns, got.fetchall())
    assert len(have[1]) > 0 and have == want


def near(kept, similarity=0.8):
    sets = {k: shingles(t) for k, t in kept.items()}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    ]
    return components(kept, links)


def test_pipeline_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in quality.score(docs).where("accepted").collect()}
    last = {}
    for k, t in sorted(texts.items()):
        last[fold(t)] = k
    kept = {k: texts[k] for k in last.values()}
    kept = {k: kept[k] for k, root in near(kept).items() if k == root}
    items = [re.sub(r"[!-/:-@\[-`{-~]", " ", r["text"]).lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(text):
        w = re.sub(r"[!-/:-@\[-`{-~]", " ", text).lower().split()
        have = {tuple(w[i:i + 5]) for i in range(len(w))}
        return any(sum(tuple(x[i:i + 5]) in have for i in range(len(x) - 4)) >= 0.6 * len(x) - 4 for x in items)

    clean = {k for k, t in kept.items() if not leaks(t)}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} <= clean
    # Rates are near 1, so about 1 - 1/e of the documents are drawn.
    assert len({r["doc_id"] for r in out}) > 0.4 * len(clean) and abs(len(out) - len(clean)) < 6 * len(clean) ** 0.5
    from varve.llm import mixing

    table = docs.where(docs["doc_id"].isin(sorted(clean)))
    assert sorted(r["shuffle_key"] for r in mixing.mix(table).collect()) == sorted(r["shuffle_key"] for r in out)


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).dtypes == docs.dtypes, name
