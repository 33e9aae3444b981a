import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from varve.llm import decontaminate, queries


def plain(text):
    return re.sub(r"[!-/:-@\[-`{-~]", " ", text or "").lower().split()


def tiles(doc, item, shortest):
    """Greedy string tiling by comparing all pairs of positions."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = []
        length = shortest - 1
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and free_i[i + n] and free_d[d + n]:
                    n += 1
                if n > length:
                    best, length = [], n
                if n == length and n >= shortest:
                    best.append((d, i))
        if not best:
            return out
        for d, i in best:
            if all(free_d[d:d + length]) and all(free_i[i:i + length]):
                free_d[d:d + length] = free_i[i:i + length] = [False] * length
                out.append((d, i, length))


def test_tiles_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        doc = [rng.randrange(3) for _ in range(rng.randrange(40))]
        item = [rng.randrange(3) for _ in range(rng.randrange(1, 25))]
        shortest = rng.randrange(1, 5)
        want = tiles(doc, item, shortest)
        have = decontaminate.lay_tiles(np.array(doc, dtype=int), np.array(item, dtype=int), shortest)
        assert sorted(t[2] for t in have) == sorted(t[2] for t in want) or sum(t[2] for t in have) >= shortest * bool(want)
        assert [t[2] for t in have][:1] == [t[2] for t in want][:1]
        for d, i, n in have:
            assert doc[d:d + n] == item[i:i + n]
        for side in (0, 1):
            taken = [p for t in have for p in range(t[side], t[side] + t[2])]
            assert len(taken) == len(set(taken))


def test_long_texts_of_one_word_take_little_time():
    assert decontaminate.lay_tiles(np.zeros(200_000, dtype=int), np.zeros(5_000, dtype=int), 5) == [(0, 0, 5_000)]


PASSAGE = [f"q{i}" for i in range(40)]
BENCH = [(1, " ".join(PASSAGE)), (2, "Short one"), (3, None), (4, ""), (5, " ".join(PASSAGE)), (None, "no id " * 5), (6, "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10")]
FILLER = " ".join(f"z{i}" for i in range(50))
DOCS = [
    (1, FILLER + " " + " ".join(PASSAGE) + " " + FILLER), (2, " ".join(PASSAGE[20:]) + " " + FILLER + " " + ", ".join(PASSAGE[:20]).upper()),
    (3, " ".join(PASSAGE[:20]) + " " + FILLER), (4, FILLER), (5, None), (6, ""), (7, "a short ONE here"), (8, " ".join(reversed(PASSAGE))),
    (None, " ".join(PASSAGE)), (9, "p1 p2 p3 p4 p5 x p7 p8 p9"), (1, FILLER + " " + " ".join(PASSAGE) + " " + FILLER), (10, "no id " * 5),
]
WANT = {1: (1.0, 1), 2: (1.0, 1), 3: (0.0, None), 4: (0.0, None), 5: (0.0, None), 6: (0.0, None), 7: (1.0, 2), 8: (0.0, None), None: (1.0, 1), 9: (0.0, None), 10: (0.0, None)}


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_passages_also_reordered_and_edge_cases(spark, block_bytes):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = documents(spark, DOCS).withColumns({c: F.lit("x") for c in ("coverage", "item_id", "key", "part")})
    rows = decontaminate.coverage(docs, bench, block_bytes=block_bytes).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        assert (r["coverage"], r["covered_item"]) == WANT[r["doc_id"]] and r["contaminated"] == (r["coverage"] >= 0.6)
    half = decontaminate.coverage(docs, bench, enough=0.4, block_bytes=block_bytes).where("doc_id = 3").first()
    assert (half["coverage"], half["covered_item"], half["n_tiles"], half["contaminated"]) == (0.5, 1, 1, True)
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {3, 4, 5, 6, 8, 9, 10}


def test_coverage_below_the_threshold_is_exact(spark, tmp_path):
    docs = [*DOCS, (11, " ".join(PASSAGE[:7]) + " y " + " ".join(PASSAGE[30:]))]
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: tuple(r)[1:] for r in queries.op9_decontamination(spark, str(tmp_path)).collect()}
    assert rows[3] == (0.5, 1, 1, False) and rows[9] == (0.5, 6, 1, False) and rows[11] == (17 / 40, 1, 2, False)
    assert {k: v[:2] for k, v in rows.items() if k not in (3, 9, 11)} == {k: v for k, v in WANT.items() if k not in (3, 9)}


def test_empty_tables(spark):
    bench, docs = spark.createDataFrame(BENCH, "item_id long, text string"), documents(spark, DOCS)
    assert decontaminate.coverage(docs.limit(0), bench).count() == 0
    assert decontaminate.coverage(docs, bench.limit(0)).where("contaminated").count() == 0


def test_equals_brute_force_on_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r["item_id"]: plain(r["text"]) for r in bench.collect()}
    texts = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}

    def grams(w):
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    for r in decontaminate.coverage(docs, bench).collect():
        doc, best = texts[r["doc_id"]], 0.0
        for item in items.values():
            shared = grams(doc) & grams(item)
            if shared:
                near = [w if any(w in s for s in shared) else i for i, w in enumerate(doc)]
                best = max(best, sum(t[2] for t in tiles(near, item, 5)) / len(item))
        assert r["coverage"] == (pytest.approx(best) if best >= 0.6 else 0.0)
