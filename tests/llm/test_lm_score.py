import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, words
from varve.llm import lm_score

END, START = "\0end", "\0start"


def fold_of(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7


def grams(text, order):
    tokens = [*words(text), END]
    row = []
    for n in range(1, order + 1):
        padded = [START, *tokens]
        # One start mark: n-grams that would reach behind it are cut there.
        row.append([tuple(padded[max(0, i - n + 2):i + 2]) if n > 1 else (tokens[i],) for i in range(len(tokens))])
    return tokens, row


def brute_force(rows, order):
    training = [t for k, t in rows if fold_of(k) != 2]
    first = [t for k, t in rows if fold_of(k) not in (2, 6)]

    def count(texts):
        c = [Counter() for _ in range(order)]
        for t in texts:
            for n, g in enumerate(grams(t, order)[1]):
                c[n].update(g)
        return c

    every, part = count(training), count(first)
    n, v, texts = sum(every[0].values()), len(every[0]), len(training)

    def estimates(text, counts):
        tokens, row = grams(text, order)
        out = []
        for i in range(len(tokens)):
            shares, bucket = [], 0
            for level in range(order):
                c = counts[level][row[level][i]]
                context = n if not level else texts if i == 0 else counts[level - 1][row[level - 1][i - 1]]
                if level and context > 0:
                    bucket = level * 64 + min(63, math.frexp(context)[1])
                shares.append(c / context if context else 0.0)
            out.append((bucket, shares))
        return out

    cells = Counter()
    for k, t in rows:
        if fold_of(k) == 6:
            for bucket, shares in estimates(t, part):
                cells[(bucket, *(math.floor(-math.log10(s) * lm_score.STEPS) if s > 0 else -1 for s in shares))] += 1
    floor = 1 / (v + 1)
    table = np.array(sorted((*c, k) for c, k in cells.items()), dtype=np.int64).reshape(len(cells), order + 2)
    weights = lm_score.learn_weights(table, floor, order)
    out = {}
    for key, t in rows:
        tokens = [*words(t), END]
        base = sum(math.log10((every[0][(w,)] + 1) / (n + v + 1)) for w in tokens)
        score = sum(math.log10(weights[b][0] * floor + sum(w * s for w, s in zip(weights[b][1:], shares))) for b, shares in estimates(t, every))
        out[key] = (fold_of(key) == 2, len(tokens), sum(every[0][(w,)] > 0 for w in tokens), n, base, score)
    return out


def scored(docs, **how):
    fold = lm_score.fold_of(F.col("doc_id"))
    return lm_score.score_texts(docs, fold != 2, fold == 6, **how)


ODD = [(1000, None), (1001, ""), (1002, "   \n\t "), (1003, "A a A É é \x0b x"), (1004, "w " * 30_000), (None, "no id at all"), (1005, "A a A")]


@pytest.mark.parametrize("order, chunk_bytes, part_keys", [(2, 8 << 20, 1 << 20), (2, 5_000, 500), (3, 50_000, 5_000), (1, 20_000, 5_000)])
def test_equals_brute_force(spark, sf, order, chunk_bytes, part_keys):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()] + ODD
    docs = documents(spark, rows).withColumns({c: F.lit(1) for c in ("key", "use", "chunk", "score")})
    want = brute_force(rows, order)
    have = scored(docs, order=order, chunk_bytes=chunk_bytes, part_keys=part_keys).collect()
    assert len(have) == len(rows)
    for r in have:
        held, n, known, train, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_the_mixture_beats_the_base_on_documents_not_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = scored(docs).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert row[1] > row[0]


def test_nothing_to_learn_from(spark):
    assert scored(documents(spark, [])).count() == 0
    lonely = next(k for k in range(100) if fold_of(k) == 2)
    (row,) = scored(documents(spark, [(lonely, "a b")])).collect()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 3, 0, 0, 0.0)
    assert math.isfinite(row["score"])


def test_repeated_rows_count_as_often_as_they_occur(spark):
    key = next(k for k in range(100) if fold_of(k) == 0)
    rows = scored(documents(spark, [(key, "a b"), (key, "a b")])).collect()
    assert [r["train_tokens"] for r in rows] == [6, 6]
