import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from varve.llm import periodic
from varve.llm.queries import QUERIES


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words):
    """All runs (start, length, period) by comparing each word with the one a period later, for each period."""
    numbers = {}
    t = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    n, spans = len(t), {}
    for q in range(1, n // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (t[q:] == t[:-q]).astype(int), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + q >= max(6, 4 * q):
                spans.setdefault((a, b + q), q)  # the smallest period of a stretch comes first
    return sorted((a, b - a, q) for (a, b), q in spans.items())


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(spark, texts, **how):
    docs = documents(spark, list(enumerate(texts))).withColumns({c: F.lit(1) for c in ("key", "runs", "n_words", "collapsed")})
    rows = periodic.find_runs(docs, **how).collect()
    return {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"], r["n_words"]) for r in rows}


def made(rng):
    words = []
    while len(words) < rng.randint(0, 400):
        root = [rng.choice("abc") for _ in range(rng.randint(1, rng.choice([3, 9, 40])))]
        words += (root * rng.choice([1, 1, 3, 4, 5, 9]))[:rng.randint(1, 300)]
        if rng.random() < 0.3:
            words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
    return words


def test_runs_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(made(rng)) for _ in range(600)]
    have = found(spark, texts)
    for i, text in enumerate(texts):
        words = split(text)
        runs = brute(words)
        assert have[i] == (runs, collapsed(words, runs), len(words)), text
    assert sum(len(r) for r, _, _ in have.values()) > 1000


def test_runs_inside_runs_and_fibonacci_words(spark):
    a, b = ["x"], ["x", "y"]
    for _ in range(12):
        a, b = b, b + a
    nested = ((["a"] * 8 + ["b"]) * 6 + ["c"]) * 5
    texts = [" ".join(t) for t in (b, nested, nested[::-1], ["z"] * 5000, ["z"] * 5, ["z"] * 6, list("abab" * 3))]
    have = found(spark, texts)
    for i, text in enumerate(texts):
        assert have[i][0] == brute(split(text))
    assert have[3][0] == [(0, 5000, 1)] and have[4][0] == [] and have[5] == ([(0, 6, 1)], "z", 6)


def test_empty_null_long_and_repeated_rows(spark):
    long = " ".join(["w%d" % (i % 7001) for i in range(4 * 7001 + 5)])
    rows = [(1, None), (1, ""), (2, " \t\n\v\f\r "), (3, "a b b"), (None, "a " * 9), (None, "a " * 9), (4, long)]
    out = periodic.find_runs(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(([tuple(x) for x in r["runs"]], r["n_words"]))
    assert by[1] == [([], 0)] * 2 and by[2] == [([], 0)] and by[3] == [([], 1)]
    assert by[None] == [([(0, 9, 1)], 9)] * 2 and by[4] == [([(0, 4 * 7001 + 5, 7001)], 4 * 7001 + 5)]
    assert periodic.find_runs(documents(spark, [])).count() == 0


def test_groups_of_texts_do_not_touch(spark):
    texts = ["a " * n for n in range(12)] * 3
    assert {i: v[0] for i, v in found(spark, texts, words=30).items()} == {i: brute(split(t)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("extra", [[], [(None, "a a a a a a a"), (10, None), (11, " ")]])
def test_query_equals_brute_force(spark, sf, tmp_path, extra):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] if not extra else extra
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for key, text in rows:
        words = split(text)
        n, h = len(words), zlib.crc32(str(key).encode())
        if key is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = [None] * 4
        for a, length, q in runs:
            if best[0] is None or length * best[2] > best[1] * q:
                best = [a, length, q, 1000 * length // q]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((key, len(runs), *best, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(collapsed(words, runs))))
    out = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert extra or sum(w[1] > 0 for w in want) > 10
