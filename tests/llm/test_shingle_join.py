import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import components, documents, shingles
from varve.llm import shingle_join
from varve.llm.components import connected_components


def brute_force(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    links, n_links = [], Counter()
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= similarity * len(a | b) - 1e-12):
                links.append((i, j))
                n_links[i] += 1
                n_links[j] += 1
    root = components(range(len(rows)), links)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(root[i], []).append(k)
    least = {r: min((k for k in g if k is not None), default=None) for r, g in groups.items()}
    return sorted(((k, least[root[i]], len(groups[root[i]]), n_links[i]) for i, (k, _) in enumerate(rows)), key=str)


def found(docs, **how):
    out = shingle_join.near_copies(docs, **how).collect()
    return sorted(((r["doc_id"], r["class_id"], r["class_size"], r["n_links"]) for r in out), key=str)


def near_copies(rng, base, n):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [512, 16])
def test_equals_brute_force_on_a_hot_group(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rng = random.Random(5)
    hot = near_copies(rng, [f"b{i}" for i in range(100)], 90)
    small = [t for k in range(8) for t in near_copies(rng, [f"c{k}.{i}" for i in range(60 + 40 * k)], 4)]
    odd = [None, "", " \n", "one two", "One  TWO", "one two three", "five words in a row", "x " * 30_000, "x x x x x"]
    texts = [*hot, *small, *odd, hot[0], hot[0].upper()]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[5]), (None, "nothing like it at all here")]
    docs = documents(spark, rows).withColumns({c: F.lit(1) for c in ("key", "class", "n", "gone", "node", "i", "j")})
    assert found(docs) == brute_force(rows)
    left = shingle_join.drop_near_copies(docs)
    assert left.columns == docs.columns
    want = {k for k, c, _, _ in brute_force(rows) if k == c or k is None}
    assert {r["doc_id"] for r in left.collect()} == want


def test_equals_brute_force_on_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert found(docs) == brute_force([tuple(r) for r in docs.collect()])


def test_a_key_that_repeats_with_different_texts_loses_only_its_near_copies(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    one, near = " ".join(a), " ".join([*a[:-1], "z"])
    other, like = " ".join(b), " ".join([*b[:-1], "z"])
    # Key 3 loses a near copy of key 1, holds the smallest key of a second group, and texts of its own.
    rows = [(1, one), (3, near), (3, other), (4, like), (3, "alone " * 9), (3, None), (5, ""), (None, one), (3, near)]
    left = shingle_join.drop_near_copies(documents(spark, rows))
    assert sorted((tuple(r) for r in left.select("doc_id", "text").collect()), key=str) == sorted(
        [(1, one), (3, other), (3, "alone " * 9), (3, None), (None, one)], key=str
    )
    # A hot key of different texts, of which one is a near copy.
    hot = [(7, f"text {i} of the hot key and nothing like {i}") for i in range(200)]
    left = shingle_join.drop_near_copies(documents(spark, [(1, one), (7, near), *hot]))
    assert sorted(tuple(r) for r in left.select("doc_id", "text").collect()) == sorted([(1, one), *hot])


def test_empty_table(spark):
    docs = documents(spark, [])
    assert found(docs) == [] and shingle_join.drop_near_copies(docs).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 200), (7, 7)]
    out = {r["a"]: r["b"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert out == {n: r for n, r in want.items() if n != r}


def test_rows_grow_with_members_and_not_with_their_square(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK", 32)
    write, most = shingle_join.materialise, []

    def counted(df):
        out = write(df)
        most[-1] = max(most[-1], out.count())
        return out

    monkeypatch.setattr(shingle_join, "materialise", counted)
    for n in (200, 800):
        rng = random.Random(n)
        most.append(0)
        docs = documents(spark, list(enumerate(near_copies(rng, [f"b{i}" for i in range(100)], n))))
        shingle_join.near_copies(docs).write.format("noop").mode("overwrite").save()
    assert most[1] <= 5 * most[0]
