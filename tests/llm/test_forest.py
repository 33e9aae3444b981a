import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import documents
from tests.llm.test_shingle_join import brute_force, found, near_copies
from varve.llm import forest

TREES, DEEPEST = 24, 6


def signatures(rng, groups):
    """Labels of groups whose members agree in each value with a probability."""
    out = []
    for members, agree in groups:
        base = rng.integers(0, 2**32, TREES * DEEPEST, dtype=np.uint32)
        for _ in range(members):
            own = rng.integers(0, 2**32, TREES * DEEPEST, dtype=np.uint32)
            out.append(np.where(rng.random(len(base)) < agree, base, own).astype(np.uint32))
    return out


def expected(signs, similarity, recall, crowd):
    """The depth per class and trie by walking each label, and the nodes as prefixes."""
    shortest = max(1, forest.matched_depth(similarity, TREES, DEEPEST, recall) - 1)
    labels = [s.reshape(TREES, DEEPEST) for s in signs]
    prefix = lambda c, t, d: (t, d, labels[c][t, :d].tobytes())
    members = defaultdict(int)
    for c in range(len(labels)):
        for t in range(TREES):
            for d in range(shortest, DEEPEST + 1):
                members[prefix(c, t, d)] += 1
    wanted, own = set(), {}
    for c in range(len(labels)):
        depths = []
        for t in range(TREES):
            d = shortest
            while d < DEEPEST and members[prefix(c, t, d)] > crowd:
                d += 1
            depths.append(d)
        limit = DEEPEST
        while limit > shortest and np.prod([1 - similarity ** min(d, limit) for d in depths]) > (1 - recall) * (1 + 1e-8):
            limit -= 1
        for t in range(TREES):
            own[c, t] = min(depths[t], limit)
            wanted.add(prefix(c, t, own[c, t]))
    out = {}
    for (c, t), most in own.items():
        end = next(d for d in range(shortest, most + 1) if prefix(c, t, d) in wanted)
        if members[prefix(c, t, end)] > 1:
            out[c, t] = end
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_prefixes_equal_a_walk_over_all_labels(spark, parts):
    rng = np.random.default_rng(2)
    signs = signatures(rng, [(60, 0.97), (50, 0.8), (30, 0.7), (4, 0.9), (2, 0.85), *[(1, 0.0)] * 20])
    rows = [(c.to_bytes(2, "big"), 9, bytearray(s.tobytes())) for c, s in enumerate(signs)] + [(b"none", 0, bytearray())]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        classes = spark.createDataFrame(rows, "class binary, n long, signature binary")
        out = forest.meetings(classes, TREES, DEEPEST, 0.8, 0.9999, crowd=8)
        have = out.collect()
        depths = {bytes(r["class"]): r["depths"] for r in forest.depths_of(out, TREES, DEEPEST).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = expected(signs, 0.8, 0.9999, 8)
    assert {(int.from_bytes(r["class"], "big"), r["tree"]): r["depth"] for r in have} == want
    assert {d for d in want.values()} == {4, 5, 6}  # sparse parts stop early, crowded ones go down
    # Whoever shares a node agrees on its depth, and nodes hold whoever shares the prefix.
    nodes = defaultdict(set)
    for r in have:
        label = signs[int.from_bytes(r["class"], "big")].reshape(TREES, DEEPEST)[r["tree"], :r["depth"]]
        nodes[r["node"]].add((r["tree"], r["depth"], label.tobytes()))
    assert all(len(p) == 1 for p in nodes.values()) and len({next(iter(p)) for p in nodes.values()}) == len(nodes)
    # No class misses a pair at the threshold more often than the target allows.
    for c, of in depths.items():
        assert of == [want.get((int.from_bytes(c, "big"), t), DEEPEST) for t in range(TREES)]
    for c in range(len(signs)):
        shown = [want.get((c, t)) for t in range(TREES)]
        if None not in shown:
            assert np.prod([1 - 0.8**d for d in shown]) <= 1e-4 * (1 + 1e-6)


def test_links_at_the_threshold_are_found_where_prefixes_differ(spark, monkeypatch):
    monkeypatch.setattr(forest, "CROWD", 4)
    monkeypatch.setattr(forest.meetings, "__defaults__", (4,))
    rng = random.Random(8)
    texts = near_copies(rng, [f"h{i}" for i in range(80)], 120)
    texts += [t for k in range(60) for t in near_copies(rng, [f"s{k}.{i}" for i in range(50)], 2)]
    rows = list(enumerate(texts))
    assert found(documents(spark, rows)) == brute_force(rows)


def test_more_tries_than_the_recall_needs_and_fewer(spark):
    assert [forest.matched_depth(0.8, 24, 6, r) for r in (0.9, 0.999, 0.9999, 0.999999)] == [6, 6, 5, 3]
    with pytest.raises(ValueError):
        forest.matched_depth(0.8, 2, 6, 0.9999)
