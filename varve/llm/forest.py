"""MinHash LSH forest: in which node of each trie a class meets others.

A class has a label of ``deepest`` values in each of ``trees`` tries. A trie is
its labels in sorted order: rows are partitioned by ranges of (trie, label), so
labels with common beginnings are neighbours, and what a label shares with its
neighbours in the task says how deep it has company. Rows without company leave
there; the first and the last row of a task, whose other neighbour is
elsewhere, count as having company down to the end.

The prefix that counts is found per class and trie. It descends from
``shortest`` values as long as its node is crowded. Long prefixes cost recall:
a pair of similarity s shares d values with probability s^d, so a class misses
it in all tries with the product of (1 - s^d). Where the crowded nodes of a
class make that more than the target recall allows, its longest prefixes are
shortened, all by as much, until the target holds again. A node that some class
wants takes in all its members, so prefixes end at the shortest wanted node
above them and members of a node agree on it; this only adds recall.

A class without shingles meets nobody, equal labels are spread over tasks by
class, and no classes give no meetings.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.common import materialise

# Members from which on a node is crowded and its classes descend.
CROWD = 32


def recall_at(depth: int, similarity: float, trees: int) -> float:
    """Probability that a pair of this similarity meets in some trie at this depth."""
    return 1.0 - (1.0 - similarity**depth) ** trees


def matched_depth(similarity: float, trees: int, deepest: int, target: float) -> int:
    """The longest prefix that reaches the target recall if all tries use it."""
    depth = deepest
    while depth > 1 and recall_at(depth, similarity, trees) < target:
        depth -= 1
    if recall_at(depth, similarity, trees) < target:
        raise ValueError("more trees are needed for this recall")
    return depth


def _neighbours(deepest: int, shortest: int) -> Callable:
    """Rows with company, and for how many values (``reach``)."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, deepest
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
            labels = np.frombuffer(b"".join(rows.column("label").to_pylist()), dtype=np.uint32).reshape(-1, deepest)
            tree = rows.column("tree").to_numpy()
            same = np.cumprod(labels[1:] == labels[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
            sides = np.concatenate([[before], same])
            yield from reached(rows.slice(0, rows.num_rows - 1), np.maximum(sides[:-1], sides[1:]))
            last, before = rows.slice(rows.num_rows - 1), int(sides[-1])
        if last is not None:
            yield from reached(last, np.array([deepest]))

    def reached(rows: pa.RecordBatch, reach: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = np.flatnonzero(reach >= shortest)
        if len(kept):
            taken = rows.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(reach[kept].astype(np.int32))], names=[*rows.schema.names, "reach"]
            )

    return shared


def depth_limit(deeper: list[Column], trees: int, deepest: int, shortest: int, similarity: float, recall: float) -> Column:
    """The longest prefix that a class may use; ``deeper[k]`` tries would descend by more than k values."""
    miss = [math.log(max(1.0 - similarity**d, 1e-300)) for d in range(shortest, deepest + 1)]
    goal = math.log(max(1.0 - recall, 1e-300)) + 1e-9
    limit, total = F.lit(shortest), F.lit(trees * miss[0])
    for k, count in enumerate(deeper):
        total = total + count * (miss[k + 1] - miss[k])
        limit = F.when(total <= goal, shortest + k + 1).otherwise(limit)
    return limit


def meetings(
    classes: DataFrame, trees: int, deepest: int, similarity: float, recall: float, crowd: int = CROWD
) -> DataFrame:
    """Rows (class, n, tree, depth, node): where each class meets others; no row for a trie in which it is alone.

    ``classes`` has class, n (no shingles, no meeting) and signature, of ``trees * deepest`` numbers of four bytes.
    """
    shortest = max(1, matched_depth(similarity, trees, deepest, recall) - 1)
    label = 4 * deepest
    labels = classes.where("n > 0").select("class", "n", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.col("signature").substr(t * label + 1, F.lit(label))
    )).alias("tree", "label"))
    order = ("tree", "label", "class")  # equal labels are spread by class
    tries = labels.repartitionByRange(*order).sortWithinPartitions(*order)
    tried = materialise(tries.mapInArrow(
        _neighbours(deepest, shortest), "class binary, n long, tree int, label binary, reach int"
    ))
    prefixes = tried.select("class", "n", "tree", "label", F.explode(F.sequence(F.lit(shortest), "reach")).alias("depth"))
    prefixes = prefixes.select(
        "class", "n", "tree", "depth", F.xxhash64("tree", "depth", F.col("label").substr(F.lit(1), 4 * F.col("depth"))).alias("node")
    )
    shared = materialise(prefixes.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    met = prefixes.join(shared.select("node", (F.col("members") > crowd).alias("crowded")), "node").repartition("class")

    # A class has at most trees * (deepest - shortest + 1) of these rows.
    paths = met.groupBy("class", "tree").agg(
        F.first("n").alias("n"), F.collect_list(F.struct("depth", "node")).alias("path"),
        F.sum(F.col("crowded").cast("int")).alias("down"),
    )
    whole = Window.partitionBy("class")
    deeper = [F.sum((F.col("down") > k).cast("int")).over(whole) for k in range(deepest - shortest)]
    limit = depth_limit(deeper, trees, deepest, shortest, similarity, recall)
    paths = materialise(paths.withColumn("limit", limit).select(
        "class", "n", "tree", "path", F.least(shortest + F.col("down"), "limit").cast("int").alias("wanted")
    ))
    at = paths.select("class", "n", "tree", "wanted", F.inline("path")).where("depth <= wanted")
    wanted = materialise(at.where("depth = wanted").select("node").distinct())
    ends = at.join(wanted, "node").groupBy("class", "tree").agg(
        F.first("n").alias("n"), F.min(F.struct("depth", "node")).alias("end")
    )
    return materialise(ends.select("class", "n", "tree", "end.depth", "end.node"))


def depths_of(found: DataFrame, trees: int, deepest: int) -> DataFrame:
    """One row per class of ``meetings``: class, depths (one number per trie, ``deepest`` where it meets nobody)."""
    known = found.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("tree", "depth"))).alias("known"))
    return known.select("class", F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.col("known")[t], F.lit(deepest))
    ).alias("depths"))
