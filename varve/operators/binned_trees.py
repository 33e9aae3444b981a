"""Boosted trees and bootstrap forests over binned rows, grown level by level.

The learners do what Spark's ``GBTRegressor`` and ``RandomForestRegressor`` do,
take their parameters and return their models; only the work over the rows is
another. Spark keeps each row as objects, and adds it to a histogram number by
number. Here rows are kept in blocks: a byte per feature (its bin) and a double
for what is left to explain. A task adds up a whole block per feature with
numpy, so a level costs a few bytes and some ten nanoseconds per row and feature.

Bins come from all rows: a task sums up its rows as counts of their values, or
as ``POINTS`` values of even rank where these are more, and the driver picks the
thresholds from the sums as Spark does from a sample.

Rows that agree in all bins go the same way in every tree, whatever its draws. A
table whose bins have no more than ``CELLS`` combinations (32 bins of four
features have a million) is read once: tasks add up number, sum and sum of
squares of the labels per combination, for each tree with the draws of its own,
and a tree, or all rounds of boosting, then grow in one task from these sums.
With more combinations every level is a pass over the blocks. Histograms (number, sum and
sum of squares per open node, feature and bin) go to the driver while they are
small, and are else added up and searched in tasks, by ranges of nodes. Open
nodes are worked off in portions, which bounds the histograms of a task.
"""

from __future__ import annotations

import json
import math
import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions.columns import named
from varve.operators.extra_trees import _matrix, _portions, draws
from varve.session import new_path, shared_dir, ship

# Rows of a block; rows that a task sums up at a time, and values of even rank that stand for them.
BLOCK, SUMMED, POINTS = 65_536, 1_000_000, 4096
# The same for the values of a feature on the driver; a feature has fewer bins.
DRIVER_POINTS = 65_536
# Rows of a task; tasks are joined where there are more of them than run at a time.
TASK_ROWS = 4_000_000
# Most combinations of bins that are grown from sums, and most numbers (8 bytes) of such sums in a task that holds those of all rounds.
CELLS, CELL_NUMBERS = 1 << 21, 32_000_000
# Most numbers (8 bytes) in the histograms of a task, bytes of them that go to the driver, and of a range of nodes.
PORTION_NUMBERS, DRIVER_BYTES, RANGE_BYTES = 6_000_000, 32 << 20, 256 << 10
# Rounds of boosting after which rows are cut from their lineage.
LINEAGE = 25
# A split must lower the sum of squares by this share, as sums that were added up in another order differ by about as much.
NOISE = 1e-13


@dataclass
class Trees:
    """Flat arrays over all nodes; node ``t`` is the root of tree ``t``. Rows up to bin ``cut`` of ``feature`` go to ``left``, others to the next node; a leaf has ``feature`` -1.

    ``n``, ``s`` and ``q`` are number, sum and sum of squares of the (weighted) labels.
    """

    trees: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    left: np.ndarray = field(init=False)
    tree: np.ndarray = field(init=False)
    sums: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)

    def __post_init__(self):
        k = self.trees
        self.feature, self.cut, self.left = np.full(k, -1, np.int64), np.zeros(k, np.int64), np.full(k, -1, np.int64)
        self.tree, self.sums, self.gain = np.arange(k), np.zeros((3, k)), np.zeros(k)

    @property
    def value(self) -> np.ndarray:
        n, s, _ = self.sums
        return s / np.maximum(n, 1)

    @property
    def impurity(self) -> np.ndarray:
        n, s, q = self.sums
        found = (q - s * s / np.maximum(n, 1)) / np.maximum(n, 1)
        return np.where(found > NOISE * q / np.maximum(n, 1), found, 0.0)

    def grow(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Split nodes; ``left`` are the sums of their left children. Return the ids of the children."""
        size, k = len(self.feature), len(nodes)
        self.feature[nodes], self.cut[nodes], self.gain[nodes] = feature, cut, gain
        self.left[nodes] = size + 2 * np.arange(k)
        both = np.stack([left, self.sums[:, nodes] - left], axis=2).reshape(3, 2 * k)
        self.feature = np.append(self.feature, np.full(2 * k, -1, np.int64))
        self.cut = np.append(self.cut, np.zeros(2 * k, np.int64))
        self.left = np.append(self.left, np.full(2 * k, -1, np.int64))
        self.tree = np.append(self.tree, np.repeat(self.tree[nodes], 2))
        self.sums = np.concatenate([self.sums, both], axis=1)
        self.gain = np.append(self.gain, np.zeros(2 * k))
        return np.arange(size, size + 2 * k)

    def steps(self) -> "Steps":
        inner = self.feature >= 0
        return Steps(
            np.where(inner, self.feature, 0), np.where(inner, self.cut, 1 << 30), np.where(inner, self.left, np.arange(len(inner)))
        )


@dataclass
class Steps:
    """What a walk needs of the nodes; a leaf leads to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray

    def walk(self, bins: np.ndarray, root: int, levels: int) -> np.ndarray:
        """Node per row of a block (a row per feature) in the tree of a root."""
        rows = bins.shape[1]
        if not levels:
            return np.full(rows, root, np.int64)
        at = self.left[root] + (bins[self.feature[root]] > self.cut[root])
        flat, start, row = bins.reshape(-1), self.feature * rows, np.arange(rows)
        for _ in range(levels - 1):
            # Indices are in range; "clip" only spares numpy a copy.
            right = flat.take(start.take(at, mode="clip") + row, mode="clip") > self.cut.take(at, mode="clip")
            at = self.left.take(at, mode="clip") + right
        return at


@dataclass
class Draw:
    """How often a row counts in a tree: once, a Poisson number of times, or once by chance. Trees are numbered from ``first``."""

    seed: int
    rate: float = 1.0
    again: bool = False
    first: int = 0

    @property
    def every(self) -> bool:
        """Whether each row counts once in each tree."""
        return not self.again and self.rate >= 1

    def weights(self, tree: int, block: tuple[int, int], rows: int) -> np.ndarray | None:
        if self.every:
            return None
        rng = np.random.default_rng([self.seed % (1 << 63), self.first + tree, *block])
        return rng.poisson(self.rate, rows).astype(float) if self.again else (rng.random(rows) < self.rate).astype(float)


@dataclass
class Limits:
    """Levels below the root, rows of a leaf, least gain per row, and features that a node may use (0: all)."""

    depth: int
    smallest: int
    gain: float
    features: int


# --- from rows to blocks --------------------------------------------------------


def thinned(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of the sorted values, at even ranks; each takes the counts of those it stands for."""
    if len(values) <= most:
        return values, counts
    upto = np.cumsum(counts)
    at = np.unique(np.append(np.searchsorted(upto, upto[-1] * np.arange(1, most) / most), len(values) - 1))
    return values[at], np.diff(upto[at], prepend=0)


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds of a feature from its sorted values and their counts: between all, or where a bin is full."""
    bins = min(bins, int(counts.sum()))
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2
    stride = counts.sum() / bins
    found, goal, upto = [], stride, np.cumsum(counts).tolist()
    for i in range(1, len(upto)):
        if abs(upto[i - 1] - goal) < abs(upto[i] - goal):
            found.append((values[i - 1] + values[i]) / 2)
            goal += stride
    return np.array(found[: bins - 1])


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x, y = batch.column("x"), batch.column("y")
    if x.null_count or y.null_count:
        raise ValueError("features and labels must not be NULL")
    x, y = _matrix(x, len(x[0])), y.to_numpy(zero_copy_only=False)
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError("features and labels must not be NaN or infinite")
    return x, y


def _gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a task, about ``rows`` at a time."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(_columns(batch))
            n += batch.num_rows
        if n >= rows:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _summed(batches):
    """Per feature (and for the label as feature -1, with its sum) values and counts of the rows of a task."""
    for x, y in _gathered(batches, SUMMED):
        found = {"feature": [-1], "n": [len(y)], "s": [float(y.sum())], "vals": [b""], "counts": [b""]}
        for j in range(x.shape[1]):
            values, counts = thinned(*np.unique(x[:, j], return_counts=True), POINTS)
            for name, v in zip(found, (j, len(y), 0.0, values.tobytes(), counts.astype(np.int64).tobytes())):
                found[name].append(v)
        yield pa.RecordBatch.from_pydict(found, schema=_SUMS)


_SUMS = pa.schema([("feature", pa.int32()), ("n", pa.int64()), ("s", pa.float64()), ("vals", pa.binary()), ("counts", pa.binary())])


class ValueSums:
    """Number of rows, mean label, and values and counts of each feature of a table ``(x, y)``, for all learners that are fitted on it."""

    def __init__(self):
        self.lock, self.found = threading.Lock(), None

    def of(self, rows: DataFrame) -> tuple[int, float, list[tuple[np.ndarray, np.ndarray]]]:
        with self.lock:
            if self.found is None:
                self.found = self._read(rows)
            return self.found

    def _read(self, rows: DataFrame):
        sums = rows.mapInArrow(_summed, "feature int, n long, s double, vals binary, counts binary").toArrow().to_pylist()
        n = sum(r["n"] for r in sums if r["feature"] < 0)
        if not n:
            raise ValueError("cannot grow trees on no rows")
        mean, found = math.fsum(r["s"] for r in sums) / n, []
        for j in range(max(r["feature"] for r in sums) + 1):
            mine = [r for r in sums if r["feature"] == j]
            values, place = np.unique(np.concatenate([np.frombuffer(r["vals"]) for r in mine]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([np.frombuffer(r["counts"], np.int64) for r in mine]))
            found.append(thinned(values, counts, DRIVER_POINTS))
        return n, mean, found


def binned(rows: DataFrame, bins: int, sums: ValueSums | None = None) -> tuple[RDD, list[np.ndarray], float]:
    """Blocks of rows ``(x, y)``, the thresholds of each feature, and the mean label that the blocks leave out.

    A block is ((task, number), bytes of the bins, a feature after the other,
    and bytes of the labels). Blocks are kept, on disk where memory ends.
    """
    spark = rows.sparkSession
    ship(spark)
    n, mean, values = (sums or ValueSums()).of(rows)
    cuts = [thresholds(*v, bins) for v in values]
    kind = _kind(cuts)

    def pack(batches):
        task, number = TaskContext.get().partitionId(), 0
        for x, y in _gathered(batches, BLOCK):
            for i in range(0, len(y), BLOCK):
                part, labels = x[i : i + BLOCK], y[i : i + BLOCK] - mean
                found = b"".join(np.searchsorted(c, part[:, j]).astype(kind).tobytes() for j, c in enumerate(cuts))
                yield pa.RecordBatch.from_pydict({"task": [task], "number": [number], "bins": [found], "r": [labels.tobytes()]}, schema=_BLOCKS)
                number += 1

    blocks = rows.mapInArrow(pack, "task int, number int, bins binary, r binary").rdd
    most = max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    if blocks.getNumPartitions() > most:
        blocks = blocks.coalesce(most)
    blocks = blocks.map(lambda r: ((r[0], r[1]), bytes(r[2]), bytes(r[3])))
    return blocks.persist(StorageLevel.MEMORY_AND_DISK), cuts, mean


_BLOCKS = pa.schema([("task", pa.int32()), ("number", pa.int32()), ("bins", pa.binary()), ("r", pa.binary())])


def _kind(cuts: list[np.ndarray]) -> type:
    return np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16 if max(map(len, cuts)) < 65_536 else np.uint32


def _block(record: tuple, kind: type, width: int) -> tuple[tuple, np.ndarray, np.ndarray]:
    at, bins, r = record
    r = np.frombuffer(r)
    return at, np.frombuffer(bins, kind).reshape(width, len(r)), r


# --- growing --------------------------------------------------------------------


def grow(blocks: RDD | list, cuts: list[np.ndarray], trees: int, limits: Limits, draw: Draw) -> Trees:
    """Grow all trees on the blocks, a level of all of them at a time. A list holds the cells of one tree (``_cells``), and is grown here."""
    found, open_nodes, level = Trees(trees), np.arange(trees), 0
    numbers = 3 * sum(len(c) + 1 for c in cuts)
    while True:
        parts = [
            _best_splits(blocks, cuts, found, nodes, level, limits, draw)
            for nodes in _portions(open_nodes, max(1, PORTION_NUMBERS // numbers))
        ]
        feature, cut, gain, whole, left = (np.concatenate(v, axis=-1) for v in zip(*parts))
        if level == 0:
            found.sums[:, open_nodes] = whole
        if level >= limits.depth:
            return found
        can = np.flatnonzero(gain > np.maximum(limits.gain * whole[0], NOISE * whole[2]))
        children = found.grow(open_nodes[can], feature[can], cut[can], gain[can], left[:, can])
        level += 1
        enough = (found.sums[0, children] >= max(2, 2 * limits.smallest)) & (found.impurity[children] > 0)
        open_nodes = children[enough]
        if level >= limits.depth or not len(open_nodes):
            return found


def _best_splits(blocks: RDD | list, cuts: list[np.ndarray], grown: Trees, nodes: np.ndarray, level: int, limits: Limits, draw: Draw) -> tuple[np.ndarray, ...]:
    """Feature, cut and gain per node (no gain where it cannot be split), and the sums of the node and of its left child."""
    steps, kind, sizes, width = grown.steps(), _kind(cuts), [len(c) + 1 for c in cuts], len(cuts)
    tree = grown.tree[nodes]
    roots, first = np.unique(tree, return_index=True)
    last = np.append(first[1:], len(nodes))
    slot = np.full(len(steps.left), -1, np.int64)
    slot[nodes] = np.arange(len(nodes))

    def sums_of(records):
        found = [np.zeros((3, len(nodes) * b)) for b in sizes]
        for record in records:
            at, bins, r = _block(record, kind, width)
            for root, a, b in zip(roots, first, last):
                slots = slot.take(steps.walk(bins, root, level), mode="clip") if level else None
                weights = draw.weights(int(root), at, len(r))
                slots = None if slots is None else slots - a
                found_r = r if weights is None else weights * r
                _add(found, sizes, bins, slots, weights, found_r, found_r * r, a, b)
        return found

    def sums_of_cells():
        found = [np.zeros((3, len(nodes) * b)) for b in sizes]
        for bins, n, s, q in blocks:
            _add(found, sizes, bins, slot.take(steps.walk(bins, 0, level), mode="clip") if level else None, n, s, q, 0, len(nodes))
        return found

    allowed = None
    if limits.features:
        order = np.argsort(draws((draw.seed + draw.first) % (1 << 63), nodes, width), axis=1)
        allowed = np.zeros((len(nodes), width), bool)
        np.put_along_axis(allowed, order[:, : limits.features], True, axis=1)

    if isinstance(blocks, list):
        return _best(sums_of_cells(), sizes, limits.smallest, allowed)
    tasks = blocks.getNumPartitions()
    if 8 * 3 * len(nodes) * sum(sizes) * tasks <= DRIVER_BYTES:
        total = None
        for part in blocks.mapPartitions(lambda records: [sums_of(records)]).collect():
            total = part if total is None else [a + b for a, b in zip(total, part)]
        return _best(total, sizes, limits.smallest, allowed)

    step = max(1, RANGE_BYTES // (24 * sum(sizes)))
    ranges = -(-len(nodes) // step)

    def by_range(task, records):
        found = sums_of(records)
        for i in range(ranges):
            yield i, (task, [f.reshape(3, -1, b)[:, i * step : (i + 1) * step].copy() for f, b in zip(found, sizes)])

    def searched(pair):
        i, parts = pair
        # In the order of the tasks, so that sums do not depend on when these end.
        parts = [p for _, p in sorted(parts, key=lambda p: p[0])]
        total = [sum(p[1:], p[0]).reshape(3, -1) for p in zip(*parts)]
        return i, _best(total, sizes, limits.smallest, None if allowed is None else allowed[i * step : (i + 1) * step])

    reducers = min(ranges, 2 * blocks.context.defaultParallelism)
    best = dict(blocks.mapPartitionsWithIndex(by_range).groupByKey(reducers).map(searched).collect())
    return tuple(np.concatenate(v, axis=-1) for v in zip(*[best[i] for i in range(ranges)]))


def _add(
    found: list[np.ndarray], sizes: list[int], bins: np.ndarray, slots: np.ndarray | None, n: np.ndarray | None, s: np.ndarray,
    q: np.ndarray, first: int, last: int,
) -> None:
    """Add a block to the histograms of one tree, whose slots lie side by side (None: it has only its root). Without ``n`` a row counts once."""
    keep = None if n is None else n > 0
    if slots is not None:
        inside = (slots >= 0) & (slots < last - first)
        keep = inside if keep is None else keep & inside
    if keep is not None and not keep.all():
        row = np.flatnonzero(keep)
        if not len(row):
            return
        taken = lambda v: None if v is None else v.take(row, mode="clip")
        bins, slots, n, s, q = bins.take(row, axis=1, mode="clip"), taken(slots), taken(n), taken(s), taken(q)
    for j, size in enumerate(sizes):
        at = bins[j].astype(np.int64) if slots is None else slots * size + bins[j]
        here = found[j][:, first * size : last * size]
        for k, w in enumerate((n, s, q)):
            here[k] += np.bincount(at, w, here.shape[1])


def _best(total: list[np.ndarray], sizes: list[int], smallest: int, allowed: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """The split of the largest gain per node, the first among equals, where both sides have the rows of a leaf."""
    nodes = total[0].shape[1] // sizes[0]
    best, place = np.zeros(nodes), np.arange(nodes)
    feature, cut, left = np.full(nodes, -1, np.int64), np.zeros(nodes, np.int64), np.zeros((3, nodes))
    whole = total[0].reshape(3, nodes, sizes[0]).sum(axis=2)
    for j, size in enumerate(sizes):
        if size < 2:
            continue
        n, s, q = sums = np.cumsum(total[j].reshape(3, nodes, size), axis=2)[:, :, :-1]
        n_, s_, _ = (w[:, None] for w in whole)
        can = (n >= max(1, smallest)) & (n_ - n >= max(1, smallest))
        if allowed is not None:
            can &= allowed[:, j, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(can, s * s / n + (s_ - s) ** 2 / (n_ - n) - s_ * s_ / n_, 0.0)
        at = gain.argmax(axis=1)
        better = gain[place, at] > best
        best[better], feature[better], cut[better] = gain[place, at][better], j, at[better]
        left[:, better] = sums[:, place, at][:, better]
    return feature, cut, best, whole, left


def boost(blocks: RDD, cuts: list[np.ndarray], rounds: int, rate: float, limits: Limits, draw: Draw) -> list[Trees]:
    """Trees one after the other, the first on the labels and each other on twice what those before leave over, which is the gradient."""
    grown, kind, width = [], _kind(cuts), len(cuts)
    before, rows = None, blocks
    try:
        for i in range(rounds):
            trees = grow(rows, cuts, 1, limits, Draw(draw.seed, draw.rate, draw.again, i))
            grown.append(trees)
            if before is not None and before is not blocks:
                before.unpersist()
            if i + 1 == rounds:
                break
            steps, value, share, levels = trees.steps(), trees.value, (1.0 if i else 2.0, 2.0 * (rate if i else 1.0)), limits.depth

            def left_over(record, steps=steps, value=value, share=share, levels=levels):
                at, bins, r = _block(record, kind, width)
                return at, record[1], (share[0] * r - share[1] * value.take(steps.walk(bins, 0, levels))).tobytes()

            before, rows = rows, rows.map(left_over).persist(StorageLevel.MEMORY_AND_DISK)
            if (i + 1) % LINEAGE == 0:
                rows.checkpoint()
    finally:
        for kept in (before, rows):
            if kept is not None and kept is not blocks:
                kept.unpersist()
    return grown


# --- cells ----------------------------------------------------------------------


def combinations(cuts: list[np.ndarray]) -> int:
    return math.prod(len(c) + 1 for c in cuts)


def _sums_by_tree(blocks: RDD, cuts: list[np.ndarray], trees: int, draw: Draw) -> RDD:
    """(tree, (combinations of bins, their numbers, sums and sums of squares)) by the draws of each tree; one tree where each row counts once."""
    sizes, kind, most = [len(c) + 1 for c in cuts], _kind(cuts), combinations(cuts)
    tables = 1 if draw.every else trees

    def by_tree(task, records):
        held = []
        for record in records:
            at, bins, r = _block(record, kind, len(sizes))
            held.append((at, np.ravel_multi_index([b.astype(np.int64) for b in bins], sizes).astype(np.int32), r))
        if not held:
            return
        cell, r = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        for t in range(tables):
            n = None if draw.every else np.concatenate([draw.weights(t, at, len(x)) for at, _, x in held])
            s = r if n is None else n * r
            sums = np.stack([np.bincount(cell, w, most) for w in (n, s, s * r)])
            seen = np.flatnonzero(sums[0])
            yield t, (task, seen.astype(np.int32), sums[:, seen])

    def whole(parts):
        total = np.zeros((3, most))
        # In the order of the tasks, so that sums do not depend on when these end.
        for _, seen, sums in sorted(parts, key=lambda p: p[0]):
            total[:, seen] += sums
        seen = np.flatnonzero(total[0])
        return seen, total[:, seen]

    return blocks.mapPartitionsWithIndex(by_tree).groupByKey(min(tables, 4 * blocks.context.defaultParallelism)).mapValues(whole)


def _cells(cuts: list[np.ndarray], seen: np.ndarray, sums: np.ndarray) -> list[tuple]:
    """Bins, numbers, sums and sums of squares of combinations, a block at a time."""
    bins = np.stack(np.unravel_index(seen, [len(c) + 1 for c in cuts])).astype(_kind(cuts))
    parts = [slice(i, i + BLOCK) for i in range(0, len(seen), BLOCK)]
    return [(np.ascontiguousarray(bins[:, p]), *sums[:, p]) for p in parts]


def grow_from_cells(blocks: RDD, cuts: list[np.ndarray], trees: int, limits: Limits, draw: Draw) -> list[Trees]:
    """The trees of a forest, each grown in one task from the sums of its cells."""
    def grown(pair):
        t, found = pair
        if not len(found[0]):
            return t, None
        return t, grow(_cells(cuts, *found), cuts, 1, limits, Draw(draw.seed, first=t))

    sums = _sums_by_tree(blocks, cuts, trees, draw)
    if draw.every and trees > 1:  # the trees differ by the features of their nodes
        sums = sums.flatMap(lambda pair: [(t, pair[1]) for t in range(trees)]).partitionBy(trees)
    found = dict(sums.map(grown).collect())
    # A tree that has drawn no row is a leaf of no rows.
    return [found.get(t) or Trees(1) for t in range(trees)]


def boost_from_cells(blocks: RDD, cuts: list[np.ndarray], rounds: int, rate: float, limits: Limits, draw: Draw) -> list[Trees]:
    """``boost`` in one task from the sums of cells: what is left over is the same for all rows of a cell."""
    size = combinations(cuts)

    def boosted(pairs):
        tables, grown, guess = dict(pairs), [], np.zeros(size)
        for i in range(rounds):
            seen, (n, s, q) = tables[0] if draw.every else tables.get(i, (np.zeros(0, np.int64), np.zeros((3, 0))))
            share, f = (2.0, guess[seen]) if i else (1.0, 0.0)
            left = np.stack([n, share * (s - f * n), share * share * (q - 2 * f * s + f * f * n)])
            trees = grow(_cells(cuts, seen, left), cuts, 1, limits, Draw(draw.seed, first=i)) if len(seen) else Trees(1)
            grown.append(trees)
            steps, value = trees.steps(), trees.value
            for start in range(0, size, BLOCK):
                cells = np.arange(start, min(size, start + BLOCK))
                bins = np.stack(np.unravel_index(cells, [len(c) + 1 for c in cuts])).astype(_kind(cuts))
                guess[cells] += (rate if i else 1.0) * value.take(steps.walk(bins, 0, limits.depth))
        return grown

    found = _sums_by_tree(blocks, cuts, rounds, draw).map(lambda pair: (0, pair)).groupByKey(1).mapValues(boosted).collect()
    return found[0][1]


# --- Spark's models ---------------------------------------------------------------


def stored_model(learner, model: type, grown: list[Trees], weights: list[float], cuts: list[np.ndarray], means: list[float], spark: SparkSession):
    """The trees as a model of Spark, by way of the files that such a model is stored in. ``means`` are added to the values of each set of trees."""
    path = new_path(spark, "model")
    # Written from here: as jobs, the three small tables would take longer than the fit of a small table.
    first = np.cumsum([0] + [t.trees for t in grown])
    nodes = [_node_rows(trees, cuts, mean, int(at)) for trees, mean, at in zip(grown, means, first)]
    _write(spark, f"{path}/data/part-00000.parquet", pa.concat_tables(nodes))
    plain = lambda params, names=None: {p.name: v for p, v in params.items() if names is None or p.name in names}
    facts = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    count = sum(t.trees for t in grown)
    own = {"maxDepth": learner.getMaxDepth()}
    tree = {"class": f"{_SPARK}.DecisionTreeRegressionModel", **facts, "paramMap": own, "defaultParamMap": plain(learner._defaultParamMap, _TREE_PARAMS)}
    _write(spark, f"{path}/treesMetadata/part-00000.parquet", pa.table({
        "_1": pa.array(range(count), pa.int32()), "_2": [json.dumps(tree | {"uid": f"dtr_{uuid.uuid4().hex[:12]}"}) for _ in range(count)],
        "_3": [float(w) for w in weights],
    }))
    whole = {
        "class": f"{_SPARK}.{model.__name__}", **facts, "uid": learner.uid, "paramMap": plain(learner._paramMap),
        "defaultParamMap": plain(learner._defaultParamMap), "numFeatures": len(cuts), "numTrees": count,
    }
    _write(spark, f"{path}/metadata/part-00000.txt", json.dumps(whole).encode())
    return learner._copyValues(model.load(path))


def _write(spark: SparkSession, path: str, content: pa.Table | bytes) -> None:
    """A file of a driver's table, or of bytes, in any file system that Spark knows."""
    if isinstance(content, pa.Table):
        sink = pa.BufferOutputStream()
        pq.write_table(content, sink)
        content = sink.getvalue().to_pybytes()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        for i in range(0, len(content), 1 << 24):
            out.write(content[i : i + (1 << 24)])
    finally:
        out.close()


_SPARK = "org.apache.spark.ml.regression"
_TREE_PARAMS = {
    "cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB",
    "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed",
}


def _node_rows(trees: Trees, cuts: list[np.ndarray], mean: float, first: int) -> pa.Table:
    """A row per node as Spark stores them; children have larger numbers than their parent."""
    order = np.argsort(trees.tree, kind="stable")
    begin = np.searchsorted(trees.tree[order], np.arange(trees.trees))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order)) - begin[trees.tree[order]]
    inner, (n, s, q) = trees.feature >= 0, trees.sums
    child = lambda side: np.where(inner, number[np.where(inner, trees.left + side, 0)], -1).astype(np.int32)
    start = np.cumsum([0] + [len(c) for c in cuts])
    cut = np.concatenate([*cuts, [0.0]])[start[trees.feature[inner]] + trees.cut[inner]]
    stats = np.stack([n, s + n * mean, q + 2 * mean * s + n * mean * mean], axis=1)
    lists = lambda sizes, v: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(v))
    split = pa.StructArray.from_arrays(
        [pa.array(trees.feature.astype(np.int32)), lists(inner, cut), pa.array(np.full(len(inner), -1, np.int32))],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    node = pa.StructArray.from_arrays([
        pa.array(number.astype(np.int32)), pa.array(trees.value + mean), pa.array(trees.impurity),
        lists(np.full(len(inner), 3), stats.reshape(-1)), pa.array(np.round(n).astype(np.int64)),
        pa.array(np.where(inner, trees.gain / np.maximum(n, 1), -1.0)), pa.array(child(0)), pa.array(child(1)), split,
    ], ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.table({"treeID": pa.array((trees.tree + first).astype(np.int32)), "nodeData": node})


class _Binned:
    """What both learners share. Asked for what they do not do, they leave the fit to Spark.

    ``sums`` are those of the rows, where several learners are fitted on them.
    """

    sums: ValueSums | None = None

    def _plain(self, dataset: DataFrame) -> bool:
        attributes = (dataset.schema[self.getFeaturesCol()].metadata or {}).get("ml_attr", {}).get("attrs", {})
        return (
            not self.isSet("weightCol") and self.getMinWeightFractionPerNode() == 0 and self.getMaxBins() <= DRIVER_POINTS
            and not {"nominal", "binary"} & set(attributes)
        )

    def _limits(self, width: int, trees: int) -> Limits:
        k = features_of_a_node(self.getFeatureSubsetStrategy(), width, trees)
        return Limits(self.getMaxDepth(), self.getMinInstancesPerNode(), self.getMinInfoGain(), k if k < width else 0)

    def _blocks(self, dataset: DataFrame) -> tuple[RDD, list[np.ndarray], float]:
        shared_dir(dataset.sparkSession)
        return binned(dataset.select(
            vector_to_array(named(self.getFeaturesCol())).alias("x"), named(self.getLabelCol()).cast("double").alias("y")
        ), self.getMaxBins(), self.sums)

    def write(self) -> DefaultParamsWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> DefaultParamsReader:
        return DefaultParamsReader(cls)


def features_of_a_node(strategy: str, width: int, trees: int) -> int:
    """How many features a node may choose from, by Spark's words for it."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "onethird"
    words = {"all": width, "onethird": math.ceil(width / 3), "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width)))}
    if strategy in words:
        return words[strategy]
    return min(width, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * width)


class BinnedForest(_Binned, RandomForestRegressor):
    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        if not self._plain(dataset):
            return super()._fit(dataset)
        trees = self.getNumTrees()
        blocks, cuts, mean = self._blocks(dataset)
        try:
            draw = Draw(self.getSeed(), self.getSubsamplingRate(), self.getBootstrap())
            limits = self._limits(len(cuts), trees)
            grown = grow_from_cells(blocks, cuts, trees, limits, draw) if combinations(cuts) <= CELLS else [grow(blocks, cuts, trees, limits, draw)]
        finally:
            blocks.unpersist()
        return stored_model(self, RandomForestRegressionModel, grown, [1.0] * trees, cuts, [mean] * len(grown), dataset.sparkSession)


class BinnedBoosting(_Binned, GBTRegressor):
    def _plain(self, dataset: DataFrame) -> bool:
        return super()._plain(dataset) and self.getLossType() == "squared" and not self.isSet("validationIndicatorCol")

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        if not self._plain(dataset):
            return super()._fit(dataset)
        rounds, rate = self.getMaxIter(), self.getStepSize()
        blocks, cuts, mean = self._blocks(dataset)
        try:
            limits, draw = self._limits(len(cuts), 1), Draw(self.getSeed(), self.getSubsamplingRate())
            size = combinations(cuts)
            few = size <= CELLS and (1 if draw.every else rounds) * 3 * size <= CELL_NUMBERS
            grown = (boost_from_cells if few else boost)(blocks, cuts, rounds, rate, limits, draw)
        finally:
            blocks.unpersist()
        weights, means = [1.0] + [rate] * (rounds - 1), [mean] + [0.0] * (rounds - 1)
        return stored_model(self, GBTRegressionModel, grown, weights, cuts, means, dataset.sparkSession)
