"""Extremely randomised regression trees, grown level by level.

Every tree sees all rows. A node draws, for each feature, one threshold
uniformly between the smallest and the largest value among its rows, and
keeps the feature whose threshold lowers the squared error most.

A level of all trees costs two aggregations over the rows: the value ranges of
the open nodes, then the sums to the left of the drawn thresholds. Each task
combines its own rows first, so a task shuffles one row per open node and
feature that it has met, and the plan is the same for any number of features. Rows
carry no state between levels: a task finds the node of a row by walking the
trees grown so far, which are a broadcast of arrays, so lineage stays one step
long and a lost executor costs only its own tasks. Open nodes are worked off
in portions, which bounds the arrays of a task, the thresholds that are
broadcast, and the table that reaches the driver. The trees themselves grow
with their number and depth, not with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
    MLWritable, MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.functions.columns import named
from varve.session import ship

# Most numbers (open nodes times columns, 8 bytes each) in an array of a task.
PORTION_NUMBERS = 4_000_000
# Nodes of the forests that a search grows at a time.
NODES = 4_000_000
# Rows per distinct row of features from which equal rows are grown on as one.
EQUAL_ROWS = 4


@dataclass
class Forest:
    """Flat arrays over all nodes; node ``t`` is the root of tree ``t``.

    ``left`` is the id of the left child, the right one is the next; a leaf
    has ``feature`` -1.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    count: np.ndarray
    gain: np.ndarray
    tree: np.ndarray
    trees: int

    @classmethod
    def of_roots(cls, trees: int) -> "Forest":
        return cls(
            np.full(trees, -1, np.int32), np.zeros(trees), np.full(trees, -1, np.int64), np.zeros(trees),
            np.zeros(trees, np.int64), np.zeros(trees), np.arange(trees), trees,
        )

    def locate(self, x: np.ndarray, trees: np.ndarray | None = None) -> np.ndarray:
        """Node id per row and tree: the deepest node the row has reached."""
        roots = np.arange(self.trees) if trees is None else trees
        found = np.empty((len(roots), len(x)), np.int64)
        for i, root in enumerate(roots):
            found[i] = self.walk(x, root)
        return found.T

    def walk(self, x: np.ndarray, root: int) -> np.ndarray:
        """Node id per row in one tree. A leaf leads to itself, so all rows of a batch take as many steps as the tree is deep."""
        feature, threshold, left, depth = self._steps()
        values, start = np.ascontiguousarray(x).reshape(-1), np.arange(len(x)) * x.shape[1]
        at = np.full(len(x), root, np.int64)
        for _ in range(depth[root]):
            # Indices are in range; "clip" only spares numpy a copy.
            right = values.take(start + feature.take(at, mode="clip"), mode="clip") > threshold.take(at, mode="clip")
            at = left.take(at, mode="clip") + right
        return at

    def _steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Feature, threshold and left child of each node, a leaf being its own, and the depth of each tree."""
        known = self.__dict__.get("_walked")
        if known is None or len(known[0]) != len(self.feature):
            leaf = self.feature < 0
            depth, inner = np.zeros(self.trees, np.int64), np.flatnonzero(~leaf[: self.trees])
            while len(inner):
                depth[np.unique(self.tree[inner])] += 1
                below = np.concatenate([self.left[inner], self.left[inner] + 1])
                inner = below[~leaf[below]]
            known = self.__dict__["_walked"] = (
                np.where(leaf, 0, self.feature).astype(np.int64), np.where(leaf, np.inf, self.threshold),
                np.where(leaf, np.arange(len(leaf)), self.left), depth,
            )
        return known

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_walked"}

    def predict(self, x: np.ndarray, trees: np.ndarray | None = None) -> np.ndarray:
        roots = np.arange(self.trees) if trees is None else trees
        total = np.zeros(len(x))
        for root in roots:
            total += self.value.take(self.walk(x, root), mode="clip")
        return total / len(roots)

    def grow(self, splits: pd.DataFrame) -> np.ndarray:
        """Apply one row per split node; return the ids of the children."""
        node, k = splits["node"].to_numpy(), len(splits)
        first = len(self.feature) + 2 * np.arange(k)
        self.feature[node], self.threshold[node] = splits["feature"], splits["threshold"]
        self.left[node], self.gain[node] = first, splits["gain"]
        pairs = lambda a, b: splits[[a, b]].to_numpy().reshape(-1)
        self.feature = np.append(self.feature, np.full(2 * k, -1, np.int32))
        self.threshold = np.append(self.threshold, np.zeros(2 * k))
        self.left = np.append(self.left, np.full(2 * k, -1, np.int64))
        self.gain = np.append(self.gain, np.zeros(2 * k))
        self.tree = np.append(self.tree, np.repeat(self.tree[node], 2))
        self.value = np.append(self.value, pairs("left_mean", "right_mean"))
        self.count = np.append(self.count, pairs("left_n", "right_n"))
        return np.arange(len(self.feature) - 2 * k, len(self.feature))


@dataclass
class Plan:
    """What each tree of a forest is grown by: levels, rows of a leaf, and the fold that it does not see (-1: none)."""

    depth: np.ndarray
    smallest: np.ndarray
    without: np.ndarray
    seed: int

    @classmethod
    def alike(cls, trees: int, depth: int, smallest: int, seed: int) -> "Plan":
        return cls(np.full(trees, depth), np.full(trees, smallest), np.full(trees, -1), seed)


def _matrix(x: pa.Array, width: int) -> np.ndarray:
    """Feature arrays of a batch as one matrix."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)


# Odd multipliers that spread bits (golden ratio, and the two of a well-known 64-bit mixer).
_SPREAD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def draws(seed: int, nodes: np.ndarray, width: int) -> np.ndarray:
    """A number in [0, 1) per (seed, node, feature), whatever other nodes are drawn with it."""
    x = nodes.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64)
    start = np.uint64((seed * int(_SPREAD[1]) + 1) % (1 << 64))
    x = (x + start) * _SPREAD[0]
    for _ in range(2):
        x = (x ^ (x >> np.uint64(30))) * _SPREAD[1]
        x = (x ^ (x >> np.uint64(27))) * _SPREAD[2]
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) / float(1 << 53)


class _TreeParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels below the root", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "rows of a leaf", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(numTrees=100, maxDepth=15, minInstancesPerNode=1, seed=42)


class ExtraTreesLearner(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
        numTrees=100, maxDepth=15, minInstancesPerNode=1, seed=42,
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "ExtraTreesModel":
        ship(dataset.sparkSession)
        rows = dataset.select(
            vector_to_array(named(self.getFeaturesCol())).alias("x"), named(self.getLabelCol()).cast("double").alias("y")
        ).persist(StorageLevel.MEMORY_AND_DISK)
        plan = Plan.alike(
            self.getOrDefault(self.numTrees), self.getOrDefault(self.maxDepth), self.getOrDefault(self.minInstancesPerNode),
            self.getSeed(),
        )
        try:
            forest, width = grow_forest(rows.withColumn("fold", F.lit(-2)), plan)
        finally:
            rows.unpersist()
        model = ExtraTreesModel(forest)
        self._copyValues(model)
        return model._set(numFeatures=width)


def grow_forest(rows: DataFrame, plan: Plan) -> tuple[Forest, int]:
    """Grow all trees of a plan on rows (x, y, fold), level by level; the forest and the number of features.

    Rows that are equal in all features go the same way in every tree. Where
    they are many, they become one row with their number, sum and range of y.
    """
    by_fold = rows.groupBy("fold").agg(
        F.count("y").alias("n"), F.sum("y").alias("s"), F.max(F.size("x")).alias("width"), F.count(F.lit(1)).alias("rows"),
        F.approx_count_distinct("x").alias("distinct"),
    ).collect()  # a row per fold
    n, total = sum(r["n"] for r in by_fold), sum(r["s"] or 0.0 for r in by_fold)
    if not n:
        raise ValueError("cannot grow trees on no rows")
    width, mean = max(r["width"] for r in by_fold), total / n
    # Centring keeps the sums of squares small.
    y = F.col("y") - mean
    alike = EQUAL_ROWS * sum(r["distinct"] for r in by_fold) < n and all(r["n"] == r["rows"] for r in by_fold)
    if alike:
        rows = rows.groupBy("x", "fold").agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("s"), F.min(y).alias("lo"), F.max(y).alias("hi")
        ).persist(StorageLevel.MEMORY_AND_DISK)
    else:
        rows = rows.select("x", "fold", F.lit(1.0).alias("n"), y.alias("s"), y.alias("lo"), y.alias("hi"))
    try:
        return _grown(rows, plan, by_fold, width, mean), width
    finally:
        if alike:
            rows.unpersist()


def _grown(rows: DataFrame, plan: Plan, by_fold: list, width: int, mean: float) -> Forest:
    """The forest from rows (x, fold, n, s, lo, hi): number, sum and range of the centred labels behind a row."""
    n = sum(r["n"] for r in by_fold)
    trees = len(plan.depth)
    forest = Forest.of_roots(trees)
    left_out = {r["fold"]: (r["n"], (r["s"] or 0.0) - r["n"] * mean) for r in by_fold}
    for t in range(trees):
        m, s = left_out.get(plan.without[t], (0, 0.0))
        if m == n:
            raise ValueError("cannot grow trees on no rows")
        forest.count[t], forest.value[t] = n - m, -s / (n - m)
    open_nodes, level = np.arange(trees), 0
    while True:
        tree = forest.tree[open_nodes]
        enough = forest.count[open_nodes] >= np.maximum(2 * plan.smallest[tree], 2)
        open_nodes = open_nodes[enough & (level < plan.depth[tree])]
        if not len(open_nodes):
            break
        found = [
            _best_splits(rows, forest, nodes, width, plan)
            for nodes in _portions(open_nodes, max(1, PORTION_NUMBERS // (width + 1)))
        ]
        open_nodes = forest.grow(pd.concat(found).sort_values("node"))
        level += 1
    forest.value += mean
    return forest


def _best_splits(rows: DataFrame, forest: Forest, nodes: np.ndarray, width: int, plan: Plan) -> pd.DataFrame:
    """One row per node of the portion that can be split."""
    context = rows.sparkSession.sparkContext
    walk = context.broadcast(_Walk(forest, nodes, plan.without))
    smallest = plan.smallest[forest.tree[nodes]]

    def ranges_of(batches):
        lo, hi = np.full((width + 1, len(nodes)), np.inf), np.full((width + 1, len(nodes)), -np.inf)
        for batch in batches:
            x, fold, _, _, least, most = _numbers(batch, width)
            below, above = [*x.T, least], [*x.T, most]
            for row, slots, _, _ in walk.value.met(x, fold):
                for j in range(width + 1):
                    np.minimum.at(lo[j], slots, below[j][row])
                    np.maximum.at(hi[j], slots, above[j][row])
        seen = np.flatnonzero(np.isfinite(lo[-1]))
        yield from _cells(seen, width + 1, lo=lo.T[seen], hi=hi.T[seen])

    # The label is one more column: where its range is empty, the node is pure.
    ranges = (
        rows.mapInArrow(ranges_of, "slot long, feature int, lo double, hi double")
        .groupBy("slot", "feature")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .toArrow()
    )
    lo, hi = np.zeros((len(nodes), width + 1)), np.zeros((len(nodes), width + 1))
    at = ranges["slot"].to_numpy(), ranges["feature"].to_numpy()
    lo[at], hi[at] = ranges["lo"].to_numpy(), ranges["hi"].to_numpy()
    can = (lo[:, :-1] < hi[:, :-1]) & (lo[:, -1:] < hi[:, -1:])
    # Node numbers follow from the rows alone, so the draws do, too.
    share = draws(plan.seed, nodes, width)
    thresholds = context.broadcast(np.where(can, lo[:, :-1] + share * (hi - lo)[:, :-1], np.nan))

    def sums_of(batches):
        cut = np.ascontiguousarray(thresholds.value.T)
        n, s = np.zeros(len(nodes)), np.zeros(len(nodes))
        left_n, left_s = np.zeros(cut.shape), np.zeros(cut.shape)
        for batch in batches:
            x, fold, number, total, _, _ = _numbers(batch, width)
            columns = np.ascontiguousarray(x.T)
            for row, slots, first, last in walk.value.met(x, fold):
                # The nodes of a tree lie side by side.
                add = lambda at, v: np.bincount(at, weights=v, minlength=last - first)  # noqa: B023, E731
                at, m, t = slots - first, number[row], total[row]
                n[first:last] += add(at, m)
                s[first:last] += add(at, t)
                for j in range(width):
                    left = columns[j][row] <= cut[j].take(slots, mode="clip")
                    left_n[j, first:last] += add(at, m * left)
                    left_s[j, first:last] += add(at, t * left)
        seen = np.flatnonzero(n)
        wide = lambda v: np.repeat(v[seen][:, None], width, axis=1)
        whole = lambda v: v.astype(np.int64)
        yield from _cells(
            seen, width, n=wide(whole(n)), s=wide(s), left_n=whole(left_n.T[seen]), left_s=left_s.T[seen]
        )

    # The portion bounds what reaches the driver, so the best feature of a node needs no further shuffle.
    sums = rows.mapInArrow(
        sums_of, "slot long, feature int, n long, s double, left_n long, left_s double"
    ).groupBy("slot", "feature").agg(*[F.sum(c).alias(c) for c in ("n", "s", "left_n", "left_s")]).toArrow()
    best = _best(sums, smallest)
    best["threshold"] = thresholds.value[best["slot"], best["feature"]]
    best["node"] = nodes[best["slot"]]
    walk.unpersist()
    thresholds.unpersist()
    return best


def _best(sums: pa.Table, smallest: np.ndarray) -> pd.DataFrame:
    """The feature of the largest gain per slot, the first among equals, where both sides have the rows of a leaf."""
    slot, feature, n, s, left_n, left_s = (sums[c].to_numpy() for c in ("slot", "feature", "n", "s", "left_n", "left_s"))
    least = np.maximum(smallest[slot], 1)
    can = np.flatnonzero((left_n >= least) & (n - left_n >= least))
    slot, feature, n, s, left_n, left_s = (v[can] for v in (slot, feature, n, s, left_n, left_s))
    right_n, right_s = n - left_n, s - left_s
    gain = left_s * left_s / left_n + right_s * right_s / right_n - s * s / n
    order = np.lexsort((feature, -gain, slot))
    first = order[np.unique(slot[order], return_index=True)[1]]
    found = {
        "slot": slot, "feature": feature, "gain": gain, "left_n": left_n, "left_mean": left_s / left_n,
        "right_n": right_n, "right_mean": right_s / right_n,
    }
    return pd.DataFrame({k: v[first] for k, v in found.items()})


class _Walk:
    """The trees grown so far, and the open nodes of a portion as slots."""

    def __init__(self, forest: Forest, nodes: np.ndarray, without: np.ndarray):
        self.forest, self.trees = forest, np.unique(forest.tree[nodes])
        self.without = without[self.trees]
        self.slot = np.full(len(forest.feature), -1, np.int64)
        self.slot[nodes] = np.arange(len(nodes))
        # Ids of children follow those of their parents, so the open nodes of a tree are neighbours.
        tree = forest.tree[nodes]
        self.first, self.last = np.searchsorted(tree, self.trees), np.searchsorted(tree, self.trees, "right")

    def met(self, x: np.ndarray, fold: np.ndarray):
        """Per tree: rows in open nodes, their slots, and the range of the slots of the tree."""
        for i, tree in enumerate(self.trees):
            slots = self.slot.take(self.forest.walk(x, tree), mode="clip")
            inside = (slots >= 0) & (fold != self.without[i])
            if inside.all():
                yield slice(None), slots, self.first[i], self.last[i]
            elif inside.any():
                row = np.flatnonzero(inside)
                yield row, slots[row], self.first[i], self.last[i]


def _numbers(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """Matrix of features, then fold, number, sum, smallest and largest label of each row."""
    return _matrix(batch.column("x"), width), *[batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "n", "s", "lo", "hi")]


def _cells(slots: np.ndarray, width: int, **values: np.ndarray):
    """Slot by column matrices as rows ``(slot, feature, *values)``."""
    step = max(1, 1_000_000 // width)
    for i in range(0, len(slots), step):
        part = slots[i : i + step]
        yield pa.RecordBatch.from_pydict({
            "slot": np.repeat(part, width),
            "feature": np.tile(np.arange(width, dtype=np.int32), len(part)),
            **{k: v[i : i + step].reshape(-1) for k, v in values.items()},
        })


def _portions(nodes: np.ndarray, most: int) -> list[np.ndarray]:
    return [nodes[i : i + most] for i in range(0, len(nodes), most)]


def cross_validated_forests(
    rows: DataFrame, settings: Sequence[dict], folds: int, seed: int = 42, most_nodes: int = NODES
) -> list[float]:
    """Mean of the negated MAE over the folds that have rows, for each setting, all grown in the same scans.

    ``rows`` are (x, y, fold). A setting has ``n_estimators``, ``max_depth`` and
    ``min_samples_leaf``; its trees of each fold see the rows outside it. Trees
    of all settings and folds are one forest, so the scans of a study follow
    from the deepest setting and not from their number. Settings are worked off
    in portions whose nodes the driver and each task can hold.
    """
    ship(rows.sparkSession)
    rows = rows.select("x", F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold")).where(
        F.col("fold").isNotNull()
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = rows.count() if settings else 0
        sizes = [folds * s["n_estimators"] * min(2.0 ** (s["max_depth"] + 1), 2.0 * n / s["min_samples_leaf"]) for s in settings]
        portions, held = [], math.inf
        for i, size in enumerate(sizes):
            if held + size > most_nodes:
                portions.append([])
                held = 0.0
            portions[-1].append(i)
            held += size
        scores = [math.nan] * len(settings)
        for portion in portions if n else []:
            for i, score in zip(portion, _validated(rows, [settings[i] for i in portion], folds, seed)):
                scores[i] = score
        return scores
    finally:
        rows.unpersist()


def _validated(rows: DataFrame, settings: list[dict], folds: int, seed: int) -> list[float]:
    here = [r["fold"] for r in rows.select("fold").distinct().collect() if 0 <= r["fold"] < folds]
    jobs = [(i, k) for i in range(len(settings)) for k in sorted(here)]
    counts = [settings[i]["n_estimators"] for i, _ in jobs]
    spread = lambda values: np.repeat(np.array(values, np.int64), counts)
    plan = Plan(
        spread([settings[i]["max_depth"] for i, _ in jobs]), spread([settings[i]["min_samples_leaf"] for i, _ in jobs]),
        spread([k for _, k in jobs]), seed,
    )
    forest, width = grow_forest(rows, plan)
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    last = np.cumsum(counts)
    trees = {job: np.arange(end - m, end) for job, end, m in zip(jobs, last.tolist(), counts)}

    def errors_of(batches):
        n, off = np.zeros(len(jobs), np.int64), np.zeros(len(jobs))
        for batch in batches:
            x, y, fold = _matrix(batch.column("x"), width), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for k in here:
                mine = fold == k
                seen = x[mine]
                for j, job in enumerate(jobs) if mine.any() else ():
                    if job[1] == k:
                        n[j] += mine.sum()
                        off[j] += np.abs(shared.value.predict(seen, trees[job]) - y[mine]).sum()
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"job": seen, "n": n[seen], "off": off[seen]})

    found = rows.mapInArrow(errors_of, "job long, n long, off double").groupBy("job").agg(
        (F.sum("off") / F.sum("n")).alias("mae")
    ).collect()  # a row per setting and fold
    shared.unpersist()
    maes = {r["job"]: r["mae"] for r in found}
    return [
        -float(np.mean([maes[j] for j, job in enumerate(jobs) if job[0] == i])) for i in range(len(settings))
    ] if here else [math.nan] * len(settings)


class ExtraTreesModel(Model, _TreeParams, MLReadable, MLWritable):
    """A fitted forest; predicts the mean of its trees."""

    numFeatures = Param(Params._dummy(), "numFeatures", "features it was grown on", TypeConverters.toInt)

    def __init__(self, forest: Forest | None = None):
        super().__init__()
        self.forest = forest

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        shared, width = dataset.sparkSession.sparkContext.broadcast(self.forest), self.getOrDefault(self.numFeatures)

        @F.arrow_udf(T.DoubleType())
        def predict(x: pa.Array) -> pa.Array:
            return pa.array(shared.value.predict(_matrix(x, width)))

        return dataset.withColumn(self.getPredictionCol(), predict(vector_to_array(named(self.getFeaturesCol()))))

    @property
    def featureImportances(self):
        """Share of each feature in the gains, averaged over the trees."""
        f, width = self.forest, self.getOrDefault(self.numFeatures)
        split = f.feature >= 0
        gains = np.zeros((f.trees, width))
        np.add.at(gains, (f.tree[split], f.feature[split]), f.gain[split])
        totals = gains.sum(axis=1, keepdims=True)
        shares = np.divide(gains, totals, out=np.zeros_like(gains), where=totals > 0).mean(axis=0)
        return Vectors.dense(shares / shares.sum() if shares.sum() > 0 else shares)

    def node_table(self, spark) -> DataFrame:
        """The model as rows, one per node."""
        f = self.forest
        return spark.createDataFrame(pa.table({
            "node": np.arange(len(f.feature)), "tree": f.tree, "feature": f.feature, "threshold": f.threshold,
            "left": f.left, "value": f.value, "count": f.count, "gain": f.gain,
        }))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader(cls)


class _ForestWriter(DefaultParamsWriter):
    """Metadata like any stage, and the node table as parquet next to it."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.node_table(self.sparkSession).write.parquet(f"{path}/nodes")


class _ForestReader(DefaultParamsReader):
    def load(self, path: str) -> ExtraTreesModel:
        model = super().load(path)
        t = self.sparkSession.read.parquet(f"{path}/nodes").toArrow().to_pandas().sort_values("node")
        model.forest = Forest(
            t["feature"].to_numpy(np.int32), t["threshold"].to_numpy(), t["left"].to_numpy(np.int64),
            t["value"].to_numpy(), t["count"].to_numpy(np.int64), t["gain"].to_numpy(), t["tree"].to_numpy(np.int64),
            int((t["node"] == t["tree"]).sum()),
        )
        return model
