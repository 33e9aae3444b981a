"""Exact inner-product search, exhaustive and term at a time.

Vectors of integer weights are sparse rows: a term is a position, a posting a
row with a weight other than 0 there. Tasks pack the rows they scan into blocks
of postings, ordered by term, and the queries into blocks of sparse rows. Every
block of queries meets every block of postings once: posting blocks are dealt
into buckets, query blocks go to all of these, and the two are joined on the
bucket. A task adds the postings of one term after the other, weighted by the
queries that have it, into dense arrays of scores, selects the leading ``k`` by
partition, and merges them from block to block; a ranking per query merges what
the buckets found. Scores are whole numbers, so nothing is approximate.

Rows whose weights are NULL or hold a NULL take no part. An empty vector scores
0, and vectors of different lengths are compared on the positions they share. A
query is not compared with rows of its own key; rows that repeat each get a
place, and a query row that repeats gets its answers again. A NULL key can be
found, after all others among ties. Scores beyond the range of a long are
computed exactly and reported as the limit of that range. An empty table, or
one without queries, gives no rows. Other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.columns import named
from varve.llm.common import materialise
from varve.session import ship

K = 10
# Rows and postings of a packed block, posting blocks that a task merges, and queries scored at a time.
BLOCK, BLOCK_POSTINGS = 2048, 1 << 20
QUERY_BLOCK = 512
BUCKET = 64
CHUNK = 64

LONGEST = (1 << 63) - 1


def integer_weights(vector: Column, factor: int) -> Column:
    """``floor(factor * x)`` of each component as double; NULL where a component is missing or not finite."""
    value = vector.cast("array<double>")
    finite = F.forall(value, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.when(finite, F.transform(value, lambda x: F.floor(x * float(factor)).cast("long")))


class _Rows:
    """Rows gathered until a block is full."""

    def __init__(self):
        self.keys, self.lengths, self.values = [], [], []
        self.rows = self.postings = 0

    def add(self, batch: pa.RecordBatch) -> None:
        weights = batch.column("weights")
        self.keys.append(batch.column("id"))
        self.lengths.append(pc.list_value_length(weights).to_numpy(zero_copy_only=False).astype(np.int64))
        self.values.append(weights.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        self.rows += batch.num_rows
        self.postings += len(self.values[-1])

    def arrays(self):
        """Keys, which of them are known, and (row, term, weight) of all postings, rows in the order of their keys."""
        keys = pa.concat_arrays(self.keys)
        known = keys.is_valid().to_numpy(zero_copy_only=False)
        keys = pc.fill_null(keys, 0).to_numpy(zero_copy_only=False)
        lengths, values = np.concatenate(self.lengths), np.concatenate(self.values)
        row = np.repeat(np.arange(len(keys)), lengths)
        term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.lexsort((keys, ~known))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        has = values != 0
        return keys[order], known[order], place[row[has]], term[has], values[has]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[_Rows]:
    held = _Rows()
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, min(rows - held.rows, 256))
            at += piece.num_rows
            held.add(piece)
            if held.rows >= rows or held.postings >= BLOCK_POSTINGS:
                yield held
                held = _Rows()
    if held.rows:
        yield held


PACKED = "keys binary, n_known int, lead binary, second binary, weights binary"
_PACKED = pa.schema([
    ("keys", pa.binary()), ("n_known", pa.int32()), ("lead", pa.binary()), ("second", pa.binary()), ("weights", pa.binary()),
])


def _packer(rows: int, by_term: bool):
    """One row per block; postings are ordered by term, or by row for queries."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, rows):
            keys, known, row, term, weight = block.arrays()
            lead, second = (term, row) if by_term else (row, term)
            order = np.lexsort((second, lead))
            small = np.int32 if len(weight) == 0 or abs(weight).max() < 1 << 31 else np.int64
            yield pa.RecordBatch.from_arrays([
                pa.array([x], t) for x, t in (
                    (keys.tobytes(), pa.binary()), (int(known.sum()), pa.int32()),
                    (lead[order].astype(np.int32).tobytes(), pa.binary()),
                    (second[order].astype(np.int32).tobytes(), pa.binary()),
                    (weight[order].astype(small).tobytes(), pa.binary()),
                )
            ], schema=_PACKED)

    return pack


def _unpacked(batch: pa.RecordBatch, i: int, side: str):
    keys, n_known, lead, second, weights = (batch.column(side + f.name)[i].as_py() for f in _PACKED)
    lead, second = np.frombuffer(lead, np.int32), np.frombuffer(second, np.int32)
    wide = np.int64 if len(weights) == 8 * len(lead) else np.int32
    return np.frombuffer(keys, np.int64), n_known, lead, second, np.frombuffer(weights, wide).astype(np.int64)


class _Postings:
    """A block of postings by term."""

    def __init__(self, keys, n_known, terms, rows, weights):
        self.keys, self.n_known = keys, n_known
        edges = np.flatnonzero(np.diff(terms, prepend=-1))
        self.terms = terms[edges].tolist()
        self.lists = [(rows[a:b], weights[a:b]) for a, b in zip(edges, [*edges[1:], len(terms)])]
        self.most = int(abs(weights).max()) if len(weights) else 0


class _Leaders:
    """The leading rows found so far for each query of a block."""

    def __init__(self, first: int, keys: np.ndarray, rows, terms, weights, k: int, chunk: int):
        self.first, self.keys, self.k, self.chunk = first, keys, k, chunk
        self.rows, self.terms, self.weights = rows, terms, weights
        self.most = int(abs(weights).max()) if len(weights) else 0
        shape = (len(keys), 0)
        self.scores, self.found = np.empty(shape, np.int64), np.empty(shape, np.int64)
        self.unknown, self.void = np.empty(shape, bool), np.empty(shape, bool)

    def meet(self, block: _Postings) -> None:
        parts = [
            self._selected(block, a, min(a + self.chunk, len(self.keys))) for a in range(0, len(self.keys), self.chunk)
        ]
        new = [np.concatenate(x) for x in zip(*parts)]
        both = [np.concatenate(x, axis=1) for x in zip((self.scores, self.found, self.unknown, self.void), new)]
        scores, found, unknown, void = both
        order = np.lexsort((found, unknown, -scores, void), axis=-1)[:, :self.k]
        self.scores, self.found, self.unknown, self.void = (np.take_along_axis(x, order, axis=1) for x in both)

    def _selected(self, block: _Postings, a: int, b: int):
        """Scores of queries a to b with all rows of the block, and the leading ones."""
        n = len(block.keys)
        first, last = np.searchsorted(self.rows, [a, b])
        rows, terms, weights = self.rows[first:last] - a, self.terms[first:last], self.weights[first:last]
        bound = self.most * block.most * max(1, len(block.terms))
        kind = np.int64 if (bound + 2) * n < LONGEST else object
        scores = np.zeros((b - a, n), dtype=kind)
        order = np.argsort(terms, kind="stable")
        rows, terms, weights = rows[order], terms[order], weights[order].astype(kind)
        starts = np.searchsorted(terms, block.terms)
        ends = np.searchsorted(terms, block.terms, side="right")
        for (at, posted), s, e in zip(block.lists, starts.tolist(), ends.tolist()):
            if s == e:
                continue
            add = np.multiply.outer(weights[s:e], posted.astype(kind))
            if len(at) < n:
                scores[np.ix_(rows[s:e], at)] += add
            elif e - s < b - a:
                scores[rows[s:e]] += add
            else:  # every query has the term, and every row
                scores += add
        # Rows stand in the order of their keys, so among equal scores the smaller place leads.
        ranked = scores * n + np.arange(n - 1, -1, -1, dtype=np.int64).astype(kind)
        none = -(bound + 2) * n
        lo = np.searchsorted(block.keys[:block.n_known], self.keys[a:b])
        hi = np.searchsorted(block.keys[:block.n_known], self.keys[a:b], side="right")
        for i in np.flatnonzero(hi > lo).tolist():
            ranked[i, lo[i]:hi[i]] = none
        k = min(self.k, n)
        top = np.argpartition(ranked, n - k, axis=1)[:, n - k:]
        void = np.take_along_axis(ranked, top, axis=1) == none
        best = np.clip(np.take_along_axis(scores, top, axis=1), -LONGEST, LONGEST).astype(np.int64)
        return best, block.keys[top], top >= block.n_known, void.astype(bool)

    def batch(self) -> pa.RecordBatch:
        keep = ~self.void
        row = np.nonzero(keep)[0]
        return pa.RecordBatch.from_arrays([
            pa.array(self.first + row, pa.int64()), pa.array(self.keys[row], pa.int64()),
            pa.array(self.found[keep], pa.int64(), mask=self.unknown[keep]), pa.array(self.scores[keep], pa.int64()),
        ], names=["query_row", "query_id", "vec_id", "score"])


def _scored(k: int, chunk: int, query_block: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = last = None
        for batch in batches:
            for i in range(batch.num_rows):
                turn = (batch.column("bucket")[i].as_py(), batch.column("number")[i].as_py())
                if turn != last:
                    if held is not None:
                        yield held.batch()
                    keys, _, *rest = _unpacked(batch, i, "q_")
                    held, last = _Leaders(turn[1] * query_block, keys, *rest, k, chunk), turn
                held.meet(_Postings(*_unpacked(batch, i, "c_")))
        if held is not None:
            yield held.batch()

    return score


def top_inner_products(
    rows: DataFrame, is_query: Column, key: str = "vec_id", weights: str = "weights", k: int = K, block: int = BLOCK,
    query_block: int = QUERY_BLOCK, bucket: int = BUCKET, chunk: int = CHUNK,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` largest inner products of each query, ties to the smaller key.

    ``weights`` is an array of whole numbers, ``key`` a whole number; a row
    where ``is_query`` is true and the key is known is a query. Sizes of blocks,
    buckets and chunks change the work of a task and not the result.
    """
    spark = rows.sparkSession
    ship(spark)
    weighed = F.col("weights").isNotNull() & ~F.exists("weights", lambda w: w.isNull())
    taken = rows.select(
        named(key).cast("long").alias("id"), named(weights).cast("array<bigint>").alias("weights"),
        is_query.alias("asked"),
    ).where(weighed)
    postings = materialise(taken.drop("asked").mapInArrow(_packer(block, True), PACKED))
    asked = taken.where(F.col("asked") & F.col("id").isNotNull()).drop("asked").hint("rebalance")
    queries = materialise(
        asked.mapInArrow(_packer(query_block, False), PACKED).withColumn("number", F.monotonically_increasing_id())
    )
    # Enough buckets for all cores, and more where a bucket would hold many blocks; rows of a block are in one.
    blocks = postings.count()
    buckets = max(1, -(-blocks // bucket), min(blocks, 4 * spark.sparkContext.defaultParallelism))
    dealt = postings.select(
        F.pmod(F.xxhash64("keys", "weights", F.monotonically_increasing_id()), F.lit(buckets)).cast("int").alias("bucket"),
        *[F.col(f.name).alias("c_" + f.name) for f in _PACKED],
    )
    sent = queries.select(
        "number", *[F.col(f.name).alias("q_" + f.name) for f in _PACKED],
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"),
    )
    # Both sides grow with the table, so neither is broadcast; the rows of a query block and a bucket follow each other.
    met = sent.join(dealt.hint("merge"), "bucket")
    found = materialise(met.mapInArrow(_scored(k, chunk, query_block), "query_row long, query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
