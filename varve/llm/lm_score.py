"""Deleted interpolation: n-gram estimates mixed by how frequent their context is.

The maximum-likelihood estimates of all orders, and a uniform floor, are mixed
with weights that depend on the bucket of the context: the longest context that
was seen, and the power of two below its count. The weights are learned by
expectation-maximisation on the counts of training documents that are held out
from the estimates; afterwards all training documents count.

Counting and look-up are two shuffles of word hashes. Documents are dealt into
chunks of bounded size. A chunk sends each distinct n-gram once, with its
counts, to the part of the key space that it belongs to; the part adds up all
chunks and answers each with the totals, in the order asked. So a frequent word
is one entry per chunk, no table of counts is broadcast or collected, and what
is gathered grows with the corpus. Numbers that reach the driver are the corpus
totals and the cells of the histogram for the mixture weights, whose number is
bounded by buckets and steps of probabilities.

A text is its words (A-Z folded, ASCII white space separates) and an end. NULL
counts as empty: an end only. Rows that repeat are counted as often as they
occur. Without training documents all counts are 0 and only the floor is left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.columns import named
from varve.llm.common import materialise, whole_text
from varve.llm.words import GOLDEN, mixed, words_of
from varve.session import ship

ORDER = 2
# Text per chunk, and distinct n-grams per part, that one task holds.
CHUNK_BYTES = 8 << 20
PART_KEYS = 1 << 20
# Steps per decade of a probability in the histogram, and rounds of learning.
STEPS = 32
ROUNDS = 60
# Hashes of what is no word.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

_FIRST, _SECOND, _NONE = 0, 1, 2  # counts for the estimates, for the weights, for neither


@dataclass
class Mixture:
    """Totals of the training documents and weights per bucket."""

    order: int
    tokens: int = 0
    distinct: int = 0
    texts: int = 0
    weights: np.ndarray | None = None  # bucket x (floor, order 1, 2, ...)


@dataclass
class _Chunk:
    """The n-grams of some texts: distinct keys per order, and which one stands at each position."""

    distinct: list[np.ndarray]
    place: list[np.ndarray]
    starts: np.ndarray
    lengths: np.ndarray


def _grams(texts: list[str | None], order: int) -> _Chunk:
    rows = [words_of(t) for t in texts]
    lengths = np.array([len(r) + 1 for r in rows], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    # Words are numbered as they come; the end is number 0.
    numbers: dict[bytes | None, int] = {None: 0}
    ids = np.zeros(int(lengths.sum()), dtype=np.int64)
    inside = np.ones(len(ids), dtype=bool)
    inside[starts + lengths - 1] = False
    ids[inside] = [numbers.setdefault(w, len(numbers)) for r in rows for w in r]
    del rows
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers if w is not None), np.uint64, len(numbers) - 1)
    hashes = np.concatenate([np.array([END]), hashes])
    words = mixed(hashes)
    ranked = np.argsort(words)
    rank = np.empty_like(ranked)
    rank[ranked] = np.arange(len(ranked))
    distinct, place, tokens = [words[ranked]], [rank[ids]], hashes[ids]
    keys = words[ids]
    for _ in range(order - 1):
        before = np.empty_like(tokens)
        before[1:] = keys[:-1]
        before[starts] = START
        keys = mixed(before * GOLDEN + tokens)
        found, at = np.unique(keys, return_inverse=True)
        distinct.append(found)
        place.append(at)
    return _Chunk(distinct, place, starts, lengths)


def _shift(parts: int) -> np.uint64:
    return np.uint64(64 - (parts.bit_length() - 1))


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys >> _shift(parts)).astype(np.int64) if parts > 1 else np.zeros(len(keys), np.int64)


def _packed(counts: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(counts.max())) if len(counts) else np.dtype("u1")
    return kind.char.encode() + counts.astype(kind).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.dtype(blob[:1].decode()), offset=1).astype(np.int64)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences, byte plane by byte plane: the upper planes are nearly empty."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked_keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


_ASK = "level int, part int, chunk int, keys binary, first binary, second binary"
_ANSWER = "chunk int, level int, part int, total binary, first binary, tokens long, kinds long, texts long"


def _schema(spec: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in spec.split(", "))])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _ask(order: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    schema = _schema(_ASK)

    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        found = _grams(table.column("text").to_pylist(), order)
        use = np.repeat(np.array(table.column("use").to_pylist(), dtype=np.int8), found.lengths)
        rows = []
        for level, (distinct, place) in enumerate(zip(found.distinct, found.place), 1):
            counts = [np.bincount(place[use == u], minlength=len(distinct)) for u in (_FIRST, _SECOND)]
            part = _parts_of(distinct, parts)
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                rows.append((level, int(part[a]), chunk, _packed_keys(distinct[a:b]), *(_packed(c[a:b]) for c in counts)))
        return _table(rows, schema)

    return ask


def _answer(table: pa.Table) -> pa.Table:
    level, part = table.column("level")[0].as_py(), table.column("part")[0].as_py()
    keys = [_unpacked_keys(x) for x in table.column("keys").to_pylist()]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for name in ("first", "second"):
        counts = np.concatenate([_unpacked(x) for x in table.column(name).to_pylist()])
        total = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(total, place, counts)
        sums.append(total)
    total = sums[0] + sums[1]
    end = np.searchsorted(distinct, mixed(np.array([END])))[0] if level == 1 else len(distinct)
    ends = int(total[end]) if end < len(distinct) and distinct[end] == mixed(np.array([END]))[0] else 0
    rows, at = [], 0
    for i, (chunk, k) in enumerate(zip(table.column("chunk").to_pylist(), keys)):
        p = place[at:at + len(k)]
        at += len(k)
        stats = (int(total.sum()), int((total > 0).sum()), ends) if i == 0 and level == 1 else (0, 0, 0)
        rows.append((chunk, level, part, _packed(total[p]), _packed(sums[0][p]), *stats))
    return _table(rows, _schema(_ANSWER))


def _counts_at(grams: _Chunk, answers: pa.Table, column: str) -> list[np.ndarray]:
    """For each order, the count of the n-gram at each position."""
    out = []
    levels, parts, blobs = (answers.column(c).to_pylist() for c in ("level", "part", column))
    for level, (distinct, place) in enumerate(zip(grams.distinct, grams.place), 1):
        mine = sorted((p, b) for lv, p, b in zip(levels, parts, blobs) if lv == level)
        counts = np.concatenate([_unpacked(b) for _, b in mine])
        if len(counts) != len(distinct):
            raise RuntimeError("a chunk got answers to other questions than it asked")
        out.append(counts[place])
    return out


def _estimates(counts: list[np.ndarray], starts: np.ndarray, tokens: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates per order and position, and the bucket of each position."""
    shares, bucket = [], np.zeros(len(counts[0]), dtype=np.int64)
    context = np.full(len(counts[0]), tokens, dtype=np.int64)
    for level, count in enumerate(counts):
        if level:
            context = np.empty_like(count)
            context[1:] = counts[level - 1][:-1]
            context[starts] = texts
            power = np.frexp(context.astype(float))[1]
            bucket = np.where(context > 0, level * 64 + np.minimum(power, 63), bucket)
        shares.append(np.divide(count, context, out=np.zeros(len(count)), where=context > 0))
    return np.array(shares), bucket


def _cells(model: Mixture) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = _schema("bucket int, " + ", ".join(f"s{i} int" for i in range(model.order)) + ", n long")

    def cells(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], schema)
        grams = _grams(docs.column("text").to_pylist(), model.order)
        counts = _counts_at(grams, answers, "first")
        shares, bucket = _estimates(counts, grams.starts, model.tokens, model.texts)
        with np.errstate(divide="ignore"):
            step = np.where(shares > 0, np.floor(-np.log10(shares) * STEPS), -1).astype(np.int64)
        found, n = np.unique(np.vstack([bucket, step]), axis=1, return_counts=True)
        return _table([(*map(int, c), int(k)) for c, k in zip(found.T, n)], schema)

    return cells


def learn_weights(cells: np.ndarray, floor: float, order: int) -> np.ndarray:
    """Weights per bucket from rows ``(bucket, step per order..., n)`` by expectation-maximisation."""
    buckets = 64 * order
    weights = np.full((buckets, order + 1), 1.0 / (order + 1))
    if not len(cells):
        return weights
    bucket, n = cells[:, 0], cells[:, -1].astype(float)
    steps = cells[:, 1:-1]
    shares = np.where(steps >= 0, 10.0 ** (-(steps + 0.5) / STEPS), 0.0)
    shares = np.column_stack([np.full(len(cells), floor), np.minimum(shares, 1.0)])
    for _ in range(ROUNDS):
        part = weights[bucket] * shares
        part *= (n / part.sum(axis=1))[:, None]
        # One pseudo-token each keeps every weight above 0.
        sums = np.ones_like(weights)
        np.add.at(sums, bucket, part)
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def _scores(model: Mixture, floor: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([docs.schema.field("key"), *_schema("use int, n_tokens long, n_known long, base_score double, score double")])
        if not docs.num_rows:
            return schema.empty_table()
        grams = _grams(docs.column("text").to_pylist(), model.order)
        starts = grams.starts
        counts = _counts_at(grams, answers, "total")
        shares, bucket = _estimates(counts, starts, model.tokens, model.texts)
        weights = model.weights[bucket]
        mix = weights[:, 0] * floor + (weights[:, 1:] * shares.T).sum(axis=1)
        base = np.log10((counts[0] + 1) / (model.tokens + model.distinct + 1))
        return pa.table([
            docs.column("key"), docs.column("use"), pa.array(grams.lengths),
            pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), starts)),
            pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(np.log10(mix), starts)),
        ], schema=schema)

    return score


def score_texts(
    docs: DataFrame, training: Column, held_out: Column, key: str = "doc_id", text: str = "text", order: int = ORDER,
    chunk_bytes: int = CHUNK_BYTES, part_keys: int = PART_KEYS,
) -> DataFrame:
    """Scores of all documents: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` tells the documents to learn from, ``held_out`` those of them
    that teach the weights. Scores are log10 probabilities. The column
    ``held_out`` of the result is true for documents outside the training set.
    """
    ship(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(whole_text(named(text))) + 1)).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    parts = 1 << max(0, (max(1, size // (6 * part_keys)) - 1).bit_length())
    use = F.when(~F.coalesce(training, F.lit(False)), _NONE).when(held_out, _SECOND).otherwise(_FIRST)
    rows = docs.select(named(key).alias("key"), whole_text(named(text)).alias("text"), use.cast("int").alias("use"))
    # Documents for the weights have chunks of their own, numbered behind the others.
    chunk = F.pmod(F.xxhash64("key", "text"), F.lit(chunks)).cast("int")
    rows = rows.withColumn("chunk", F.when(F.col("use") == _SECOND, chunk + chunks).otherwise(chunk))

    asked = rows.groupBy("chunk").applyInArrow(_ask(order, parts), _ASK)
    answers = materialise(asked.groupBy("level", "part").applyInArrow(_answer, _ANSWER))
    totals = answers.agg(F.sum("tokens"), F.sum("kinds"), F.sum("texts")).first()
    model = Mixture(order, *(int(x or 0) for x in totals))
    floor = 1.0 / (model.distinct + 1)

    second = rows.where(F.col("use") == _SECOND).groupBy("chunk")
    spec = "bucket int, " + ", ".join(f"s{i} int" for i in range(order)) + ", n long"
    cells = second.cogroup(answers.where(F.col("chunk") >= chunks).groupBy("chunk")).applyInArrow(_cells(model), spec)
    names = [c for c in cells.columns if c != "n"]
    # Bounded by buckets and steps of probabilities.
    found = cells.groupBy(*names).agg(F.sum("n").alias("n")).collect()
    model.weights = learn_weights(np.array(sorted(map(tuple, found)), dtype=np.int64).reshape(len(found), order + 2), floor, order)

    kind = rows.schema["key"].dataType.simpleString()
    spec = f"key {kind}, use int, n_tokens long, n_known long, base_score double, score double"
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scores(model, floor), spec)
    return out.select(
        F.col("key").alias(key), (F.col("use") == _NONE).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def fold_of(key: Column) -> Column:
    """Number from 0 to 6; NULL counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(7))
