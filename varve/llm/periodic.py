"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of words that repeats with a smallest period ``q`` at least
``LEAST`` times and that no neighbouring word extends. Texts are worked off at
dyadic scales. At scale ``s`` each stretch of ``s`` words has a hash; a position
is synchronising if, among the positions up to ``s`` further, the smallest hash
stands at the first or the last. That depends on the next ``2 s`` words alone,
so a run of a period from ``s`` to ``2 s`` holds such a position and the same one
a period later: a position and the next one with an equal context propose their
distance as a period, and the proposal is extended word by word and checked.
Positions in highly periodic regions, whose period is at most ``s / 4``, are left
out of the set, as all of them would be equal; these regions are runs of smaller
scales, and periods below ``FIRST`` words are found by comparing neighbours.
Any run of four periods has the room that the argument needs (three times the
scale and a period), so the result is whole; only two different contexts of one
text with equal 64-bit hashes could hide a run.

Tasks work on many texts at once, joined by separators that equal nothing. NULL
and blank texts have no words and no runs. A text of any length is worked off in
memory in proportion to its words. Repeated rows, NULL keys and further columns,
whatever their names, are carried along or left out as the caller selects; an
empty table gives an empty table. Runs are ordered by start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.functions.columns import named
from varve.llm.common import whole_text
from varve.llm.words import GOLDEN, mixed
from varve.session import ship

# Periods that a run holds, its fewest words, and the first scale; smaller periods are compared directly.
LEAST, FEWEST, FIRST = 4, 6, 4
# Words and rows that a task works on at once.
WORDS, ROWS = 1 << 19, 4096

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _mismatch(t: np.ndarray, i: int, d: int) -> int:
    """The first position from ``i`` on whose word differs from the one ``d`` later."""
    step = 64
    while True:
        later = t[i + d:i + d + step]
        differ = np.flatnonzero(t[i:i + len(later)] != later)
        if len(differ):
            return i + int(differ[0])
        i += len(later)
        if len(later) < step:
            return i
        step *= 2


def _mismatch_before(t: np.ndarray, i: int, d: int) -> int:
    """The first position of the stretch up to ``i`` whose words equal those ``d`` later."""
    step = 64
    while i > 0:
        a = max(0, i - step)
        differ = np.flatnonzero(t[a:i] != t[a + d:i + d])
        if len(differ):
            return a + int(differ[-1]) + 1
        i, step = a, step * 2
    return 0


def _primitive(root: np.ndarray) -> bool:
    """Whether a stretch is no repetition of a shorter one."""
    n, left, p = len(root), len(root), 2
    while left > 1:
        if left % p == 0:
            q = n // p
            if (root[q:] == root[:-q]).all():
                return False
            while left % p == 0:
                left //= p
        p = p + 1 if p * p <= left else max(left, p + 1)
    return True


def _direct(t: np.ndarray, period: int) -> list[tuple[int, int, int]]:
    """Runs of a small period, as (start, end, period)."""
    same = np.zeros(len(t) + 1, dtype=np.int8)
    if len(t) > period:
        same[1:len(t) - period + 1] = t[period:] == t[:-period]
    edges = np.diff(same, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    wide = ends - starts >= (LEAST - 1) * period
    return [
        (a, b + period, period) for a, b in zip(starts[wide].tolist(), ends[wide].tolist()) if _primitive(t[a:a + period])
    ]


def _in_regions(runs: list[tuple[int, int, int]], scale: int, n: int) -> np.ndarray:
    """Positions whose next ``scale`` words lie in a run of a period of at most a quarter of the scale."""
    change = np.zeros(n + 1, dtype=np.int32)
    regions = [(a, b) for a, b, q in runs if LEAST * q <= scale and b - a >= scale and a < n]
    if regions:
        a, b = np.array(regions).T
        np.add.at(change, a, 1)
        np.add.at(change, np.minimum(b - scale + 1, n), -1)
    return np.cumsum(change[:-1]) > 0


def _synchronising(names: np.ndarray, omitted: np.ndarray, scale: int) -> np.ndarray:
    """Positions where the smallest name of the next ``scale + 1`` stands first or last."""
    last = np.uint64(np.iinfo(np.uint64).max)
    seen = np.where(omitted, last, names)
    least, width = seen, 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(names) - scale
    least = np.minimum(least[:n], seen[scale:])
    first, final = ~omitted[:n] & (names[:n] == least), ~omitted[scale:] & (names[scale:] == least)
    return np.flatnonzero(first | final)


def runs_of(t: np.ndarray, longest: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) of ``LEAST`` periods or more in texts that stand one after the other.

    ``t`` numbers the words, and each text ends with a number of its own.
    ``longest`` has the lengths of the texts, in falling order: the larger a
    scale, the fewer texts in front are long enough for it.
    """
    runs = [r for p in range(1, FIRST) for r in _direct(t, p)]
    ends = np.cumsum(longest + 1)
    scale, names = 1, mixed(t.astype(np.uint64) * GOLDEN)
    while True:
        fit = np.searchsorted(-longest, -LEAST * max(scale, FIRST), side="right")
        if not fit:
            return runs
        n = int(ends[fit - 1])
        names = names[:n - scale + 1]
        wider = mixed(names[:len(names) - scale] * GOLDEN + names[scale:])
        if scale >= FIRST:
            chosen = _synchronising(names, _in_regions(runs, scale, len(names)), scale)
            context = wider[chosen]
            order = np.argsort(context, kind="stable")
            at, context = chosen[order], context[order]
            apart = at[1:] - at[:-1]
            proposed = np.flatnonzero((context[1:] == context[:-1]) & (apart >= scale) & (apart < 2 * scale))
            runs += _extended(t, at[proposed], apart[proposed])
        scale, names = 2 * scale, wider


def _extended(t: np.ndarray, at: np.ndarray, apart: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs that the proposals (position, period) lie in."""
    order = np.lexsort((at, apart))
    out, known = [], (0, 0, 0)
    for i, d in zip(at[order].tolist(), apart[order].tolist()):
        if d == known[2] and known[0] <= i and i + d < known[1]:
            continue
        right = _mismatch(t, i, d)
        if right == i:
            continue
        known = (_mismatch_before(t, i, d), right + d, d)
        if known[1] - known[0] >= LEAST * d and _primitive(t[known[0]:known[0] + d]):
            out.append(known)
    return out


def _solved(texts: list[list[bytes]]) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed text of each text."""
    by_length = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in by_length], dtype=np.int64)
    numbers: dict[bytes, int] = {}
    parts = []
    for k, i in enumerate(by_length):
        parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in texts[i]), np.int64, len(texts[i])))
        parts.append(np.array([-1 - k]))
    t = np.concatenate(parts)
    starts = np.cumsum(lengths + 1) - lengths - 1
    runs = sorted((a, q, b) for a, b, q in runs_of(t, lengths) if b - a >= FEWEST)
    found: list[list[dict]] = [[] for _ in texts]
    dropped = np.zeros(len(t) + 1, dtype=np.int64)
    for (a, q, b), k in zip(runs, np.searchsorted(starts, [r[0] for r in runs], side="right") - 1):
        found[by_length[k]].append({"start": a - int(starts[k]), "length": b - a, "period": q})
        dropped[a + q] += 1
        dropped[b] -= 1
    keep = np.cumsum(dropped) == 0
    collapsed = [b""] * len(texts)
    for k, i in enumerate(by_length):
        words = texts[i]
        if found[i]:
            words = [words[j] for j in np.flatnonzero(keep[starts[k]:starts[k] + lengths[k]]).tolist()]
        collapsed[i] = b" ".join(words)
    return found, collapsed


def _searched(most: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [f for f in batch.schema if f.name != "text"]
            a, texts, words = 0, [], 0
            column = batch.column("text").cast(pa.binary())
            for i in range(batch.num_rows):
                texts.append(column[i].as_py().split())
                words += len(texts[-1])
                if words < most and len(texts) < ROWS and i + 1 < batch.num_rows:
                    continue
                runs, collapsed = _solved(texts)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(f.name).slice(a, len(texts)) for f in kept],
                    pa.array([len(x) for x in texts], pa.int64()), pa.array(runs, _RUNS),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ], schema=pa.schema([*kept, ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())]))
                a, texts, words = i + 1, [], 0

    return search


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Rows (key, n_words, runs, collapsed): the runs of each text, and its words without the repeats.

    Words are what ASCII white space separates. ``collapsed`` has no word that
    lies in a run after the first period of it; words are joined by one space.
    ``words`` is how many a task works on at once, or those of one text if it has more.
    """
    ship(docs.sparkSession)
    rows = docs.select(named(key).alias("key"), whole_text(named(text)).alias("text"))
    out = T.StructType([
        T.StructField("key", rows.schema["key"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType()),
    ])
    return rows.mapInArrow(_searched(words), out).withColumnRenamed("key", key)


def strongest(runs: Column) -> Column:
    """The run with the most periods; among equals the first, which starts first and has the smaller period."""
    none = F.lit(None).cast(RUNS.elementType)
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
    ).otherwise(best))
