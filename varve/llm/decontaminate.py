"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are compared as words (A-Z folded, ASCII
punctuation separates). Runs of ``seed`` words that both have are the seeds.
Where the seeds of a document could cover enough of an item (or any item that
shares a seed, with ``tile_from=0``), tiles are laid:
again and again the longest run of words that both have, and that no tile
covers yet, becomes a tile on either side, down to ``seed`` words. Runs are
found by Karp-Rabin hashes of all windows of a length and confirmed word by
word. The share of the item's words that tiles cover is its coverage, whatever
the order in which the document has them, so reordered passages are caught.

Items are read in blocks of bounded size; each block is broadcast and held
against all documents, a scan without a shuffle. A document that shares a
popular passage costs the same as any other.

Empty and NULL texts, and documents that share no seed, have coverage 0 and no
item. An item shorter than a seed is one seed; an item without words covers
nothing. Ties go to the smaller item id. A benchmark without rows leaves all
documents clean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.functions.columns import named
from varve.llm.common import fresh, materialise, whole_text
from varve.llm.words import GOLDEN, mixed, plain_words
from varve.session import ship


# Words of a seed, and thus of the shortest tile.
SEED = 5
# Share of an item's words that tiles must cover.
COVERAGE = 0.6
# Benchmark text that is broadcast at a time, in bytes.
BLOCK_BYTES = 16 << 20

_POWERS = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 4096)
        up, down = np.full(size, GOLDEN, dtype=np.uint64), np.full(size, np.uint64(pow(int(GOLDEN), -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class _Side:
    """A row of words with the hashes of all its windows, and what tiles cover."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.free = ids, np.ones(len(ids), dtype=bool)
        up, self.down = _powers(len(ids) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(ids) * up[:-1], dtype=np.uint64)])

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that no tile touches."""
        if len(self.ids) < length:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        starts = np.flatnonzero(taken[length:] == taken[:-length])
        return starts, (self.sums[starts + length] - self.sums[starts]) * self.down[starts]


def lay_tiles(doc: np.ndarray, item: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Tiles ``(start in doc, start in item, length)``, the longest first.

    ``doc`` and ``item`` are word numbers; negative ones equal nothing.
    """
    a, b = _Side(np.where(doc < 0, -1, doc).astype(np.int64)), _Side(item.astype(np.int64))
    a.free &= doc >= 0
    tiles, longest = [], min(len(doc), len(item))
    while longest >= shortest:
        low, high = shortest - 1, longest
        while low < high:  # the longest length at which any window meets
            middle = (low + high + 1) // 2
            if len(np.intersect1d(a.windows(middle)[1], b.windows(middle)[1])):
                low = middle
            else:
                high = middle - 1
        if low < shortest:
            break
        length, longest = low, low
        starts, hashes = a.windows(length)
        where: dict[int, list[int]] = {}
        for s, h in zip(starts.tolist(), hashes.tolist()):
            where.setdefault(h, []).append(s)
        marked = False
        for s, h in zip(*(x.tolist() for x in b.windows(length))):
            places = where.get(h)
            while places and b.free[s:s + length].all():
                at = places.pop(0)
                if a.free[at:at + length].all() and (a.ids[at:at + length] == b.ids[s:s + length]).all():
                    a.free[at:at + length] = b.free[s:s + length] = False
                    tiles.append((at, s, length))
                    marked = True
        if not marked:  # hashes met but words did not
            longest = length - 1
    return tiles


class Block:
    """Some benchmark items, with their words numbered and their seeds sorted."""

    def __init__(self, items: list[tuple[object, str]], seed: int):
        self.seed, self.numbers = seed, {}
        self.keys, self.items, short = [], [], {}
        seeds, owners, places = [], [], []
        for key, text in items:
            words = plain_words(text)
            if not words:
                continue
            ids = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], dtype=np.int64)
            k, n = len(self.items), min(seed, len(ids))
            self.keys.append(key)
            self.items.append(ids)
            starts, hashes = _Side(ids).windows(n)
            if n < seed:
                short.setdefault(n, []).append((k, hashes[0]))
                continue
            seeds.append(hashes)
            owners.append(np.full(len(starts), k))
            places.append(starts)
        if seeds:
            hashes, owners, places = map(np.concatenate, (seeds, owners, places))
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.owners, self.places = hashes[order], owners[order], places[order]
        else:
            self.hashes, self.owners, self.places = np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int)
        self.short = short

    def best(self, text: str | None, enough: float) -> tuple[float, object, int]:
        """Highest coverage, its item (None for 0) and its number of tiles.

        Items of which the seeds cover less than ``enough`` are not tiled, as
        each tile consists of seeds.
        """
        get = self.numbers.get
        ids = np.array([get(w, -1) for w in plain_words(text)], dtype=np.int64)
        candidates: dict[int, float] = {}
        inside = ids >= 0
        if not inside.any():
            return 0.0, None, 0
        side = _Side(ids)
        side.free &= inside
        if len(self.hashes) and len(ids) >= self.seed:
            starts, hashes = side.windows(self.seed)
            at = np.searchsorted(self.hashes, hashes)
            met = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes
            found = np.unique(hashes[met])
            if len(found):
                left, right = np.searchsorted(self.hashes, found), np.searchsorted(self.hashes, found, "right")
                spots = np.concatenate([np.arange(x, y) for x, y in zip(left, right)])
                owners, places = self.owners[spots], self.places[spots]
                for k in np.unique(owners).tolist():
                    covered = np.zeros(len(self.items[k]), dtype=bool)
                    for p in places[owners == k].tolist():
                        covered[p:p + self.seed] = True
                    if (most := float(covered.mean())) >= enough:
                        candidates[k] = most
        for n, those in self.short.items():
            have = set(side.windows(n)[1].tolist())
            candidates.update((k, 1.0) for k, h in those if int(h) in have)
        best = (0.0, None, 0)
        for k in sorted(candidates, key=lambda k: (-candidates[k], k)):
            if candidates[k] < best[0]:  # tiles consist of seeds, so no later item covers more
                break
            item = self.items[k]
            tiles = lay_tiles(ids, item, min(self.seed, len(item)))
            if tiles:
                best = _better(best, (sum(t[2] for t in tiles) / len(item), self.keys[k], len(tiles)))
        return best


def _blocks(bench: DataFrame, key: str, text: str, seed: int, block_bytes: int) -> Iterator[Block]:
    rows = bench.select(named(key).alias("key"), whole_text(named(text)).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("key", "text"), F.lit(n))
    for i in range(n):
        yield Block([(r["key"], r["text"]) for r in rows.where(part == i).collect()], seed)


def coverage(
    docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    seed: int = SEED, enough: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
    names: tuple[str, str, str, str] = ("coverage", "covered_item", "n_tiles", "contaminated"), tile_from: float | None = None,
) -> DataFrame:
    """``docs`` with the best coverage, its item, its number of tiles, and whether it reaches ``enough``.

    Items of which the seeds cover at least ``tile_from`` are tiled, and coverage
    is exact from there on; others count as 0. Without ``tile_from`` these are
    the items that can reach ``enough``; with 0 all coverages are exact. ``names`` are the new columns; columns of
    ``docs`` with these names are replaced. Items with a NULL id are left out.
    """
    ship(docs.sparkSession)
    out = docs.drop(*names)
    kind = bench.schema[item].dataType
    empty = [F.lit(0.0), F.lit(None).cast(kind), F.lit(0).cast("long")]
    out = out.select("*", *[e.alias(n) for e, n in zip(empty, names)])
    sc = docs.sparkSession.sparkContext
    for i, block in enumerate(_blocks(bench.where(named(item).isNotNull()), item, item_text, seed, block_bytes)):
        if i:
            out = materialise(out)  # one block in memory at a time
        out = out.mapInArrow(_compared(sc.broadcast(block), text, names[:3], enough if tile_from is None else tile_from), out.schema)
    return out.withColumn(names[3], named(names[0]) >= enough)


def _compared(held, text: str, names: tuple[str, ...], enough: float) -> Callable:
    """Replaces what earlier blocks found by what this one has, where that covers more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.schema.names.index(n) for n in (text, *names)]
            before = zip(*(batch.column(k).to_pylist() for k in at[1:]))
            found = [_better(old, held.value.best(t.as_py(), enough)) for t, old in zip(batch.column(at[0]), before)]
            columns = list(batch.columns)
            for k, values in zip(at[1:], zip(*found)):
                columns[k] = pa.array(values, type=batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return work


def _better(a: tuple, b: tuple) -> tuple:
    """The one that covers more; the smaller item of two that cover as much."""
    if a[1] is None or b[1] is None:
        return a if b[1] is None else b
    return min(a, b, key=lambda x: (-x[0], x[1]))


def drop_contaminated(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose coverage stays below the threshold."""
    names = fresh(docs, "coverage", "covered_item", "n_tiles", "contaminated")
    return coverage(docs, bench, names=tuple(names), **how).where(~named(names[3])).drop(*names)
