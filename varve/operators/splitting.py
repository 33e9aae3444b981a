"""Deterministic splits and folds from a hash of (seed, row key)."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.hashing import HASH_RANGE, digest, hash32

# Seeds and sizes of the three partitions of a table.
TEST_FRACTION, TEST_SEED = 0.2, 16
FOLDS, FOLD_SEED = 5, 48
HOLDOUT_FRACTION, HOLDOUT_SEED = 0.2, 42

# Leading hex digits of the digest that name a bucket at first, digits that are added to a bucket
# that is still too large, and the rows of a bucket that one task sorts.
DIGITS, MORE_DIGITS, BUCKET_ROWS = 3, 3, 50_000


def in_fraction(key: Column, fraction: float, seed: object) -> Column:
    """True for about ``fraction`` of the keys: no shuffle, no second pass."""
    return hash32(seed, key) < F.lit(math.floor(fraction * HASH_RANGE))


def split_label(key: Column, fraction: float = TEST_FRACTION, seed: object = TEST_SEED) -> Column:
    return F.when(in_fraction(key, fraction, seed), "test").otherwise("train")


def fold_index(key: Column, folds: int = FOLDS, seed: object = FOLD_SEED) -> Column:
    return (hash32(seed, key) % folds).cast("int")


def is_holdout(key: Column, fraction: float = HOLDOUT_FRACTION, seed: object = HOLDOUT_SEED) -> Column:
    return in_fraction(key, fraction, seed)


def bucket_counts(df: DataFrame, key: str, seed: object, prefix: str = "", digits: int = DIGITS) -> list[tuple[str, int]]:
    """Rows per leading digits of the digest below ``prefix``, ascending: at most 16**DIGITS pairs."""
    d = digest(seed, F.col(key))
    rows = df.where(d.startswith(prefix)) if prefix else df
    counts = rows.groupBy(F.substring(d, 1, len(prefix) + digits).alias("prefix")).agg(F.count(F.lit(1)).alias("c"))
    return sorted((r["prefix"], r["c"]) for r in counts.collect())


def digest_cuts(
    df: DataFrame, key: str, seed: object, counts: list[tuple[str, int]], ranks: Sequence[int]
) -> list[str]:
    """Digests at the given one-based ranks of the digest order.

    A bucket that holds a rank is counted again by more digits until it is
    small; only the rows of such small buckets are sorted, while a global
    ``row_number`` would send the whole table to one task. Where a key repeats
    across a cut no exact size exists, which is an error.
    """
    wanted: dict[str, list[tuple[int, int]]] = {}
    for i, rank in enumerate(ranks):
        found, place = counts, rank
        while True:
            for prefix, c in found:
                if place <= c:
                    break
                place -= c
            if c <= BUCKET_ROWS or len(prefix) >= 30:
                break
            found = bucket_counts(df, key, seed, prefix, MORE_DIGITS)
        wanted.setdefault(prefix, []).append((place, i))
    digits = {len(p) for p in wanted}
    d = digest(seed, F.col(key))
    inside = functools.reduce(
        lambda a, b: a | b, (F.substring(d, 1, n).isin([p for p in wanted if len(p) == n]) for n in digits)
    )
    named_by = F.coalesce(*[F.when(F.col("d").startswith(p), F.lit(p)) for p in wanted])
    order = Window.partitionBy("prefix").orderBy("d")
    near = (
        df.select(d.alias("d")).where(inside)
        .withColumn("prefix", named_by)
        .withColumns({"rn": F.row_number().over(order), "next": F.lead("d").over(order)})
        .where(F.struct("prefix", "rn").isin([F.struct(F.lit(p), F.lit(n)) for p, at in wanted.items() for n, _ in at]))
    )
    cuts = {}
    for r in near.collect():
        if r["d"] == r["next"]:
            raise ValueError(f"{key!r} has equal values on both sides of a cut; exact sizes need unique keys")
        cuts.update({i: r["d"] for n, i in wanted[r["prefix"]] if n == r["rn"]})
    return [cuts[i] for i in range(len(ranks))]


def exact_split(
    df: DataFrame, key: str, fraction: float = TEST_FRACTION, seed: object = TEST_SEED, name: str = "split"
) -> DataFrame:
    """Label exactly ``ceil(fraction * n)`` rows ``test``, the others ``train``.

    Two small jobs find the digest that separates them; the label itself is a
    comparison per row, so the table is not shuffled.
    """
    counts = bucket_counts(df, key, seed)
    n = sum(c for _, c in counts)
    if n == 0:
        return df.withColumn(name, F.lit("train"))
    cut = digest_cuts(df, key, seed, counts, [math.ceil(fraction * n)])[0]
    return df.withColumn(name, F.when(digest(seed, F.col(key)) <= cut, "test").otherwise("train"))


def exact_folds(
    df: DataFrame, key: str, folds: int = FOLDS, seed: object = FOLD_SEED, name: str = "fold",
    among: Column | None = None,
) -> DataFrame:
    """Folds whose sizes differ by at most one row, the larger ones first.

    ``among`` says which rows the sizes are counted over (the training rows,
    say); the others get a fold by the same cuts.
    """
    counted = df if among is None else df.where(among)
    counts = bucket_counts(counted, key, seed)
    n = sum(c for _, c in counts)
    if n < folds:
        raise ValueError(f"{n} rows cannot fill {folds} folds")
    ends = [(i + 1) * (n // folds) + min(i + 1, n % folds) for i in range(folds - 1)]
    cuts = digest_cuts(counted, key, seed, counts, ends)
    d = digest(seed, F.col(key))
    return df.withColumn(name, sum(((d > c).cast("int") for c in cuts), F.lit(0)))
