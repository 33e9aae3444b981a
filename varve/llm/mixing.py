"""Mixing sources to target weights by Poisson replication.

A source of n rows that should make up a share w of ``total`` rows repeats each
of its rows ``w * total / n`` times on average. The number of copies of a row is
a Poisson number with that mean: the distribution is inverted at a uniform
number that a digest of (seed, key) gives, so the draw needs no order and a
lost task draws the same again. Rows are exploded by their number and shuffled
over the whole table by a digest of (seed, key, copy).

A mean above ``PIECE`` is drawn as a sum of independent numbers with smaller
means, so no mean underflows. NULL is a source, and a key, of its own. Rows that
repeat a key are drawn alike. An empty table, and a source of weight 0, give no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.columns import named
from varve.functions.hashing import digest
from varve.llm.common import fresh, materialise

SEED = 16
# Mean rate up to which one inversion does.
PIECE = 256
# Decimals of a rate: the last bits of a sum over sources depend on its order.
RATE_DECIMALS = 9
# Source table up to which it is broadcast, in bytes; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20
# Shares fall with the size of a source to this power less than one.
TEMPERATURE = 0.5


def tempered_weights(docs: DataFrame, source: str = "source", power: float = TEMPERATURE) -> DataFrame:
    """Rows ``(source, weight)``: the size of each source to a power."""
    sizes = docs.groupBy(named(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("source", F.pow(F.col("n").cast("double"), F.lit(power)).alias("weight"))


def repetition_rates(
    docs: DataFrame, weights: DataFrame, source: str = "source", total: int | None = None
) -> DataFrame:
    """Rows ``(source, rate)`` for the sources of ``docs``; one without a weight gets rate 0.

    ``total`` is the wanted number of rows, by default as many as there are.
    """
    sizes = docs.groupBy(named(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    given = weights.select(F.col("source").alias("of"), F.col("weight").cast("double").alias("weight"))
    both = materialise(
        sizes.join(given, F.col("source").eqNullSafe(F.col("of")), "left")
        .select("source", "n", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    )
    whole = both.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    wanted = float(total if total is not None else whole["n"] or 0)
    share = F.col("weight") / F.lit(whole["w"] or 1.0)
    return both.select("source", F.round(share * wanted / F.col("n"), RATE_DECIMALS).alias("rate"))


def _with_distribution(rates: DataFrame) -> DataFrame:
    """Adds the number of pieces and the distribution function of one piece.

    The sums run 12 standard deviations and 20 past the mean, where what is
    left is below the step of the uniform numbers.
    """
    rates = rates.withColumn("pieces", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int"))
    rates = rates.withColumn("mean", F.col("rate") / F.col("pieces"))
    return rates.withColumn("cdf", F.expr("""
        aggregate(
          sequence(1, cast(ceil(mean + 12 * sqrt(mean) + 20) as int)),
          named_struct('p', exp(-mean), 'c', array(exp(-mean))),
          (s, k) -> named_struct('p', s.p * mean / k, 'c', concat(s.c, array(element_at(s.c, -1) + s.p * mean / k))),
          s -> s.c)
    """)).drop("mean", "rate")


def _uniform(seed: Column, key: Column) -> Column:
    """Double in (0, 1) with 52 random bits."""
    hexed = F.substring(F.md5(F.concat(seed, F.lit(":"), key)), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def replicate(
    docs: DataFrame, rates: DataFrame, key: str = "doc_id", source: str = "source", seed: int = SEED
) -> DataFrame:
    """``docs`` with each row as often as drawn, and ``copy`` (from 0) and ``shuffle_key``.

    Columns of these two names are replaced; all others stay, whatever their names.
    Rows are dealt over partitions by ``shuffle_key`` and sorted by it inside them.
    """
    (of, pieces, cdf, times) = fresh(docs, "of", "pieces", "cdf", "times")
    made = materialise(_with_distribution(rates))
    size = made.agg(F.sum(8 * F.size("cdf") + 64 + F.coalesce(F.octet_length("source"), F.lit(0)))).first()[0] or 0
    side = made.select(F.col("source").alias(of), F.col("pieces").alias(pieces), F.col("cdf").alias(cdf))
    side = F.broadcast(side) if size <= BROADCAST_BYTES else side
    out = docs.join(side, named(source).eqNullSafe(named(of)))
    draw = F.aggregate(
        F.sequence(F.lit(0), named(pieces) - 1),
        F.lit(0),
        lambda n, i: n + F.size(F.filter(
            named(cdf), lambda c: c < _uniform(F.concat(F.lit(f"{seed}/"), i.cast("string")), key_text(named(key)))
        )),
    )
    out = out.withColumn(times, draw).where(named(times) > 0).drop(of, pieces, cdf)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), named(times) - 1))).drop(times)
    out = out.withColumn("shuffle_key", digest(seed, F.concat(key_text(named(key)), F.lit("/"), F.col("copy").cast("string"))))
    return out.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def mix(
    docs: DataFrame, weights: DataFrame | None = None, key: str = "doc_id", source: str = "source",
    total: int | None = None, seed: int = SEED,
) -> DataFrame:
    """Replicate rows so that sources reach their weights (by default tempered ones)."""
    weights = tempered_weights(docs, source) if weights is None else weights
    return replicate(docs, repetition_rates(docs, weights, source, total), key, source, seed)
