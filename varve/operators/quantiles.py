"""Exact, linearly interpolated quantiles by radix selection.

The bits of a double, read as a whole number, have the order of the values once
those of negative numbers are flipped. A pass counts values by a prefix of this
key, 16 bits longer from pass to pass, and follows only the prefixes that hold a
wanted rank. Four passes reach the whole key; a prefix whose values are all
equal is settled before, so two passes are usual. All passes are aggregations
with map-side combine, whose size does not depend on the number of rows behind
a value, and hardly on the number of probabilities: ranks are looked up in the
counts. Nothing but the state between passes, a row per group, column and rank,
leaves them: it is a local table up to ``limit`` rows and a written one beyond.

The rows are read once per pass; where they come from a costly step, such as a
model, write them before.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.columns import finite_or_null, named
from varve.session import materialise

# Rows of the state between passes that the driver may hold.
LIMIT = 10_000
# Bits that a pass adds to the prefixes.
DIGIT = 16
LARGEST = (1 << 63) - 1
# Ranges of values per column that a pass is told to look into.
RANGES = 16


def _bits(value: Column) -> Column:
    """The bits of a double as a long, by a Java method; a column of its own."""
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("long")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = (), limit: int = LIMIT,
    members: DataFrame | None = None,
) -> DataFrame:
    """Rows ``(*by, column, p, value)``; NULL and NaN are ignored.

    The result has one row per group, column and probability, but none for a
    group whose column has no value.

    ``members``, a small table ``(label, member_of)``, asks for sets of rows that
    may overlap, such as all folds but one: ``by`` is then one column of labels,
    and a group is a set, named in the column ``member_of``. Rows are read once
    per pass for all sets, as the counts of labels are added up.
    """
    columns, probabilities, by = list(columns), [float(p) for p in probabilities], list(by)
    if members is not None and len(by) != 1:
        raise ValueError("sets of labels need one column of labels")
    groups = [f"g{i}" for i in range(len(by))]
    values = [f"v{c}" for c in range(len(columns))]
    rows = df.select(
        *[named(b).alias(g) for b, g in zip(by, groups)],
        *[finite_or_null(named(c)).alias(v) for c, v in zip(columns, values)],
    )
    state = _kept(_ranked(_counts(_long(rows, groups, {}), groups, DIGIT, members), groups, probabilities), limit)
    for bits in range(2 * DIGIT, 65, DIGIT):
        still = state.where("lo < hi")
        ranges = _ranges(still, limit)
        if ranges == {}:
            break
        # Which set a row counts for shows only in the counts, so rows of all groups follow an open prefix.
        open_ = still.select("c", F.col("open").alias("prefix_before")).distinct()
        near = _long(rows, groups, ranges).withColumn("prefix_before", F.shiftright("key", 64 - bits + DIGIT))
        counts = _counts(near.join(open_, ["c", "prefix_before"]), groups, bits, members)
        state = _kept(state.where("not (lo < hi)").unionByName(_followed(still, counts, groups)), limit)
    value = lambda side: F.max(F.when(F.col("side") == side, F.col("lo")))
    found = state.groupBy(*groups, "c", "k", "weight").agg(value(0).alias("a"), value(1).alias("b"))
    names, wanted = F.array(*map(F.lit, columns)), F.array(*map(F.lit, probabilities))
    return found.select(
        *[F.col(g).alias("member_of" if members is not None else b) for g, b in zip(groups, by)],
        F.get(names, F.col("c")).alias("column"), F.get(wanted, F.col("k")).alias("p"),
        F.expr("case when a = b then a else a + (b - a) * weight end").alias("value"),
    )


def quantile_table(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], limit: int = LIMIT
) -> dict[str, list[float]]:
    """Whole-table quantiles as driver values: a few numbers per column."""
    found = exact_quantiles(df, columns, probabilities, limit=limit).collect()
    by_key = {(r["column"], r["p"]): r["value"] for r in found}
    return {c: [by_key.get((c, float(p))) for p in probabilities] for c in columns}


def _long(rows: DataFrame, groups: list[str], ranges: dict[int, list[tuple[float, float]]] | None) -> DataFrame:
    """A row (group, c, v, key) per value; where ranges are known, only for values inside those of its column."""
    names = [n for n in rows.columns if n not in groups]
    # Adding 0 makes a negative zero a positive one.
    cells = [F.struct(F.lit(c).alias("c"), (F.col(n) + F.lit(0.0)).alias("v")) for c, n in enumerate(names)]
    long = rows.select(*groups, F.inline(F.array(*cells))).where(F.col("v").isNotNull())
    if ranges:
        inside = lambda spans: functools.reduce(lambda a, b: a | b, (F.col("v").between(*s) for s in spans))
        long = long.where(functools.reduce(
            lambda a, b: a | b, ((F.col("c") == c) & inside(spans) for c, spans in sorted(ranges.items()))
        ))
    # Flipped, the keys of negative values have their order, too.
    bits = long.withColumn("bits", _bits(F.col("v")))
    key = F.when(F.col("bits") < 0, F.col("bits").bitwiseXOR(F.lit(LARGEST))).otherwise(F.col("bits"))
    return bits.select(*groups, "c", "v", key.alias("key"))


def _ranges(still: DataFrame, limit: int) -> dict[int, list[tuple[float, float]]] | None:
    """Value ranges that enclose the open prefixes of each column, a few per column.

    They only spare the passes most keys; which rows count is decided on the
    prefix. None if the state is too large to look at here.
    """
    rows = still.select("c", "lo", "hi").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    found = {}
    for c in {r["c"] for r in rows}:
        spans = sorted((r["lo"], r["hi"]) for r in rows if r["c"] == c)
        step = -(-len(spans) // RANGES)
        found[c] = [(spans[i][0], max(hi for _, hi in spans[i:i + step])) for i in range(0, len(spans), step)]
    return found


def _counts(long: DataFrame, groups: list[str], bits: int, members: DataFrame | None) -> DataFrame:
    """Rows, smallest and largest value per group, column and prefix of so many bits."""
    counts = long.groupBy(*groups, "c", F.shiftright("key", 64 - bits).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    if members is None:
        return counts
    of = members.select(F.col("label").alias("of_label"), "member_of")
    return counts.join(F.broadcast(of), F.col("g0").eqNullSafe(F.col("of_label"))).groupBy(  # labels times sets
        F.col("member_of").alias("g0"), "c", "prefix"
    ).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _ranked(counts: DataFrame, groups: list[str], probabilities: list[float]) -> DataFrame:
    """The prefix of each wanted rank: a row per group, column, probability and side."""
    whole = Window.partitionBy(*groups, "c")
    # At most 65,536 prefixes per group and column.
    counts = counts.withColumns({
        "total": F.sum("n").over(whole), "before": F.sum("n").over(whole.orderBy("prefix")) - F.col("n")
    })
    cells = []
    for k, p in enumerate(probabilities):
        place = (F.col("total") - 1) * F.lit(p)
        for side, rank in enumerate((F.floor(place), F.ceil(place))):
            cells.append(F.struct(
                F.lit(k).alias("k"), F.lit(side).alias("side"), (place - F.floor(place)).alias("weight"), rank.alias("rank")
            ))
    here = counts.select(*groups, "c", "prefix", "before", "n", "lo", "hi", F.inline(F.array(*cells)))
    return here.where("rank >= before and rank < before + n").select(
        *groups, "c", "k", "side", "weight", F.col("prefix").alias("open"), F.expr("rank - before").alias("rank"), "lo", "hi"
    )


def _followed(state: DataFrame, counts: DataFrame, groups: list[str]) -> DataFrame:
    """Ranks inside a prefix, looked up in the counts of its next digit."""
    inside = Window.partitionBy(*groups, "c", "parent").orderBy("prefix")
    counts = counts.withColumn("parent", F.shiftright("prefix", DIGIT)).withColumn(
        "before", F.sum("n").over(inside) - F.col("n")
    ).select(*[F.col(g).alias(f"of_{g}") for g in groups], F.col("c").alias("of_c"), "prefix", "parent", "before", "n",
             F.col("lo").alias("least"), F.col("hi").alias("most"))
    on = [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in groups]
    on += [F.col("c") == F.col("of_c"), F.col("open") == F.col("parent"), F.expr("rank >= before and rank < before + n")]
    return state.join(counts, on).select(
        *groups, "c", "k", "side", "weight", F.col("prefix").alias("open"), F.expr("rank - before").alias("rank"),
        F.col("least").alias("lo"), F.col("most").alias("hi"),
    )


def _kept(state: DataFrame, limit: int) -> DataFrame:
    """The state as a local table, or a written one if it is large."""
    rows = state.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return materialise(state)
    return state.sparkSession.createDataFrame(rows, state.schema)
