"""Boilerplate lines: those that many distinct sites carry.

Each line is trimmed and hashed to 128 bits. Per hash a HyperLogLog sketch of
its sites is built in every task, and the sketches merge by aggregation. Lines
whose estimate lies clearly above the threshold are boilerplate and those
clearly below are not; lines whose estimate is near it get an exact distinct
count. Boilerplate lines are then taken out of all documents.

The lines to take out are gathered per distinct text, which bounds them by the
lines of that text, whatever keys repeat, and come back to the rows by a join on
128 bits of the text, which Spark can split where a third of the rows are alike.

Empty lines are layout and stay. A NULL site is no site; a NULL text counts as
empty. Sketches have a fixed size and combine before the shuffle, so a line
that a third of all rows carry is one row per task. A line that exactly
``min_sites`` sites carry is boilerplate. Rows that repeat are all treated
alike, texts of any length are read whole, and an empty table gives an empty
table. Columns named ``n_lines`` and ``n_removed`` are replaced; other columns
stay as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.columns import named
from varve.llm.common import fresh, materialise, whole_text

# Distinct sites from which on a line is boilerplate.
MIN_SITES = 10
# log2 of the registers of a sketch, and how many standard errors count as near.
LOG_REGISTERS = 12
NEAR_ERRORS = 5.0
# What is trimmed off a line before it is compared.
BLANK = " \t\r"


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def _hash(line: Column) -> Column:
    """128 bits as a struct of two longs."""
    key = _trimmed(line)
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def _lines(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    lines = docs.select(*more, F.explode(F.split(whole_text(named(text)), "\n")).alias("line"))
    return lines.where(_trimmed(F.col("line")) != "").withColumn("hash", _hash(F.col("line"))).drop("line")


def boilerplate_lines(
    docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
    log_registers: int = LOG_REGISTERS,
) -> DataFrame:
    """Hashes ``(a, b)`` of the lines that at least ``min_sites`` distinct sites carry."""
    # Sketches pass over empty strings, so the site's hash goes in; NULL stays NULL.
    where = F.when(named(site).isNotNull(), F.xxhash64(named(site))).alias("site")
    lines = _lines(docs, text, where).select("hash.a", "hash.b", "site")
    error = 1.04 / math.sqrt(2**log_registers)
    band = max(1.0, NEAR_ERRORS * error * min_sites)
    spread = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", log_registers).alias("sketch"))
    spread = spread.select("a", "b", F.hll_sketch_estimate("sketch").alias("sites"))
    high = materialise(spread.where(F.col("sites") >= min_sites - band))
    sure = high.where(F.col("sites") > min_sites + band).select("a", "b")
    near = high.where(F.col("sites") <= min_sites + band).select("a", "b")
    pairs = lines.where("site is not null").join(near, ["a", "b"], "left_semi").distinct()
    exact = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(exact.select("a", "b"))


def drop_boilerplate(
    docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
    log_registers: int = LOG_REGISTERS,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and n_lines and n_removed."""
    bad = materialise(boilerplate_lines(docs, text, site, min_sites, log_registers))
    whole = whole_text(named(text))
    marks = [F.xxhash64(whole), F.xxhash64(F.lit(1), whole)]
    hits = _lines(docs, text, marks[0].alias("t"), marks[1].alias("u")).select("t", "u", "hash.a", "hash.b")
    hits = hits.join(bad, ["a", "b"], "left_semi")
    t, u, out_hashes, kept, lines, mark_t, mark_u = fresh(docs, "t", "u", "bad_hashes", "kept_lines", "all_lines", "mark_t", "mark_u")
    # As a written table this leaves the join its own shuffles, whose large partitions Spark can split.
    found = materialise(hits.groupBy("t", "u").agg(F.collect_set(F.struct("a", "b")).alias("bad_hashes")))
    found = found.select(F.col("t").alias(t), F.col("u").alias(u), F.col("bad_hashes").alias(out_hashes))
    out = docs.withColumns({mark_t: marks[0], mark_u: marks[1]})
    out = out.join(found, (named(mark_t) == named(t)) & (named(mark_u) == named(u)), "left").drop(t, u, mark_t, mark_u)
    out = out.withColumn(lines, F.split(whole, "\n"))
    stays = F.when(named(out_hashes).isNull(), named(lines)).otherwise(
        F.filter(named(lines), lambda x: (_trimmed(x) == "") | ~F.array_contains(named(out_hashes), _hash(x)))
    )
    out = out.withColumn(kept, stays).withColumns({
        text: F.array_join(named(kept), "\n"),
        "n_lines": F.size(named(lines)).cast("long"),
        "n_removed": (F.size(named(lines)) - F.size(named(kept))).cast("long"),
    })
    return out.drop(out_hashes, kept, lines)
