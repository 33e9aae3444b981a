"""Allow and block rules for addresses, matched by hashed expressions.

A rule is a host and the beginning of a path. An address is expanded into its
host suffixes times its path beginnings; only the shapes that some rule has are
made (numbers of labels, lengths of paths), so the expansion is bounded by the
rules and exact for any address. Expressions meet the rules in an equi-join on
the first 32 bits of their SHA-256; the full digest is confirmed afterwards.
The longest rule wins; of equally long ones that with the longer host, then
block over allow.

Addresses are judged once per distinct (end of host, beginning of path) that
can matter, and the verdicts are joined back, so a host that fills a third of
the table is expanded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.columns import named
from varve.llm.common import ascii_lower, fresh, materialise

# Hex digits of a digest that take part in the join: 32 bits.
SHORT = 8
# Verdict for an address that no rule fits.
DEFAULT = "allow"

# Host: from the first :// to the next / ? # or the end. Path: from there to the next ? or #.
_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host; empty for NULL and for text without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _ADDRESS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rows ``(short, digest, rule, verdict, rank)``, one per distinct rule.

    ``rules`` has host, path and verdict. Rules without a host fit nothing and
    go; a NULL path is empty; a rule given twice with both verdicts blocks.
    """
    host, path = ascii_lower(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    made = rules.where("host <> ''").select(
        host.alias("host"), path.alias("path"), F.concat(host, path).alias("rule"), (F.col("verdict") == "block").alias("block")
    )
    made = made.groupBy("host", "path", "rule").agg(F.max("block").alias("block"))
    return made.select(
        "host", "path", "rule", F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"),
        F.when(F.col("block"), "block").otherwise("allow").alias("verdict"),
        F.struct(F.length("rule").alias("length"), F.length("host").alias("host_length"), "block").alias("rank"),
    ).withColumn("short", F.substring("digest", 1, SHORT))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule (NULL where none fits) and verdict.

    A column of ``pages`` with one of these names is replaced. NULL, empty and
    malformed addresses have an empty host, which no rule fits.
    """
    rules = prepare_rules(rules)
    # Two short lists of numbers, bounded by the labels of a host and the length of a rule's path.
    shapes = rules.agg(
        F.array_sort(F.collect_set(F.size(F.split("host", "[.]")))).alias("labels"),
        F.array_sort(F.collect_set(F.length("path"))).alias("lengths"),
    ).first()
    labels, lengths = list(shapes["labels"]) or [1], list(shapes["lengths"]) or [0]

    made = pages.withColumns({"host": host_of(named(url)), "path": path_of(named(url))})
    end, start = fresh(made, "end_of_host", "start_of_path")
    made = made.withColumns({
        end: F.substring_index("host", ".", -max(labels)), start: F.substring("path", 1, max(lengths))
    })
    suffixes = F.array_distinct(F.array(*[F.substring_index("end_of_host", ".", -n) for n in labels]))
    beginnings = F.array_distinct(F.array(*[F.substring("start_of_path", 1, n) for n in lengths]))
    keys = made.select(named(end).alias("end_of_host"), named(start).alias("start_of_path")).distinct()
    expressions = (
        keys.withColumn("suffix", F.explode(suffixes))
        .withColumn("beginning", F.explode(beginnings))
        .withColumn("found", F.sha2(F.concat_ws("\n", "suffix", "beginning"), 256))
        .withColumn("short", F.substring("found", 1, SHORT))
    )
    best = (
        expressions.join(rules.select("short", "digest", "rule", "verdict", "rank"), "short")
        .where(F.col("found") == F.col("digest"))
        .groupBy("end_of_host", "start_of_path")
        .agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
        .select(F.col("end_of_host").alias("k1"), F.col("start_of_path").alias("k2"), "best.rule", "best.verdict")
    )
    k1, k2, rule, verdict = fresh(made, "k1", "k2", "found_rule", "found_verdict")
    best = best.toDF(k1, k2, rule, verdict)
    # As a written table the verdicts are either small enough to be broadcast, or leave the join its
    # own shuffles, whose large partitions Spark can split.
    best = materialise(best)
    out = made.join(best, (named(end) == named(k1)) & (named(start) == named(k2)), "left")
    return out.withColumns({
        "rule": named(rule), "verdict": F.coalesce(named(verdict), F.lit(default))
    }).drop(end, start, k1, k2, rule, verdict)
