"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows ``(a, b)``: each node of ``edges`` (a, b) and the smallest node of its component.

    A large star ties the larger neighbours of a node to its smallest one, a
    small star the smaller neighbours; the rounds, logarithmic in number, end
    when the edges stay as they are. Each round is a written table, and so are
    the smallest neighbours: the join with them then has shuffles of its own,
    and Spark can split the edges of a node that has a great part of them. The
    smallest node itself has no row.
    """
    now, before = _sorted_out(edges.select("a", "b")), None
    while True:
        now = materialise(_small_star(materialise(_large_star(now))))
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return now
        before = state


def _sorted_out(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.min("b").alias("lo")).select("a", F.least("a", "lo").alias("lo")))
    # Pairs of a larger neighbour and the smallest node that the middle one knows.
    return _sorted_out(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("lo").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("lo")))
    others = edges.join(least, "a").select(F.col("b").alias("a"), F.col("lo").alias("b"))
    return _sorted_out(others.unionByName(least.select("a", F.col("lo").alias("b"))))
