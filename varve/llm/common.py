"""What several corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve import session
from varve.functions.columns import named

# The letters that contracts on equal texts fold, and no others.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# While a table is written: Spark removes the shuffle files of the query at its end, and hands texts
# to Python in small batches, of which JVM and Python each hold one or two per core.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216b",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """A written table in the shared folder; the shuffles behind it are given back at once."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        conf.set(k, v)
    try:
        return session.materialise(df)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and leave every other character alone."""
    return F.translate(text, UPPER, UPPER.lower())


def whole_text(text: Column) -> Column:
    """NULL counts as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where ``df`` has such a column (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def pick(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [named(c) for c in columns]
