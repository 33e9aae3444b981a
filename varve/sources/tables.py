"""Table scans with a declared schema, and table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.functions.columns import finite_or_null, named
from varve.sources.versions import resolve


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, kind: str | None = None
) -> DataFrame:
    """Scan a parquet, ORC or CSV table. Text has no types, so CSV needs a schema.

    A path through a published folder leads to its current version.
    """
    path = resolve(spark, path)
    kind = kind or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if kind == "csv":
        if schema is None:
            raise ValueError("a CSV table needs a declared schema")
        return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(kind).load(path)


def numeric_schema(numbers: Sequence[str], texts: Sequence[str] = ()) -> T.StructType:
    """Schema of a measurement sheet: text columns first, then numbers."""
    return T.StructType([
        *[T.StructField(c, T.StringType()) for c in texts],
        *[T.StructField(c, T.DoubleType()) for c in numbers],
    ])


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, missing values, smallest and largest value per column, in one pass."""
    values = {c: finite_or_null(named(c)) for c in columns}
    wide = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(v).alias(f"c{i}") for i, v in enumerate(values.values())],
        *[F.min(v).alias(f"lo{i}") for i, v in enumerate(values.values())],
        *[F.max(v).alias(f"hi{i}") for i, v in enumerate(values.values())],
    )
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c{i}")).alias("n_missing"),
            F.col(f"lo{i}").alias("lowest"), F.col(f"hi{i}").alias("highest"),
        )
        for i, c in enumerate(columns)
    ])
    return wide.select(F.inline(cells))


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """One parquet table per name below ``folder``."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")
