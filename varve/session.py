"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import shutil
import tempfile
import threading
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPING, _SHARING = threading.Lock(), threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session, whose one machine holds all executors, falls back to
    a fresh temporary folder; a cluster session must name the folder.
    """
    with _SHARING:
        return _shared_dir(spark)


def _shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="varve-")
    spark.conf.set("spark.checkpoint.dir", folder)
    # Long boosting runs cut their lineage here, too.
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application; they may not have it on their path."""
    context = spark.sparkContext
    with _SHIPPING:  # fits run side by side, and Spark takes a file of a name once
        if getattr(context, "_varve_shipped", False):
            return
        package = Path(__file__).resolve().parent
        if package.is_dir():  # else it came as an archive already
            archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='varve-')}/varve", "zip", package.parent, package.name)
            context.addPyFile(archive)
        context._varve_shipped = True


def new_path(spark: SparkSession, kind: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    This ends the lineage: later jobs read files, so the loss of an executor
    costs a re-read and not a re-computation. With ``partition_by`` a filter on
    that column reads only the folders it needs; rows are dealt out by it first,
    in partitions of even size, so a folder has few files.
    """
    spark = df.sparkSession
    path = new_path(spark, "table")
    writer = df.hint("rebalance", partition_by).write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
