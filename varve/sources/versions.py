"""Folders whose content changes as a whole.

A writer fills a version of its own below the folder, and publishes it last: a
marker file, whose name holds a number and the version, is created in one step.
Readers go by the marker with the highest number, so they see the last whole
set, whatever a writer has begun, left half-way, or writes at the moment. Two
writers cannot mix; the later marker wins (of one number, by its version).
Nothing is replaced or deleted on the way; ``drop_versions`` does that when no
reader needs the old sets any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

MARKERS = "_published"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def _markers(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """Number and version of each published set, oldest first."""
    files, at = _file_system(spark, f"{folder}/{MARKERS}")
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted((int(n[:12]), n[13:]) for n in names if n[:12].isdigit())


def begin(folder: str) -> str:
    """Path of a version that nothing has used yet; readers do not see it."""
    return f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"


def publish(spark: SparkSession, version: str) -> None:
    """Make a version of ``begin``, whole by now, the one that readers see."""
    folder, name = version.rsplit("/", 1)
    if not exists(spark, version):
        raise FileNotFoundError(f"nothing was written to {version}")
    number = max((n for n, _ in _markers(spark, folder)), default=0) + 1
    files, at = _file_system(spark, f"{folder}/{MARKERS}/{number:012d}-{name}")
    if not files.createNewFile(at):
        raise FileExistsError(f"{version} is published already")


def resolve(spark: SparkSession, path: str) -> str:
    """``path`` with each published folder in it replaced by its current version.

    A path that exists, or that leads through no published folder, stays as it is.
    """
    path = path.rstrip("/") or path
    found = _markers(spark, path)
    if found:
        return resolve(spark, f"{path}/{found[-1][1]}")
    parent, _, name = path.rpartition("/")
    if not parent or parent.endswith((":", ":/")) or exists(spark, path):
        return path
    above = resolve(spark, parent)
    return path if above == parent else resolve(spark, f"{above}/{name}")


def drop_versions(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Delete published versions but the last ``keep``, markers first; return how many went.

    Versions that were never published stay, as their writers may be at work.
    """
    if keep < 1:
        raise ValueError("keep must be at least 1")
    gone = _markers(spark, folder)[:-keep]
    for number, name in gone:
        for path in (f"{folder}/{MARKERS}/{number:012d}-{name}", f"{folder}/{name}"):
            files, at = _file_system(spark, path)
            files.delete(at, True)
    return len(gone)
