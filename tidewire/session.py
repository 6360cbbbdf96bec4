"""Session helpers: the shared folder, tables written to cut lineage, and joins that are safe from hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to this many rows, after they were counted.
BROADCAST_ROWS = 100_000
#: Rows of one key that a task may join.
KEY_ROWS = 1_000_000

_paths: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a temporary one of our own only where that is unset and all run in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/tidewire/{name}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_remove)
    _paths.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidewire_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete written tables that no plan to come reads."""
    for df in tables:
        path = getattr(df, "_tidewire_path", None)
        if path is not None:
            _delete(df.sparkSession, path)
            _paths.remove((df.sparkSession, path))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove() -> None:
    for spark, path in _paths:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint if ``df`` has at most BROADCAST_ROWS rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def lookup(rows: DataFrame, found: DataFrame, key: str, count: str, total: int, share: int = 1000) -> DataFrame:
    """Left join of ``rows`` with ``found`` (one row a key; ``count``: the key's number of rows), safe from hot keys.

    At most ``share`` keys can hold 1/share of all ``total`` rows each: those are broadcast, and only keys below that are
    shuffled. No key of a table of KEY_ROWS rows or fewer is hot.
    """
    if total <= KEY_ROWS:
        return rows.join(found, key, "left")
    least = max(2.0, total / share)
    hot = F.broadcast(found.filter(F.col(count) >= least))
    cold = found.filter(F.col(count) < least)
    with_hot = rows.join(hot, key, "inner")
    rest = rows.join(hot.select(key), key, "left_anti").join(cold, key, "left")
    return with_hot.select(*rest.columns).unionByName(rest)
