"""Written intermediate tables and the few file operations Spark has no call for."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
LOCAL_SCHEMES = ("", "file")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names, else a folder in the session's warehouse.

    A warehouse on a local disk serves only a session that runs in one process; on a cluster the executors
    would each write to their own disk, so a folder must be named there.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    scheme = _path(spark, warehouse).toUri().getScheme() or ""
    if scheme in LOCAL_SCHEMES and not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share; {warehouse} is local")
    return f"{warehouse}/_intermediate"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read from there, for results that are evaluated later.

    The folder outlives this call; it goes when the cluster clears its checkpoint folder.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder for a written intermediate table."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(_path(spark, path))


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder was last changed."""
    return _file_system(spark, path).getFileStatus(_path(spark, path)).getModificationTime()


def drop_path(spark: SparkSession, path: str) -> None:
    _file_system(spark, path).delete(_path(spark, path), True)


def replace_folder(spark: SparkSession, new: str, path: str, aside: str) -> None:
    """Put the folder ``new`` where ``path`` is, by renaming; until it is there the old one is kept as ``aside``."""
    files = _file_system(spark, path)
    target, kept = _path(spark, path), _path(spark, aside)
    if files.exists(target):
        files.delete(kept, True)
        files.mkdirs(kept.getParent())
        if not files.rename(target, kept):
            raise OSError(f"cannot move {path} to {aside}")
    else:
        files.mkdirs(target.getParent())
    if not files.rename(_path(spark, new), target):
        raise OSError(f"cannot move {new} to {path}")
    files.delete(kept, True)


def restore_folder(spark: SparkSession, path: str, aside: str) -> None:
    """Bring back what a replacement that was broken off had put aside; a replacement that ended wins."""
    files = _file_system(spark, path)
    if not files.exists(_path(spark, aside)):
        return
    if files.exists(_path(spark, path)):
        files.delete(_path(spark, aside), True)
    elif not files.rename(_path(spark, aside), _path(spark, path)):
        raise OSError(f"cannot move {aside} to {path}")


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a partition column, from the directory listing; none where there is no table."""
    files = _file_system(spark, path)
    if not files.exists(_path(spark, path)):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(_path(spark, path))]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))


@contextmanager
def materialized(df: DataFrame, name: str = "table") -> Iterator[DataFrame]:
    """``df`` written once to the shared folder and read from there; gone when the block ends.

    Cuts the lineage like a checkpoint, survives lost executors, and stays columnar.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        drop_path(spark, path)
