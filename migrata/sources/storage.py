"""Questions to the storage a path lives on, through Spark's own file systems (local or remote)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

T, R = TypeVar("T"), TypeVar("R")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` (none if it does not exist)."""
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file (a spec) as one string."""
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder to a path that does not exist yet."""
    fs, p = _fs(spark, path)
    if not fs.rename(p, _fs(spark, to)[1]):
        raise FileExistsError(to)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it exists: of several writers of one path exactly one gets True."""
    fs, p = _fs(spark, path)
    exists_error = ("FileAlreadyExists", "already exists")
    try:
        out = fs.create(p, False)
    except Exception as e:  # noqa: BLE001 - the file system's own exception, through the gateway
        if any(x in str(e) for x in exists_error):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in ``path`` (none if it does not exist)."""
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isFile()) if fs.exists(p) else []


def written(df: DataFrame, name: str) -> str:
    """``df`` written once below the shared checkpoint folder; its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: later uses scan, prune and filter it."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def side_by_side(job: Callable[[T], R], items: Sequence[T], workers: int = 8) -> list[R]:
    """``job`` of every item, several Spark jobs at a time, so that small ones fill the gaps of large ones."""
    if not items:
        return []
    run = inheritable_thread_target(SparkSession.active())(job)
    with ThreadPoolExecutor(min(workers, len(items))) as threads:
        return list(threads.map(run, items))


def stored_set(tables: Mapping[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """Every table ``stored``, side by side."""
    return dict(zip(tables, side_by_side(lambda t: stored(tables[t], f"{name}-{t}"), list(tables))))
