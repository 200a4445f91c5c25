"""Helpers shared by the operators: quoted columns, shared-storage tables, Arrow batch mapping."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from migrata.session import checkpoint_dir

# Arrow batches handed to Python: rows per batch, and bytes of text worked on at a time
BATCH_ROWS = 1000
SLICE_BYTES = 8 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def col(name: str) -> Column:
    """A column by its exact name (dots and blanks are part of the name)."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name = "_" + name
    return name


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name on the storage that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` written once to shared storage and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, tag)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of ``stored`` tables nothing reads any more, and release their shuffle files."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of results that nobody refers to any more (it does so after a collection on the driver)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Before Python runs in tasks: bounded Arrow batches, unless the session sets its own, and the folder
    this package was imported from on the workers' path (a cluster that ships it otherwise is not harmed)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), ROOT]))
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)),):
        if spark.conf.get(key, "10000") == "10000":
            spark.conf.set(key, value)


def _slices(batch: pa.RecordBatch, sized: Sequence[int], limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of at most ``limit`` bytes in the ``sized`` columns (one row at least)."""
    if not sized or batch.num_rows == 0:
        yield batch
        return
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for i in sized:
        sizes += np.asarray(pc.fill_null(pc.binary_length(batch.column(i)), 0), dtype=np.int64)
    start, used = 0, 0
    for i, n in enumerate(sizes):
        if i > start and used + n > limit:
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += int(n)
    yield batch.slice(start)


def map_texts(
    df: DataFrame,
    keep: Sequence[Column],
    inputs: Sequence[Column],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., Sequence[Any]]],
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row out per row in: the ``keep`` columns, then ``fields``, in Arrow batches.

    ``make()`` runs once per task and returns ``f(list, ...) -> one list per field``; ``f`` gets the
    ``inputs`` as Python lists of at most ``slice_bytes`` of text (one row at least).  A null input is
    ``None``.
    """
    small_batches(df.sparkSession)
    narrow = df.select(*keep, *inputs)
    n_keep = len(keep)
    kept = narrow.schema.fields[:n_keep]
    final = [f.name for f in (*kept, *fields)]
    # plain names on the way: a column may be called anything, and names may clash
    names = [f"c{i}" for i in range(len(final))]
    schema = T.StructType([T.StructField(c, f.dataType, f.nullable) for c, f in zip(names, (*kept, *fields))])
    types = [to_arrow_schema(T.StructType([f])).field(0).type for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            text_like = [i for i in range(n_keep, batch.num_columns)
                         if pa.types.is_string(batch.column(i).type) or pa.types.is_binary(batch.column(i).type)]
            for part in _slices(batch, text_like, slice_bytes):
                if work is None:
                    work = make()
                out = work(*[part.column(i).to_pylist() for i in range(n_keep, part.num_columns)])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(out, types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], *arrays], names=names)

    return narrow.toDF(*[f"c{i}" for i in range(len(narrow.columns))]).mapInArrow(run, schema).toDF(*final)
