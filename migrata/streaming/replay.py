"""Migration steps on streaming DataFrames.

Row-local steps (rename, retype, enum remap, unmapped, flatten, computed, split drop) are
projections and run unchanged on a stream.  Denormalize becomes a stream-static left join
against the original target table.  Partition becomes a routed stream written with
``partitionBy`` so each micro-batch lands in its sub-table folders in one pass.

Extract runs per micro-batch (``extract_stream``): parent and child rows go to folders of that batch, and an item's id
is made of its parent's id and its position, so it needs no count over the table.

Dense ids (split, extract as the batch operator numbers it), first-child merge and scoring need the whole table and
stay batch-only.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.transforms import apply_row_step, denormalize_table, routed_union
from ..session import checkpoint_dir
from ..sources.storage import exists
from ..spec import (Computed, Denormalize, EnumRemap, FlattenNested, Merge, Partition, Rename, Retype, SpecError, Split,
                    Step, Unmapped)

BATCH = "__mg_batch"
ROW_LOCAL = (Rename, Retype, EnumRemap, Unmapped, FlattenNested, Computed)


def replay_stream(stream: DataFrame, entity: str, log: Sequence[Step],
                  static: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Apply the log's steps for ``entity`` to a streaming frame (partition excluded).

    ``static`` holds the original tables that denormalize reads.
    """
    static = dict(static or {})
    null_present: set[str] = set()
    for s in log:
        if isinstance(s, ROW_LOCAL) and s.entity == entity:
            stream = apply_row_step(stream, s, entity, null_present=null_present)
            if isinstance(s, Computed) and s.operation in ("multiply", "sum_fields"):
                null_present.add(s.dest_field)
        elif isinstance(s, Denormalize) and s.entity == entity:
            # the ref column of a stream row still holds the original value (renames keep values)
            stream = denormalize_table(stream, stream, s.via_field, s.via_field, static.get(s.from_entity),
                                       s.inlined)
            null_present.update(d for _, d in s.inlined)
        elif entity in _entities_of(s) and not isinstance(s, Partition):
            raise SpecError(f"{s.type} needs the whole table and cannot run on a stream")
    return stream


def _entities_of(s: Step) -> set[str]:
    if isinstance(s, Split):
        return {s.from_}
    if isinstance(s, Merge):
        return {s.parent, s.child}
    return {getattr(s, "entity", None)} - {None}


def route_stream(stream: DataFrame, step: Partition) -> DataFrame:
    """Routable rows with their sub-table in ``__mg_sub`` (the discriminator dropped)."""
    return routed_union(stream, step.on_field, step.as_dict)


def run_to_table(spark: SparkSession, stream: DataFrame, path: str, partition_by: Sequence[str] = (),
                 name: str = "migrata") -> DataFrame:
    """Run a stream to completion (``availableNow``) into Parquet at ``path``; return it as a batch frame.

    The checkpoint lives under the session's shared checkpoint folder, so a restarted
    query resumes where it stopped instead of re-reading its input.
    """
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", ckpt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path)



ITEM_BITS = 20


def item_id(parent: Column, position: Column) -> Column:
    """The id of an item: its parent's id above its position (below 2^20; more items in one array are an error)."""
    fits = (position < (1 << ITEM_BITS)) & (F.abs(parent) < (1 << (63 - ITEM_BITS)))
    made = F.shiftleft(parent.cast("bigint"), ITEM_BITS).bitwiseOR(position.cast("bigint"))
    return F.when(fits, made).otherwise(F.raise_error(F.lit("parent id or position too large for an item id")).cast("bigint"))


def extract_batch(batch: DataFrame, fld: str, link_field: str) -> tuple[DataFrame, DataFrame]:
    """T8 on one batch of parents: (parents without the array, children ``id, link, item fields``)."""
    items = batch.select(F.col("id").alias(link_field), F.posexplode(F.col(f"`{fld}`")).alias("__mg_pos", "__mg_item"))
    children = items.select(item_id(F.col(link_field), F.col("__mg_pos")).alias("id"), link_field, "__mg_item.*")
    return batch.drop(fld), children


def extract_stream(spark: SparkSession, stream: DataFrame, fld: str, link_field: str, path: str, parent: str, child: str,
                   name: str = "extract") -> dict[str, DataFrame]:
    """Extract on a stream, run until its input is used up; the two tables as batch frames.

    A micro-batch overwrites the folders ``<table>/__mg_batch=<number>`` of its own number, so one that is run
    again after a failure leaves every row once.
    """
    def write(batch: DataFrame, number: int) -> None:
        parents, children = extract_batch(batch, fld, link_field)
        for table, rows in ((parent, parents), (child, children)):
            rows.write.mode("overwrite").parquet(f"{path}/{table}/{BATCH}={number}")

    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return {t: spark.read.parquet(f"{path}/{t}").drop(BATCH) for t in (parent, child) if exists(spark, f"{path}/{t}")}
