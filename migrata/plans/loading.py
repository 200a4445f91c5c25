"""Loading a table set in ref order (C4): concurrent jobs per wave, each wave gated, published as a whole.

Tables go to a staging folder, wave by wave (``constraints.load_waves``: targets before those that refer to them).  The tables
of a wave are written by concurrent jobs, each in a scheduler pool of its own.  After a wave every ref of its tables is checked
against the staged targets (C2); a wave with orphans ends the load, its staging folder is deleted and nothing is
published.  When all waves have passed, the staging folder is renamed to the target, one step on file systems that rename
folders; the target must not exist yet.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Mapping

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from ..sources.storage import delete, exists, rename
from ..session import scratch_path
from ..spec import Schema
from .constraints import fk_orphans, load_waves
from .verify import union_all

GATE = "wave int, table_name string, n_rows bigint, ref string, null_refs bigint, orphan_rows bigint"


class LoadError(RuntimeError):
    """A wave with refs to rows that are not there; ``gate`` holds the rows of its check."""

    def __init__(self, wave: int, gate: list):
        super().__init__(f"wave {wave}: " + ", ".join(f"{r.orphan_rows} orphans in {r.ref}" for r in gate if r.orphan_rows))
        self.gate = gate


def _gate(staged: Mapping[str, DataFrame], schema: Schema, wave: int, names: list[str]) -> list:
    """One row per table and ref of a wave; a table without refs has one row with a null ref."""
    parts = []
    for n in names:
        spark = staged[n].sparkSession
        refs = [(f, t) for f, t in schema.refs(n) if t in staged and f in staged[n].columns]
        for f, t in refs:
            o = fk_orphans(staged[n], f, staged[t], "id", f"{n}.{f}")
            parts.append(o.selectExpr(f"{wave} AS wave", f"'{n}' AS table_name", "n_rows", "ref", "null_refs", "orphan_rows"))
        if not refs:
            parts.append(staged[n].selectExpr("count(*) AS n_rows").selectExpr(
                f"{wave} AS wave", f"'{n}' AS table_name", "n_rows", "CAST(null AS STRING) AS ref", "0L AS null_refs", "0L AS orphan_rows"))
    return union_all(spark, parts, GATE).collect()


def load_in_waves(tables: Mapping[str, DataFrame], schema: Schema, target: str, workers: int = 4) -> DataFrame:
    """Load ``tables`` to ``target``; the gate rows of all waves (one per table and ref).  Raises ``LoadError`` and publishes nothing if a wave fails."""
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, target):
        raise FileExistsError(f"{target} exists")
    staging = f"{target.rstrip('/')}.staging-{scratch_path(spark, 'x').rsplit('-', 1)[-1]}"
    staged: dict[str, DataFrame] = {}
    gate = []

    def write(job: tuple[str, str]) -> None:
        name, pool = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        try:
            tables[name].write.parquet(f"{staging}/{name}")
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    try:
        for wave, names in enumerate(load_waves(schema)):
            names = [n for n in names if n in tables]
            if not names:
                continue
            with ThreadPoolExecutor(min(workers, len(names))) as threads:
                run = inheritable_thread_target(spark)(write)
                list(threads.map(run, [(n, f"load-{k % workers}") for k, n in enumerate(names)]))
            staged.update({n: spark.read.schema(tables[n].schema).parquet(f"{staging}/{n}") for n in names})
            found = _gate(staged, schema, wave, names)
            gate += found
            if any(r.orphan_rows for r in found):
                raise LoadError(wave, found)
        rename(spark, staging, target)
    except BaseException:
        delete(spark, staging)
        raise
    return spark.createDataFrame([tuple(r) for r in gate], GATE)
