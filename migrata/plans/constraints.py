"""Constraint checks on tables (C1-C4), re-aimed from schema validation to rows.

C1-C3 pre-aggregate by key / value before any join, so a hot key or value collapses
map-side; C4 is driver-side metadata (the load order of tables by their refs).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import Schema


def pk_check(df: DataFrame, key: Sequence[str] | str, name: str = "") -> DataFrame:
    """Rows, rows with a null key part, distinct keys, keys seen more than once, surplus rows."""
    keys = [key] if isinstance(key, str) else list(key)
    has_null = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(has_null.cast("int")).alias("nul"))
    return per.agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("nul") == 1, F.col("n")).otherwise(0)).alias("null_keys"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(F.col("n") > 1).alias("duplicated_keys"),
        F.sum(F.col("n") - 1).alias("surplus_rows"),
    ).select(F.lit(name or ",".join(keys)).alias("key"), *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                                            for c in ("n_rows", "null_keys", "distinct_keys",
                                                                      "duplicated_keys", "surplus_rows")])


def fk_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, name: str = "") -> DataFrame:
    """Child rows whose non-null ref has no parent row, plus null refs.

    Child rows are counted per ref value first, so a hot referenced id is one row in the
    anti join.
    """
    per = child.groupBy(F.col(fk).alias("__v")).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(F.col(pk).alias("__k")).distinct()
    orphans = per.filter(F.col("__v").isNotNull()).join(keys, per["__v"] == keys["__k"], "left_anti")
    o = orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_values"))
    n = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                F.coalesce(F.sum(F.when(F.col("__v").isNull(), F.col("n"))), F.lit(0)).alias("null_refs"))
    label = name or fk
    return (n.select(F.lit(label).alias("ref"), "n_rows", "null_refs")
            .join(o.select(F.lit(label).alias("__r"), "orphan_rows", "orphan_values"), F.col("ref") == F.col("__r"))
            .drop("__r").select("ref", *[F.col(c).cast("bigint") for c in
                                         ("n_rows", "null_refs", "orphan_rows", "orphan_values")]))


def enum_domain(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Values outside the declared domain, with their row counts (nulls are not violations)."""
    return (df.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(values)))
            .groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
            .select(F.lit(column).alias("column_name"), "value", "n_rows"))


def load_waves(schema: Schema) -> list[list[str]]:
    """C4: tables in ref order (targets before dependants), as waves that can load together.

    A depth-first walk gives each entity its depth below its ref targets; cycles are
    tolerated (an edge back into the current path is ignored).
    """
    depth: dict[str, int] = {}
    on_path: set[str] = set()

    def visit(e: str) -> int:
        if e in depth:
            return depth[e]
        on_path.add(e)
        d = 0
        for _, target in schema.refs(e):
            if target in schema.entities and target != e and target not in on_path:
                d = max(d, visit(target) + 1)
        on_path.discard(e)
        depth[e] = d
        return d

    for e in schema.entities:
        visit(e)
    waves: list[list[str]] = [[] for _ in range(max(depth.values(), default=-1) + 1)]
    for e in schema.entities:
        waves[depth[e]].append(e)
    return waves
