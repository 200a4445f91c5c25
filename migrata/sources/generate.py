"""Deterministic synthetic table sets from a schema.

Every value is a pure function of ``(seed, table, column, id[, item])`` through
``xxhash64``, so a table is the same under any partitioning, task retry or executor loss
(unlike ``rand()``).  Tables start from ``spark.range(1, n + 1)``: ids are dense, refs are
``hash mod n_target + 1`` and therefore always valid without any join.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import FieldDef, Schema

def _h(seed: int, table: str, col: str, *extra: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(table), F.lit(col), *extra)


def _pick(h: Column, k: int) -> Column:
    return F.pmod(h, F.lit(k)).cast("int")


def scalar_value(fname: str, fd: FieldDef, h: Column, stub_key: Column, ref_sizes: Mapping[str, int]) -> Column:
    """One generated value of kind ``fd.kind``."""
    k = fd.kind
    if k == "number":
        return (_pick(h, 1000) + 1).cast("bigint")
    if k == "bool":
        return _pick(h, 2) == 1
    if k == "date":
        y = 2010 + _pick(h, 14)
        m = 1 + _pick(F.xxhash64(h, F.lit("m")), 12)
        d = 1 + _pick(F.xxhash64(h, F.lit("d")), 28)
        return F.format_string("%04d-%02d-%02d", y, m, d)
    if k == "enum":
        vals = list(fd.values or ["value"])
        return F.element_at(F.array(*[F.lit(v) for v in vals]), _pick(h, len(vals)) + 1)
    if k == "multi_enum":
        vals = list(fd.values or ["value"])
        keyed = F.array(*[F.struct(F.xxhash64(h, F.lit(v)).alias("k"), F.lit(v).alias("v")) for v in vals])
        size = _pick(F.xxhash64(h, F.lit("n")), len(vals)) + 1
        return F.transform(F.slice(F.array_sort(keyed), 1, size), lambda x: x["v"])
    if k == "ref":
        n = max(1, int(ref_sizes.get(fd.target or "", 1)))
        return (_pick(h, n) + 1).cast("bigint")
    if k in ("text", "richtext"):
        # a short text repeats in a large table, a rich one is one of a kind
        return F.concat(F.lit(f"{fname} "), _pick(h, 100000).cast("string") if k == "text" else stub_key.cast("string"))
    return F.lit(None).cast("string")


def generate(spark: SparkSession, schema: Schema, n: int | Mapping[str, int] = 3, seed: int = 7,
             num_partitions: int | None = None) -> dict[str, DataFrame]:
    """G1: ``n`` rows per entity (or a per-entity mapping), ids 1..n, every column filled."""
    sizes = {e: (n[e] if isinstance(n, Mapping) else n) for e in schema.entities}
    out = {}
    for ename, fields in schema.entities.items():
        base = spark.range(1, sizes[ename] + 1, numPartitions=num_partitions)
        cols = []
        for fname, fd in fields.items():
            if fd.kind == "id":
                cols.append(F.col("id").alias(fname))
            elif fd.kind == "nested":
                cols.append(nested_items(ename, fname, fd, schema, seed, sizes).alias(fname))
            else:
                cols.append(scalar_value(fname, fd, _h(seed, ename, fname, F.col("id")), F.col("id"), sizes)
                            .alias(fname))
        out[ename] = base.select(*cols)
    return out


def nested_items(ename: str, fname: str, fd: FieldDef, schema: Schema, seed: int,
                 sizes: Mapping[str, int]) -> Column:
    """1-3 items per row, each a struct of the block's scalar fields."""
    block = schema.blocks.get(fd.of or "", {})
    k = _pick(_h(seed, ename, fname, F.col("id")), 3) + 1

    def item(i: Column) -> Column:
        parts = []
        for bf, bd in block.items():
            if bd.kind in ("id", "nested"):
                continue
            h = _h(seed, ename, f"{fname}.{bf}", F.col("id"), i)
            parts.append(scalar_value(bf, bd, h, F.concat(F.col("id").cast("string"), F.lit("_"), i.cast("string")),
                                      sizes).alias(bf))
        return F.struct(*parts) if parts else F.struct(i.alias("pos"))

    return F.transform(F.sequence(F.lit(1), k), item)
