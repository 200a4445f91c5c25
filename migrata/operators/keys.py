"""Keys and ordering: dense surrogate ids, positions within groups, last-wins, first-per-key.

Spark rows have no order, so every order-dependent operator takes explicit order columns.

``rank_within`` is the shared building block.  A plain ``row_number().over(orderBy)`` puts all rows into
one task, and ``row_number().over(partitionBy(g).orderBy(o))`` a hot group.  Instead the rows are range
partitioned and sorted by ``(group..., order...)``, so a hot group spreads over as many partitions as its
rows need, and written once to shared storage together with their place (partition and row in it).  That
write is the operator's one materialisation: it happens when the operator is called, fixes the places
for good (a retried task cannot move them), and leaves two cheap reads: the rows per partition (one number
per partition, added up on the driver) and the rows themselves.  A position inside a group is the place
less the smallest place of the group, a map-side combined minimum joined back on the group.  There is
one way for every size.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

_AT = "__mg_at"
_PART = "__mg_part"
_OFF = "__mg_off"
_FIRST = "__mg_first"
# monotonically_increasing_id(): partition number above bit 33, row number below
_BITS = 33


def placed(df: DataFrame, key_cols: Sequence[str], n_partitions: int | None = None) -> DataFrame:
    """``df`` stored in the order of ``key_cols`` (nulls first), with every row's place 0.. in ``__mg_at``."""
    spark = df.sparkSession
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in key_cols]
    path = scratch_path(spark, "ranked")
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(_AT, F.monotonically_increasing_id())
    ordered.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(ordered.schema).parquet(path).withColumn(_PART, F.shiftright(_AT, _BITS).cast("int"))
    # one number per partition
    held = sorted((r[0], r[1]) for r in rows.groupBy(_PART).count().collect())
    offsets, total = [], 0
    for part, count in held:
        offsets.append((part, total))
        total += count
    table = spark.createDataFrame(offsets, f"{_PART} int, {_OFF} bigint")
    row = F.col(_AT).bitwiseAND(F.lit((1 << _BITS) - 1))
    return rows.join(F.broadcast(table), _PART).withColumn(_AT, F.col(_OFF) + row).drop(_PART, _OFF)


def rank_within(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    name: str,
    start: int = 1,
    n_partitions: int | None = None,
) -> DataFrame:
    """Dense 1-based (or ``start``-based) row number of each row within its group, by order.

    Ties in ``order_cols`` are broken arbitrarily, but once: the stored order decides.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    rows = placed(df, group_cols + order_cols, n_partitions)
    if not group_cols:
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(_AT) + F.lit(start)).cast("bigint").alias(name))
    keys = [f"__mg_g{i}" for i in range(len(group_cols))]
    first = rows.groupBy(*[F.col(f"`{c}`").alias(k) for c, k in zip(group_cols, keys)]).agg(F.min(_AT).alias(_FIRST))
    cond = F.lit(True)
    for c, k in zip(group_cols, keys):
        cond = cond & F.col(f"`{c}`").eqNullSafe(F.col(k))
    return rows.join(first, cond, "left").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col(_AT) - F.col(_FIRST) + F.lit(start)).cast("bigint").alias(name))


def dense_id(df: DataFrame, order_cols: Sequence[str], name: str = "id", **kw) -> DataFrame:
    """K1: ids 1..n following ``order_cols`` with no gaps and no single-task step."""
    return rank_within(df, [], order_cols, name, **kw)


def position_in_group(df: DataFrame, key: Sequence[str] | str, order_cols: Sequence[str], name: str = "pos",
                      **kw) -> DataFrame:
    """K6: 0-based position of a row within its key group, by order (hot keys are split)."""
    keys = [key] if isinstance(key, str) else list(key)
    return rank_within(df, keys, order_cols, name, start=0, **kw)


def last_wins(df: DataFrame, key: str | Sequence[str], seq: str) -> DataFrame:
    """K3: the row with the largest ``seq`` per key (the last written).

    ``max_by`` aggregates partially before the shuffle, so a hot duplicated key shrinks
    map-side.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    packed = F.struct(*[F.col(c) for c in rest])
    agg = df.groupBy(*keys).agg(F.max_by(packed, F.col(seq)).alias("__mg_row"))
    return agg.select(*keys, *[F.col(f"__mg_row.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, key: str | Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """K5: the first row per key by ``order_cols`` (``min_by`` with partial aggregation)."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in rest])
    order = F.struct(*[F.col(c) for c in order_cols])
    agg = df.groupBy(*keys).agg(F.min_by(packed, order).alias("__mg_row"))
    return agg.select(*keys, *[F.col(f"__mg_row.{c}").alias(c) for c in rest])


def dense_id_nested(
    df: DataFrame, parent_key: str, array_col: str, name: str = "id", keep: Sequence[str] = (), **kw
) -> DataFrame:
    """K2: explode an array and number the items 1..n by (parent key, position)."""
    exploded = df.select(*[F.col(c) for c in [parent_key, *keep]],
                         F.posexplode(F.col(array_col)).alias("pos", "item"))
    return rank_within(exploded, [], [parent_key, "pos"], name, **kw)
