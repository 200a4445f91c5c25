"""Column match candidates (E6): which columns of a table set hold the same values.

Every column gets a profile (kind, rows, nulls, distinct values) and a MinHash sketch of its values, both mergeable
aggregates over (column, value) rows.  Bands of the sketch are equi-joined, so columns meet only where a band agrees, not
all with all; candidates of one kind are then settled by the exact Jaccard similarity of their distinct values.

Scale: tables are unpivoted row by row and collapse map-side to their distinct values; a sketch is ``ROWS`` * ``BANDS`` longs
per column.  The exact step joins the distinct values of candidate columns by value: a value meets itself once per
column that holds it, however many rows do.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reconcile import _stored

ROWS, BANDS = 2, 32
SIMILARITY = 0.5


def column_kind(dt: T.DataType) -> str | None:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    return None


def column_values(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, kind, value, n): the distinct values of every flat column and how many rows hold each (null included)."""
    parts = []
    for name in sorted(tables):
        df = tables[name]
        cells = [F.struct(F.lit(f.name).alias("column_name"), F.lit(column_kind(f.dataType)).alias("kind"), F.col(f"`{f.name}`").cast("string").alias("value"))
                 for f in df.schema.fields if column_kind(f.dataType)]
        if cells:
            parts.append(df.select(F.lit(name).alias("table_name"), F.explode(F.array(*cells)).alias("c")).select("table_name", "c.*"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("table_name", "column_name", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profiles(values: DataFrame, sketch: bool = False) -> DataFrame:
    """(table_name, column_name, kind, n_rows, n_null, n_distinct) of ``column_values``, with the sketch ``m0, m1, ...`` if asked for."""
    h = F.when(F.col("value").isNotNull(), F.xxhash64("value"))
    minima = []
    for i in range(ROWS * BANDS if sketch else 0):
        minima.append(F.min(F.when(F.col("value").isNotNull(), F.xxhash64(F.lit(i), h))).alias(f"m{i}"))
    return values.groupBy("table_name", "column_name", "kind").agg(
        F.sum("n").cast("bigint").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("n_null"),
        F.count("value").alias("n_distinct"), *minima)


def column_matches(tables: Mapping[str, DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """Ranked pairs of columns of one kind with Jaccard similarity of ``similarity`` or more.

    (table_a, column_a, table_b, column_b, kind, common, distinct_a, distinct_b, jaccard, rank); ``rank`` numbers the matches of
    column a from the best on (ties by name).  Columns without values match nothing.  At similarity 0.5 a pair
    shares one of the 32 bands of two with probability 0.9999.
    """
    values = _stored(column_values(tables), "values")
    profiles = _stored(column_profiles(values, sketch=True).where("n_distinct > 0"), "profiles")
    name = F.struct("table_name", "column_name")
    bands = F.array(*[F.xxhash64(F.lit(b), "kind", *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)])
    keys = profiles.select(name.alias("c"), "kind", F.explode(bands).alias("key"))
    right = keys.select(F.col("c").alias("d"), F.col("kind").alias("kind_d"), F.col("key").alias("key_d"))
    pairs = _stored(keys.join(right, (F.col("key") == F.col("key_d")) & (F.col("kind") == F.col("kind_d")) & (F.col("c") < F.col("d")))
                    .select("c", "d", "kind").distinct(), "pairs")
    held = values.where("value IS NOT NULL").select(name.alias("c"), "value")
    other = held.select(F.col("c").alias("e"), F.col("value").alias("v"))
    common = pairs.join(held, "c").join(other, (F.col("value") == F.col("v")) & (F.col("d") == F.col("e")))
    counts = common.groupBy("c", "d", "kind").agg(F.count(F.lit(1)).alias("common"))
    size = profiles.select(name.alias("s"), "n_distinct")
    sized = (counts.join(size.select(F.col("s").alias("c"), F.col("n_distinct").alias("distinct_a")), "c")
             .join(size.select(F.col("s").alias("d"), F.col("n_distinct").alias("distinct_b")), "d"))
    scored = sized.withColumn("jaccard", F.col("common") / (F.col("distinct_a") + F.col("distinct_b") - F.col("common"))).where(F.col("jaccard") >= similarity)
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("jaccard"), "d"))
    return scored.select(F.col("c.table_name").alias("table_a"), F.col("c.column_name").alias("column_a"), F.col("d.table_name").alias("table_b"),
                         F.col("d.column_name").alias("column_b"), "kind", "common", "distinct_a", "distinct_b", "jaccard", rank.alias("rank"))
