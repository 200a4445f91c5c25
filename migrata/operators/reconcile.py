"""Identity across tables: id crosswalks and ref rewriting (E1), duplicate removal (E3), ref repair.

All three are equi-joins against a table with one row per id or key.  Those tables are stored first, so both sides of
a join come from plain exchanges, and AQE splits a hot referenced id on the side that holds it; Spark broadcasts
a lookup only when its measured size allows.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .keys import dense_id

RULES = ("earliest", "latest", "longest", "max", "min", "sum")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------------------
# Id remapping
# ---------------------------------------------------------------------------
def crosswalk(keys: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(source, old, new): dense ids 1..n over the keys of several tables, by table name and old id.

    ``keys`` names each table's frame and key column; keys of different types meet as text.  A null key gets no id.
    """
    types = {df.schema[c].dataType for df, c in keys.values()}
    parts = []
    for name in sorted(keys):
        df, c = keys[name]
        old = F.col(f"`{c}`") if len(types) == 1 else F.col(f"`{c}`").cast("string")
        parts.append(df.select(F.lit(name).alias("source"), old.alias("old")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return _stored(dense_id(every.where("old IS NOT NULL").distinct(), ["source", "old"], "new"), "crosswalk")


def _of(walk: DataFrame, source: str) -> DataFrame:
    return walk.where(F.col("source") == source).select(F.col("old").alias("__mg_old"), F.col("new").alias("__mg_new"))


def rewrite_refs(df: DataFrame, refs: Mapping[str, str], walk: DataFrame) -> DataFrame:
    """Every column of ``refs`` ({column: table it refers to}) rewritten to the new ids, one left join each.

    A ref without an entry becomes null; ``dangling`` lists such refs beforehand.
    """
    for c, source in refs.items():
        x = _of(walk, source)
        key = F.col(f"`{c}`").cast(walk.schema["old"].dataType)
        df = df.join(x, key == F.col("__mg_old"), "left").select(
            *[F.col("__mg_new").alias(k) if k == c else F.col(f"`{k}`") for k in df.columns])
    return df


def rewrite_nested(df: DataFrame, array: str, field: str, source: str, walk: DataFrame, id_col: str = "id") -> DataFrame:
    """The ref ``field`` of every struct in the column ``array`` rewritten; ``id_col`` is unique.

    Items leave their rows for the join, so a hot referenced id is split like a flat one, and come back by row: what a task
    holds at once is one row's array, as the row itself did.  Item order, null items and null or empty arrays stay.
    """
    items = df.select(F.col(f"`{id_col}`").alias("__mg_id"), F.posexplode(F.col(f"`{array}`")).alias("__mg_pos", "__mg_item"))
    key = F.col("__mg_item").getField(field).cast(walk.schema["old"].dataType)
    new = items.select("__mg_id", "__mg_pos", key.alias("__mg_key")).join(_of(walk, source), F.col("__mg_key") == F.col("__mg_old"))
    per = new.groupBy("__mg_id").agg(F.map_from_entries(F.collect_list(F.struct("__mg_pos", "__mg_new"))).alias("__mg_map"))
    found = F.coalesce(F.col("__mg_map"), F.create_map().cast("map<int,bigint>"))
    fixed = F.transform(F.col(f"`{array}`"), lambda x, i: F.when(x.isNotNull(), x.withField(field, F.try_element_at(found, i))))
    joined = df.join(per, F.col(f"`{id_col}`") == F.col("__mg_id"), "left")
    return joined.select(*[fixed.alias(c) if c == array else F.col(f"`{c}`") for c in df.columns])


def dangling(df: DataFrame, refs: Mapping[str, str], walk: DataFrame) -> DataFrame:
    """(ref, old, n_rows): ref values that have no entry in the crosswalk; values are counted before the join."""
    out = None
    for c, source in refs.items():
        per = df.groupBy(F.col(f"`{c}`").cast(walk.schema["old"].dataType).alias("old")).agg(F.count(F.lit(1)).alias("n_rows")).where("old IS NOT NULL")
        left = per.join(_of(walk, source), F.col("old") == F.col("__mg_old"), "left_anti").select(F.lit(c).alias("ref"), "old", "n_rows")
        out = left if out is None else out.union(left)
    return out


# ---------------------------------------------------------------------------
# Duplicate removal
# ---------------------------------------------------------------------------
def natural_key(*cols: Column) -> Column:
    """Text made comparable: lower case, runs of anything but letters and digits as one blank; null if nothing is left of any part."""
    parts = [F.nullif(F.trim(F.regexp_replace(F.lower(c.cast("string")), r"[^\p{L}\p{N}]+", " ")), F.lit("")) for c in cols]
    missing = parts[0].isNull()
    for p in parts[1:]:
        missing = missing | p.isNull()
    return F.when(~missing, F.concat_ws("|", *parts))


def merge_duplicates(df: DataFrame, key: Column, rules: Mapping[str, str], id_col: str = "id", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One survivor per ``key`` and the crosswalk (old, new) of every row that went.

    The survivor keeps the smallest id.  Each field is chosen for itself by its rule: ``earliest`` / ``latest`` value
    that is not null (by ``order``, the id unless named, then by value), ``longest`` text (ties: the smaller), ``max``,
    ``min``, ``sum``.  Fields without a rule are ``earliest``.  Rows with a null key are nobody's duplicate.
    Everything is one aggregate with partial sums, so a hot group collapses map-side.
    """
    unknown = set(rules.values()) - set(RULES)
    if unknown:
        raise ValueError(f"unknown rule {sorted(unknown)}")
    i, by = F.col(f"`{id_col}`"), F.col(f"`{order or id_col}`")

    def best(c: str) -> Column:
        v, rule = F.col(f"`{c}`"), rules.get(c, "earliest")
        if rule in ("max", "min", "sum"):
            return {"max": F.max, "min": F.min, "sum": F.sum}[rule](v).alias(c)
        if rule == "longest":
            # the shortest negative length first, then the smaller text
            return F.min_by(v, F.when(v.isNotNull(), F.struct(-F.char_length(v), v))).alias(c)
        pick = F.min_by if rule == "earliest" else F.max_by
        return pick(v, F.when(v.isNotNull(), F.struct(by, i))).alias(c)

    # a row without a key is a group of its own
    grouped = df.withColumn("__mg_key", key).withColumn("__mg_own", F.when(F.col("__mg_key").isNull(), i))
    survivors = grouped.groupBy("__mg_key", "__mg_own").agg(F.min(i).alias("__mg_id"), *[best(c) for c in df.columns if c != id_col])
    out = survivors.select(*[F.col("__mg_id").alias(c) if c == id_col else F.col(f"`{c}`") for c in df.columns])
    heads = grouped.where("__mg_key IS NOT NULL").groupBy(F.col("__mg_key").alias("__mg_k")).agg(F.min(i).alias("new"), F.max(i).alias("__mg_last"))
    lost = (grouped.select("__mg_key", i.alias("old")).join(heads.where("new < __mg_last"), F.col("__mg_key") == F.col("__mg_k"))
            .where("old <> new").select("old", "new").distinct())
    return out, _stored(lost, "survivors")


def repoint(df: DataFrame, ref: str, lost: DataFrame) -> DataFrame:
    """Refs to rows that went point to their survivors; all others stay."""
    x = lost.select(F.col("old").alias("__mg_old"), F.col("new").alias("__mg_new"))
    return df.join(x, F.col(f"`{ref}`") == F.col("__mg_old"), "left").select(
        *[F.coalesce("__mg_new", F.col(f"`{c}`")).alias(c) if c == ref else F.col(f"`{c}`") for c in df.columns])


# ---------------------------------------------------------------------------
# Ref repair by natural key
# ---------------------------------------------------------------------------
def _holds_map(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_holds_map(f.dataType) for f in t.fields)
    return _holds_map(t.elementType) if isinstance(t, T.ArrayType) else isinstance(t, (T.MapType, T.VariantType))


def _spread(rows: DataFrame) -> Column:
    """A hash of the whole row: rows that ask for nothing are dealt by it, as a null key would gather them in one task."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema.fields if not _holds_map(f.dataType)])


def repair_refs(child: DataFrame, ref: str, child_key: Column, parent: DataFrame, pk: str, parent_key: Column) -> DataFrame:
    """``child`` with ``outcome`` and a repaired ``ref``.

    ``valid``: the ref has a parent (or is null and has no key).  Otherwise the row's natural key decides: ``repaired`` if
    exactly one parent has it, ``ambiguous`` if several do, ``unmatched`` if none does; the last two keep their ref as it was.
    """
    ids = _stored(parent.select(F.col(f"`{pk}`").alias("__mg_id"), parent_key.alias("__mg_key"), F.lit(0).cast("bigint").alias("__mg_known")).where(
        "__mg_id IS NOT NULL").distinct(), "parents")
    known = ids.select("__mg_id", "__mg_known").distinct()
    names = ids.where("__mg_key IS NOT NULL").groupBy(F.col("__mg_key").alias("__mg_name")).agg(
        F.min("__mg_id").alias("__mg_lo"), F.max("__mg_id").alias("__mg_hi"))
    names = _stored(names.withColumn("__mg_named", F.lit(0).cast("bigint")), "names")
    # a second key, 0 beside a key and the row's hash beside a null one: that finds nothing, but has its place among all tasks
    rows = child.withColumn("__mg_own", child_key).withColumn("__mg_row", _spread(child))
    rows = rows.withColumn("__mg_at", F.when(F.col(f"`{ref}`").isNotNull(), F.lit(0).cast("bigint")).otherwise(F.col("__mg_row")))
    rows = rows.join(known, (F.col(f"`{ref}`") == F.col("__mg_id")) & (F.col("__mg_at") == F.col("__mg_known")), "left")
    orphan = F.col("__mg_id").isNull() & (F.col(f"`{ref}`").isNotNull() | F.col("__mg_own").isNotNull())
    # only orphans ask for a name, so valid rows do not gather on common ones
    rows = rows.withColumn("__mg_ask", F.when(orphan, F.col("__mg_own"))).withColumn("__mg_orphan", orphan)
    rows = rows.withColumn("__mg_to", F.when(F.col("__mg_ask").isNotNull(), F.lit(0).cast("bigint")).otherwise(F.col("__mg_row")))
    found = rows.join(names, (F.col("__mg_ask") == F.col("__mg_name")) & (F.col("__mg_to") == F.col("__mg_named")), "left")
    one = F.col("__mg_lo") == F.col("__mg_hi")
    outcome = (F.when(~F.col("__mg_orphan"), "valid").when(F.col("__mg_lo").isNull(), "unmatched").when(one, "repaired").otherwise("ambiguous"))
    new = F.when(F.col("__mg_orphan") & one, F.col("__mg_lo")).otherwise(F.col(f"`{ref}`"))
    return found.select(*[new.alias(c) if c == ref else F.col(f"`{c}`") for c in child.columns], outcome.alias("outcome"))
