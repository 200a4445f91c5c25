"""Migration transforms T1-T11 as DataFrame operators over a table set.

A table set is ``dict[str, DataFrame]``: one lazy frame per entity, the entity id in
column ``id``.  Each step function takes the current table set, the step and the
*original* source tables (denormalize reads those) and returns a new table set.  Nothing
is executed here: the functions only grow logical plans, which Catalyst collapses
(consecutive projections fuse into one) and prunes.

Typed-carrier presence rule: a null value is a missing value, except in columns the log
always writes (computed and inlined columns), where null is a present ``None``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, MutableMapping, Sequence
from threading import Lock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import coerce, is_numberish, literal_equal, py_str, remap, values_equal
from ..spec import (
    Computed,
    Denormalize,
    EnumRemap,
    ExtractNested,
    FlattenNested,
    Merge,
    Partition,
    Rename,
    Retype,
    SpecError,
    Split,
    Step,
    Unmapped,
    merged_column_name,
)
from .keys import dense_id, first_per_key, rank_within

Tables = dict[str, DataFrame]
ROUTE_COL = "__mg_sub"
PRE = "__mg_pre_"  # hidden pre-remap copy of a discriminator, dropped when the log is done


def _dtype(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


# ---------------------------------------------------------------------------
# Row-local steps on one frame
# ---------------------------------------------------------------------------
def rename_col(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Move the value to a new name if the column exists (replacing any old ``dst``)."""
    if src not in df.columns or src == dst:
        return df
    if dst in df.columns:
        df = df.drop(dst)
    return df.withColumnRenamed(src, dst)


def rename_cols(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Many renames in one projection."""
    present = {k: v for k, v in mapping.items() if k in df.columns and k != v}
    keep = [c for c in df.columns if c not in set(present.values()) or c in present]
    return df.select(*[F.col(c).alias(present.get(c, c)) for c in keep])


def retype_col(df: DataFrame, fld: str, to_kind: str) -> DataFrame:
    """Coerce a column to a kind (``str``, truthiness, bool -> 0/1)."""
    if fld not in df.columns:
        return df
    return df.withColumn(fld, coerce(F.col(fld), _dtype(df, fld), to_kind))


def enum_remap_col(df: DataFrame, fld: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace by mapping; unknown values pass through; null stays null."""
    if fld not in df.columns or not isinstance(_dtype(df, fld), T.StringType):
        return df
    return df.withColumn(fld, remap(F.col(fld), mapping, "self"))


def drop_col(df: DataFrame, fld: str) -> DataFrame:
    """T4: unmapped column."""
    return df.drop(fld) if fld in df.columns else df


def array_count(df: DataFrame, fld: str) -> Column:
    if fld in df.columns and isinstance(_dtype(df, fld), T.ArrayType):
        return F.coalesce(F.size(F.col(fld)), F.lit(0)).cast("bigint")
    return F.lit(0).cast("bigint")


def flatten_count(df: DataFrame, fld: str, into: str) -> DataFrame:
    """T5: replace an array by its length; missing or null -> 0."""
    cnt = array_count(df, fld)
    df = df.withColumn("__mg_cnt", cnt)
    if fld in df.columns:
        df = df.drop(fld)
    if into in df.columns:
        df = df.drop(into)
    return df.withColumnRenamed("__mg_cnt", into)


def _operand(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    if name in df.columns:
        return F.col(name), _dtype(df, name)
    return F.lit(None), T.NullType()


def computed_expr(df: DataFrame, step: Computed, null_present: set[str] = frozenset()) -> Column:
    """Value of a computed column from the current row."""
    op = step.operation
    if op == "concat":
        a, b = step.source_fields
        parts = []
        for f_ in (a, b):
            c, dt = _operand(df, f_)
            txt = py_str(c, dt) if not isinstance(dt, T.NullType) else F.lit(None).cast("string")
            missing = F.lit("None") if f_ in null_present else F.lit("")
            parts.append(F.coalesce(txt, missing))
        return F.concat(parts[0], F.lit(step.separator), parts[1])
    if op in ("multiply", "sum_fields"):
        a, b = step.source_fields
        (ca, ta), (cb, tb) = _operand(df, a), _operand(df, b)
        if not (is_numberish(ta) and is_numberish(tb)):
            return F.lit(None).cast("double")
        ca = ca.cast("bigint") if isinstance(ta, T.BooleanType) else ca
        cb = cb.cast("bigint") if isinstance(tb, T.BooleanType) else cb
        if op == "multiply":
            both_int = not isinstance(ta, (T.FloatType, T.DoubleType, T.DecimalType)) and not isinstance(
                tb, (T.FloatType, T.DoubleType, T.DecimalType))
            return F.try_multiply(ca.cast("bigint"), cb.cast("bigint")) if both_int else ca.cast("double") * cb.cast("double")
        both_int = not isinstance(ta, (T.FloatType, T.DoubleType, T.DecimalType)) and not isinstance(
            tb, (T.FloatType, T.DoubleType, T.DecimalType))
        return F.try_add(ca.cast("bigint"), cb.cast("bigint")) if both_int else ca.cast("double") + cb.cast("double")
    if op == "bool_from_enum":
        c, dt = _operand(df, step.source_field)
        return literal_equal(c, dt, step.value)
    raise SpecError(f"unknown computed operation {op!r}")


def computed_col(df: DataFrame, step: Computed, null_present: set[str] = frozenset()) -> DataFrame:
    return df.withColumn(step.dest_field, computed_expr(df, step, null_present))


def apply_row_step(df: DataFrame, step: Step, entity: str, split_drop: bool = True,
                   null_present: set[str] = frozenset()) -> DataFrame:
    """One row-local step of ``entity`` (others are ignored)."""
    if isinstance(step, Rename) and step.entity == entity:
        return rename_col(df, step.from_, step.to)
    if isinstance(step, Retype) and step.entity == entity:
        return retype_col(df, step.field, step.to)
    if isinstance(step, EnumRemap) and step.entity == entity:
        return enum_remap_col(df, step.field, step.as_dict)
    if isinstance(step, Unmapped) and step.entity == entity:
        return drop_col(df, step.field)
    if isinstance(step, FlattenNested) and step.entity == entity:
        return flatten_count(df, step.field, step.into)
    if isinstance(step, Split) and step.from_ == entity and split_drop:
        return df.drop(*[m for m in step.moved_fields if m in df.columns])
    if isinstance(step, Computed) and step.entity == entity:
        return computed_col(df, step, null_present)
    return df


# ---------------------------------------------------------------------------
# Structural steps on a table set
# ---------------------------------------------------------------------------
def split_table(parent: DataFrame, moved: Sequence[str], link_field: str,
                order_cols: Sequence[str] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """Vertical split.  Detail rows get ids 1..n in parent order and a link to the parent."""
    moved_here = [m for m in moved if m in parent.columns]
    order_cols = [c for c in order_cols if c in parent.columns] or ["id"]
    detail_src = parent.select(
        *[F.col(c).alias(f"__mg_o{i}") for i, c in enumerate(order_cols)],
        F.col("id").alias(link_field), *[F.col(m) for m in moved_here],
    )
    okeys = [f"__mg_o{i}" for i in range(len(order_cols))]
    detail = dense_id(detail_src, okeys, "id").select("id", link_field, *moved_here)
    return parent.drop(*moved_here), detail


def merge_tables(parent: DataFrame, child: DataFrame, child_name: str, link: str,
                 child_order: Sequence[str] = ("id",)) -> DataFrame:
    """Parent left join its first child (by ``child_order``) on the link.

    The child's id and link are dropped; colliding child columns are prefixed with
    ``{child}_``.  ``min_by`` aggregates map-side, so a parent with very many children
    shrinks before the shuffle.  Children of unknown parents are dropped.
    """
    if link not in child.columns:
        return parent
    order = [c for c in child_order if c in child.columns] or ["id"]
    fields = [c for c in child.columns if c not in (link, "id") and not c.startswith(PRE)]
    cand = child.filter(F.col(link).isNotNull()).select(
        F.col(link).alias("__mg_link"), *[F.col(c).alias(f"__mg_ord{i}") for i, c in enumerate(order)],
        *[F.col(c) for c in fields],
    )
    first = first_per_key(cand, "__mg_link", [f"__mg_ord{i}" for i in range(len(order))])
    names: list[str] = list(parent.columns)
    out_names = []
    for c in fields:
        n = merged_column_name(c, names, child_name)
        names.append(n)
        out_names.append(n)
    first = first.select(F.col("__mg_link"), *[F.col(c).alias(n) for c, n in zip(fields, out_names)])
    joined = parent.join(first, parent["id"] == first["__mg_link"], "left")
    return joined.select(*[parent[c] for c in parent.columns], *[first[n] for n in out_names])


def extract_items(parent: DataFrame, fld: str, link_field: str, block_fields: Sequence[str] | None = None,
                  order_cols: Sequence[str] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """Array of structs -> child table ``{id, link, block fields}``; the array leaves the parent.

    Ids run 1..n over (parent order, item position); null / empty arrays give no rows.
    """
    if fld not in parent.columns:
        schema_fields = list(block_fields or [])
        empty = parent.sparkSession.createDataFrame(
            [], "id bigint, {} bigint".format(link_field)
            + "".join(f", `{b}` string" for b in schema_fields))
        return parent, empty
    order_cols = [c for c in order_cols if c in parent.columns] or ["id"]
    item_type = _dtype(parent, fld).elementType
    item_fields = [f.name for f in item_type.fields] if isinstance(item_type, T.StructType) else []
    wanted = list(block_fields) if block_fields is not None else item_fields
    exploded = parent.select(
        *[F.col(c).alias(f"__mg_o{i}") for i, c in enumerate(order_cols) if c != "id"],
        F.col("id").alias(link_field),
        F.posexplode(F.col(fld)).alias("__mg_pos", "__mg_item"),
    )
    okeys = [link_field if c == "id" else f"__mg_o{i}" for i, c in enumerate(order_cols)] + ["__mg_pos"]
    # only the fields that stay are numbered (dealt by range and stored)
    narrow = exploded.select(*dict.fromkeys([*okeys, link_field]), *[
        F.col(f"__mg_item.{b}").alias(f"__mg_f{i}") for i, b in enumerate(wanted) if b in item_fields])
    numbered = dense_id(narrow, okeys, "id")
    cols = [F.col("id"), F.col(link_field)]
    for i, b in enumerate(wanted):
        cols.append(F.col(f"__mg_f{i}").alias(b) if b in item_fields else F.lit(None).cast("string").alias(b))
    return parent.drop(fld), numbered.select(*cols)


def route_column(df: DataFrame, on_field: str, mapping: Mapping[str, str]) -> Column:
    """Sub-table of each row from its current discriminator value (null when unmapped)."""
    if on_field not in df.columns:
        return F.lit(None).cast("string")
    if not isinstance(_dtype(df, on_field), T.StringType):
        return F.lit(None).cast("string")  # mapping keys are strings; other kinds never match
    return remap(F.col(on_field), mapping, "null")


def partition_table(df: DataFrame, on_field: str, mapping: Mapping[str, str],
                    pre: tuple[str, Mapping[str, str]] | None = None) -> dict[str, DataFrame]:
    """Horizontal split by value; unmapped / null values are dropped; discriminator dropped.

    Each sub-table is a filter ``on_field IN (values of that sub)`` over the same frame, so the
    predicate reaches the Parquet scan when the column is a plain (possibly renamed) column.
    ``pre`` = (column holding the value before an enum remap, that remap): the filter is then
    written on the pre-remap value with the values mapped back, which the scan can evaluate.
    """
    subs: dict[str, list[str]] = {}
    for v, s in mapping.items():
        subs.setdefault(s, []).append(v)
    out = {}
    for sub, vals in subs.items():
        if on_field in df.columns and isinstance(_dtype(df, on_field), T.StringType):
            if pre is not None and pre[0] in df.columns:
                remap_ = pre[1]
                raw = sorted({k for k, v in remap_.items() if v in vals} | {u for u in vals if u not in remap_})
                part = df.filter(F.col(pre[0]).isin(raw)).drop(on_field)
            else:
                part = df.filter(F.col(on_field).isin(vals)).drop(on_field)
        else:
            part = df.filter(F.lit(False))
        out[sub] = part
    return out


def routed_union(df: DataFrame, on_field: str, mapping: Mapping[str, str]) -> DataFrame:
    """All routable rows with their sub-table in ``__mg_sub`` (one pass; for partitioned sinks)."""
    routed = df.withColumn(ROUTE_COL, route_column(df, on_field, mapping))
    return routed.filter(F.col(ROUTE_COL).isNotNull()).drop(on_field)


def denormalize_table(current: DataFrame, original: DataFrame | None, via_src: str, via_now: str | None,
                      target: DataFrame | None, inlined: Sequence[tuple[str, str]]) -> DataFrame:
    """Inline columns of the referenced row of the *original* target table.

    The ref value is the original row's ``via_src`` (looked up by id); a broken ref gives
    null (a present ``None``).  When the ref column still holds original values under its
    current name the id lookup is skipped.  The join is a plain left join: AQE turns it into
    a broadcast join only when the target side is measured small at run time.
    """
    out_cols = [d for _, d in inlined]
    if target is None or original is None or via_src not in original.columns:
        base = current
        for _, d in inlined:
            base = base.withColumn(d, F.lit(None).cast("string"))
        return base
    tgt_cols = {}
    for s, d in inlined:
        if s in target.columns:
            tgt_cols[d] = F.col(s)
        else:
            tgt_cols[d] = F.lit(None).cast("string")
    tgt = target.select(F.col("id").alias("__mg_tid"), *[c.alias(d) for d, c in tgt_cols.items()])
    if via_now is not None and via_now in current.columns:
        keyed = current.withColumn("__mg_via", F.col(via_now))
    else:
        orig_via = original.select(F.col("id").alias("__mg_oid"), F.col(via_src).alias("__mg_via"))
        keyed = current.join(orig_via, current["id"] == orig_via["__mg_oid"], "left").drop("__mg_oid")
    base_cols = [c for c in current.columns if c not in out_cols]
    joined = keyed.join(tgt, keyed["__mg_via"] == tgt["__mg_tid"], "left")
    return joined.select(*[keyed[c] for c in base_cols], *[tgt[d] for d in out_cols])


def _value_changed(log: Sequence[Step], upto: int, entity: str, name: str) -> bool:
    """Has any step before ``upto`` changed the values of ``entity.name`` (not just its name)?"""
    for s in log[:upto]:
        if isinstance(s, (Retype, EnumRemap)) and s.entity == entity and s.field == name:
            return True
        if isinstance(s, Computed) and s.entity == entity and s.dest_field == name:
            return True
        if isinstance(s, FlattenNested) and s.entity == entity and s.into == name:
            return True
    return False


class LazyTables(MutableMapping):
    """Tables by name, some of them built when first asked for (dense ids store their input, see ``keys``)."""

    def __init__(self, tables: Mapping[str, DataFrame] | None = None):
        self._made: dict[str, DataFrame] = dict(tables or {})
        self._due: dict[str, Callable[[], DataFrame]] = {}

    def defer(self, name: str, build: Callable[[], DataFrame]) -> None:
        self._made.pop(name, None)
        self._due[name] = build

    def later(self, name: str, then: Callable[[DataFrame], DataFrame]) -> Callable[[], DataFrame]:
        """``then`` of the table as it is now, to be built on demand."""
        if name in self._due:
            build, made, one = self._due[name], [], Lock()

            def once() -> DataFrame:
                with one:  # tables may be asked for by several threads
                    if not made:
                        made.append(build())
                return then(made[0])
            return once
        df = self._made[name]
        return lambda: then(df)

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._due:
            self._made[name] = self._due.pop(name)()
        return self._made[name]

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self._due.pop(name, None)
        self._made[name] = df

    def __delitem__(self, name: str) -> None:
        if name not in self._made and name not in self._due:
            raise KeyError(name)
        self._made.pop(name, None)
        self._due.pop(name, None)

    def __contains__(self, name: object) -> bool:
        return name in self._made or name in self._due

    def __iter__(self):
        return iter([*self._made, *self._due])

    def __len__(self) -> int:
        return len(self._made) + len(self._due)


def _touched(s: Step) -> set[str]:
    """Every table that a step reads rows of or writes."""
    return {name for a in ("entity", "from_", "detail", "parent", "child", "into", "new_entity")
            if isinstance(name := getattr(s, a, None), str)}


def _source_name(log: Sequence[Step], entity: str, now: str) -> str:
    """The source name of a field, walking its renames backwards from the present one."""
    for s in reversed(log):
        if isinstance(s, Rename) and (s.entity, s.to) == (entity, now):
            now = s.from_
    return now


def apply_log(tables: Mapping[str, DataFrame], log: Sequence[Step], blocks: Mapping[str, Sequence[str]] | None = None,
              order: Mapping[str, Sequence[str]] | None = None,
              routed: dict[str, tuple[DataFrame, list[str]]] | None = None) -> LazyTables:
    """Fold the whole log over a table set, in log order; returns the destination set.

    Tables are built when first read from the result, so a caller pays for the dense ids of a split
    or extract only if it reads that table.

    ``blocks`` gives the field list of each nested block (extract keeps exactly those);
    ``order`` gives the row order of each entity (default ``id``) for split ids, first
    child and extract ids.  When ``routed`` is a dict, each partitioned entity whose
    sub-tables no later step touches is also returned there as one routed frame (rows with
    their sub-table in ``__mg_sub``) plus its sub names, so a sink can write every
    sub-table in one pass with ``partitionBy``.
    """
    originals = dict(tables)
    data = LazyTables(tables)
    order = dict(order or {})
    blocks = dict(blocks or {})
    null_present: dict[str, set[str]] = {}
    # (entity, field) -> (hidden pre-remap column, remap): lets a later partition filter the raw value
    pre_remap: dict[tuple[str, str], tuple[str, dict]] = {}
    for i, s in enumerate(log):
        if isinstance(s, (Rename, Retype, EnumRemap, Unmapped, FlattenNested, Computed)):
            if s.entity in data:
                key = (s.entity, getattr(s, "field", None) or getattr(s, "from_", None)
                       or getattr(s, "dest_field", None))
                if isinstance(s, EnumRemap):
                    cur = data[s.entity]
                    if key in pre_remap or s.field not in cur.columns or not isinstance(_dtype(cur, s.field),
                                                                                          T.StringType):
                        pre_remap.pop(key, None)  # chained remaps: keep the plain filter
                    else:
                        hidden = f"{PRE}{len(pre_remap)}_{s.field}"
                        data[s.entity] = cur.withColumn(hidden, F.col(s.field))
                        pre_remap[key] = (hidden, s.as_dict)
                elif isinstance(s, Rename) and key in pre_remap:
                    pre_remap[(s.entity, s.to)] = pre_remap.pop(key)
                elif isinstance(s, (Retype, Unmapped, FlattenNested)):
                    pre_remap.pop(key, None)
                    if isinstance(s, FlattenNested):
                        pre_remap.pop((s.entity, s.into), None)
                elif isinstance(s, Computed):
                    pre_remap.pop((s.entity, s.dest_field), None)
                data[s.entity] = apply_row_step(data[s.entity], s, s.entity,
                                                null_present=null_present.get(s.entity, set()))
                if isinstance(s, Computed) and s.operation in ("multiply", "sum_fields"):
                    null_present.setdefault(s.entity, set()).add(s.dest_field)
                if isinstance(s, Rename):
                    np_ = null_present.get(s.entity, set())
                    if s.from_ in np_:
                        np_.discard(s.from_)
                        np_.add(s.to)
        elif isinstance(s, Split):
            if s.from_ in data:
                whole, by = data[s.from_], order.get(s.from_, ("id",))
                data[s.from_] = whole.drop(*[m for m in s.moved_fields if m in whole.columns])
                data.defer(s.detail, lambda whole=whole, s=s, by=by: split_table(whole, s.moved_fields, s.link_field, by)[1])
        elif isinstance(s, Merge):
            if s.parent in data:
                child = data.get(s.child)
                merged = merge_tables(data[s.parent], child, s.child, s.dropped_link_field,
                                      order.get(s.child, ("id",))) if child is not None else data[s.parent]
                data[s.into] = merged
            data.pop(s.parent, None)
            data.pop(s.child, None)
        elif isinstance(s, ExtractNested):
            if s.entity in data:
                whole, by = data[s.entity], order.get(s.entity, ("id",))
                data[s.entity] = whole.drop(s.field)
                data.defer(s.new_entity, lambda whole=whole, s=s, by=by: extract_items(
                    whole, s.field, s.link_field, blocks.get(s.block), by)[1])
        elif isinstance(s, Partition):
            if s.entity in data:
                frame = data.pop(s.entity)
                data.update(partition_table(frame, s.on_field, s.as_dict, pre_remap.get((s.entity, s.on_field))))
                later = {name for t in log[i + 1:] for name in _touched(t)}
                if routed is not None and not later & set(s.subs):
                    r = routed_union(frame, s.on_field, s.as_dict)
                    routed[s.entity] = (r.drop(*[c for c in r.columns if c.startswith(PRE)]), s.subs)
        elif isinstance(s, Denormalize):
            if s.entity in data:
                via_src = _source_name(log[:i], s.entity, s.via_field)
                via_now = None if _value_changed(log, i, s.entity, s.via_field) else s.via_field
                data[s.entity] = denormalize_table(data[s.entity], originals.get(s.entity), via_src, via_now,
                                                   originals.get(s.from_entity), s.inlined)
                null_present.setdefault(s.entity, set()).update(d for _, d in s.inlined)
    out = LazyTables()
    for t in data:
        out.defer(t, data.later(t, lambda df: df.drop(*[c for c in df.columns if c.startswith(PRE)])))
    return out


def expected_frame(df: DataFrame, entity: str, log: Sequence[Step], split_drop: bool = True) -> DataFrame:
    """Record replay of the row-local steps of ``entity`` (the verifier's expected row).

    Rename, retype, enum remap, unmapped, flatten, split drop and computed, in log order.
    Merge, extract, partition and denormalize are scored elsewhere and not applied.
    """
    null_present: set[str] = set()
    for s in log:
        df = apply_row_step(df, s, entity, split_drop=split_drop, null_present=null_present)
        if isinstance(s, Computed) and s.entity == entity and s.operation in ("multiply", "sum_fields"):
            null_present.add(s.dest_field)
    return df


__all__ = [
    "apply_log", "apply_row_step", "computed_expr", "denormalize_table", "drop_col", "enum_remap_col",
    "expected_frame", "extract_items", "flatten_count", "merge_tables", "partition_table", "rename_col",
    "rename_cols", "retype_col", "route_column", "routed_union", "split_table", "values_equal", "rank_within",
]
