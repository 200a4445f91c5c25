"""Record-level verification of a migration as joins and conditional aggregates.

``checks(...)`` returns one long DataFrame ``(axis, check, entity, step, hits, total)``;
``score_report(...)`` folds it into the five axis ratios and the 0-100 total.

Plan shape (what runs on the cluster):

* per source entity one *located join*: the expected rows (record replay of the row-local
  steps, a fused projection of the source scan) full-outer-joined on ``id`` (plus the
  sub-table for partitioned entities) with the destination rows, deduplicated by id
  (last write wins on ``_seq``).  Coverage, fidelity, unmapped leftovers and reference
  candidates all come from one aggregate over that join;
* reference validity pre-aggregates candidate values by ``(target, value)`` (a hot
  referenced id collapses map-side), then one left join against the union of all valid
  target ids;
* link checks and extract surplus also pre-aggregate by link value before joining;
* count-based, presence and structural checks are single-row aggregates combined by a
  union + group-by (never a cross join);
* type checks are one aggregate per destination table.

Everything is lazy: the long table is small (one row per check item).  A single check is one plan;
for all of them ``store_parts`` runs each aggregate as a job of its own over joins stored once.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import FieldAccess, equal, field_map, id_value, present, select_fields, valid
from ..operators.keys import position_in_group
from ..operators.transforms import LazyTables, expected_frame
from ..sources.storage import side_by_side, stored, written
from ..spec import ALPHA, WEIGHTS, LogContext, Schema, Step, dest_kinds

SEQ = "_seq"
LONG_SCHEMA = "axis string, check string, entity string, step int, kind string, a double, b double, c double, d double, e double"
ENTITY_CHECKS = ("v_cov_recall", "v_cov_false_pos", "v_cov_part_recall", "v_cov_part_false_pos", "v_fid_base",
                 "v_fid_merge", "v_fid_partition", "v_fid_unmapped_left", "v_rel_refs", "v_str_jaccard")
AXES = ("coverage", "field_fidelity", "relationship_integrity", "type_correctness", "structural")


def _f(c: Column) -> Column:
    return c.cast("double")


def _cntx(cond: Column) -> Column:
    return _f(F.count_if(cond))


class Verifier:
    """Scores ``dest`` against ``source`` under ``schema`` + ``log``.

    ``source`` / ``dest``: ``dict[str, DataFrame]`` keyed by entity / table name, ids in
    column ``id``.  A table absent from ``dest`` differs from an empty one.  A dest table
    may carry ``_seq`` (write order); duplicates of an id then resolve to the last write.
    ``null_present`` names extra columns where null counts as a present ``None``.
    """

    def __init__(self, schema: Schema, log: Sequence[Step], source: Mapping[str, DataFrame],
                 dest: Mapping[str, DataFrame], null_present: Mapping[str, Iterable[str]] | None = None,
                 dedupe: bool = True, only: Iterable[str] | None = None):
        self.only = set(only) if only is not None else None
        self.schema = schema
        self.log = tuple(log)
        self.ctx = LogContext(schema, self.log)
        self.source = dict(source)
        # destination tables may be built on demand: only those that a check reads are
        self.dest = dest if isinstance(dest, LazyTables) else dict(dest)
        self.user_np = {k: set(v) for k, v in (null_present or {}).items()}
        self.dedupe = dedupe
        self.kinds = dest_kinds(schema, self.log)
        any_df = next(iter(self.source.values()), None) or next((self.dest[t] for t in self.dest), None)
        self.spark: SparkSession = any_df.sparkSession if any_df is not None else SparkSession.active()
        self._parts: list[DataFrame] = []
        self._pending: dict[int, tuple[DataFrame, list]] = {}
        self._const: list[tuple] = []
        self._ref_cands: list[DataFrame] = []
        self._targets: set[str] = set()
        self._raw: DataFrame | None = None
        self.store_joins = False
        self._narrow: dict[str, DataFrame] = {}
        self._memo_norm: dict[str, DataFrame] = {}
        self._memo_x: dict[tuple, DataFrame] = {}

    # -- helpers ------------------------------------------------------------
    def wants(self, *checks: str) -> bool:
        return self.only is None or any(c in self.only for c in checks)

    def _np_dest(self, table: str) -> set[str]:
        return self.ctx.null_present(table) | self.user_np.get(table, set())

    def _np_expected(self, entity: str) -> set[str]:
        cols = {s.dest_field for s in self.ctx.computeds if s.entity == entity}
        return cols | self.user_np.get(entity, set())

    def _empty_ids(self) -> DataFrame:
        return self.spark.range(0).select(F.col("id").cast("bigint").alias("id"))

    def _src(self, entity: str) -> DataFrame | None:
        return self.source.get(entity)

    def _dest_norm(self, table: str) -> DataFrame:
        """Dest table with a BIGINT-normalised ``id`` (absent table -> no rows, id only)."""
        if table in self._memo_norm:
            return self._memo_norm[table]
        out = self._dest_norm_build(table)
        self._memo_norm[table] = out
        return out

    def _expected(self, entity: str, split_drop: bool = True) -> DataFrame:
        key = (entity, split_drop)
        if key not in self._memo_x:
            self._memo_x[key] = expected_frame(self._src(entity), entity, self.log, split_drop=split_drop)
        return self._memo_x[key]

    def _dest_norm_build(self, table: str) -> DataFrame:
        df = self.dest.get(table)
        if df is None:
            return self._empty_ids()
        fa = field_map(df.schema).get("id")
        idc = id_value(fa)
        drop = [c for c in (fa.physical() if fa else []) if c != "id"]
        return df.drop(*drop).withColumn("id", idc) if drop else df.withColumn("id", idc)

    def _dedup(self, df: DataFrame, keys: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
        """Last write wins per key on ``_seq``; without it a deterministic pick (row hash).

        Only the columns of ``keep`` (all unless given) are carried along; all of them make the pick."""
        if not self.dedupe:
            return df
        whole = [c for c in df.columns if c not in keys]
        rest = whole if keep is None else [c for c in whole if c in keep]
        if not rest:
            return df.select(*keys).dropDuplicates(list(keys)) if whole else df.dropDuplicates(list(keys))
        packed = F.struct(*[F.col(c) for c in rest])
        order = F.col(SEQ) if SEQ in df.columns else F.xxhash64(*[F.col(c) for c in whole])
        agg = df.groupBy(*keys).agg(F.max_by(packed, order).alias("__mg_row"))
        return agg.select(*keys, *[F.col(f"__mg_row.`{c}`").alias(c) for c in rest])

    def _emit(self, df: DataFrame) -> None:
        self._parts.append(df.select(
            F.col("axis").cast("string"), F.col("check").cast("string"), F.col("entity").cast("string"),
            F.col("step").cast("int"), F.col("kind").cast("string"),
            *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in "abcde"]))

    def _row(self, base: DataFrame | None, axis: str, check: str, entity: str, step: int | None, kind: str,
             **vals: Column | float) -> None:
        """Queue one check row: aggregates ``vals`` over ``base`` (plain numbers when base is None).

        Rows queued on the same frame are computed by one aggregate (one scan) in ``_flush``.
        """
        if not self.wants(check):
            return
        meta = (axis, check, entity, step, kind)
        if base is None:
            self._const.append((*meta, *(float(vals.get(x, 0.0)) for x in "abcde")))
            return
        key = id(base)
        if key not in self._pending:
            self._pending[key] = (base, [])
        self._pending[key][1].append((meta, vals))

    def _flush(self) -> None:
        def q(v) -> str:
            return "NULL" if v is None else ("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v))
        for base, rows in self._pending.values():
            aggs, structs = [], []
            for i, (meta, vals) in enumerate(rows):
                fields = [f"'axis', {q(meta[0])}", f"'check', {q(meta[1])}", f"'entity', {q(meta[2])}",
                          f"'step', CAST({q(meta[3])} AS INT)", f"'kind', {q(meta[4])}"]
                for x in "abcde":
                    if x in vals:
                        aggs.append(vals[x].cast("double").alias(f"__m{i}{x}"))
                        fields.append(f"'{x}', __m{i}{x}")
                    else:
                        fields.append(f"'{x}', CAST(0.0 AS DOUBLE)")
                structs.append("named_struct(" + ", ".join(fields) + ")")
            agg = base.agg(*aggs)
            self._parts.append(agg.select(F.expr("inline(array(" + ", ".join(structs) + "))")))
        self._pending = {}
        if self._const:
            self._parts.append(self.spark.createDataFrame(self._const, LONG_SCHEMA))
            self._const = []

    def _count_row(self, df: DataFrame | None, axis: str, check: str, entity: str, step: int | None, kind: str,
                   slot: str) -> None:
        if df is None:
            return
        self._row(df, axis, check, entity, step, kind, **{slot: F.count(F.lit(1))})

    @staticmethod
    def _has(df: DataFrame, name: str, np_: set[str]) -> Column:
        """Key ``name`` present in a row of a destination frame (typed columns or record bag)."""
        return present(field_map(df.schema).get(name), name in np_)

    # -- located join --------------------------------------------------------
    def _dest_union(self, tables: Sequence[str]) -> tuple[DataFrame, dict[str, FieldAccess]]:
        """Union of sub-tables tagged with ``__mg_sub``.

        A field typed differently in two sub-tables is kept as one column per type (so a
        text value is never silently cast to a number by the union); present-``None`` flags
        are carried along.
        """
        frames = [(t, self._dest_norm(t), field_map(self._dest_norm(t).schema)) for t in tables]
        types: dict[str, list[T.DataType]] = {}
        has_none: set[str] = set()
        for _, _, fm in frames:
            for name, fa in fm.items():
                lst = types.setdefault(name, [])
                for _, dt in fa.vars:
                    if dt not in lst:
                        lst.append(dt)
                if fa.none:
                    has_none.add(name)
        layout: dict[str, FieldAccess] = {}
        for name, lst in types.items():
            vs = [(name, lst[0])] if len(lst) == 1 or name == "id" else \
                [(f"{name}__mgt{k}", dt) for k, dt in enumerate(lst)]
            layout[name] = FieldAccess(vs, f"{name}__mgnone" if name in has_none else None)
        out = []
        for t, fr, fm in frames:
            cols = [F.lit(t).alias("__mg_sub")]
            for name, fa in layout.items():
                src = fm.get(name)
                for phys, dt in fa.vars:
                    match = [p for p, sdt in (src.vars if src else []) if sdt == dt or len(fa.vars) == 1]
                    cols.append((F.col(f"`{match[0]}`").cast(dt) if match else F.lit(None).cast(dt)).alias(phys))
                if fa.none:
                    cols.append((F.col(f"`{src.none}`") if src and src.none else F.lit(False)).alias(fa.none))
            out.append(fr.select(*cols))
        return reduce(lambda a, b: a.union(b), out), layout

    def _located(self, entity: str):
        """Expected rows of ``entity`` full-outer-joined with the dest rows they should land in."""
        ctx = self.ctx
        src = self._src(entity)
        refs = self.schema.refs(entity)
        # raw ref values come straight from the source row
        raw = {f"__mg_raw{i}": fname for i, (fname, _) in enumerate(refs) if fname in src.columns}
        x = expected_frame(src.select(*[F.col(f"`{c}`") for c in src.columns],
                                      *[F.col(f"`{f}`").alias(r) for r, f in raw.items()]), entity, self.log)
        part = ctx.partition_of.get(entity)
        if entity in ctx.merge_parents:
            tables = [ctx.merge_parents[entity]]
        elif part is not None:
            tables = part.subs
        else:
            tables = [entity]
        if part is not None:
            from ..operators.transforms import route_column
            x = x.withColumn("__mg_sub", route_column(x, part.on_field, part.as_dict))
            d, layout = self._dest_union(tables)
            d = self._dedup(d, ["__mg_sub", "id"])
        else:
            d = self._dedup(self._dest_norm(tables[0]), ["id"])
            layout = field_map(d.schema)
        xs = x.select(*[F.col(f"`{c}`").alias(f"x__{c}") for c in x.columns], F.lit(True).alias("__x"))
        ds = d.select(*[F.col(f"`{c}`").alias(f"d__{c}") for c in d.columns], F.lit(True).alias("__d"))
        cond = xs["x__id"] == ds["d__id"]
        if part is not None:
            cond = cond & (xs["x____mg_sub"] == ds["d____mg_sub"])
        j = xs.join(ds, cond, "full_outer")
        dvars = {c: FieldAccess([(f"d__{p}", dt) for p, dt in fa.vars], f"d__{fa.none}" if fa.none else None)
                 for c, fa in layout.items() if not c.startswith("__mg_")}
        return j, x, dvars, tables, part, raw

    @staticmethod
    def _dpresent(dvars: dict[str, FieldAccess], name: str, np_: set[str], flag: Column) -> Column:
        return flag & present(dvars.get(name), name in np_)

    @staticmethod
    def _deq(dvars: dict[str, FieldAccess], name: str, xv: Column, xt: T.DataType) -> Column:
        return equal(dvars.get(name), xv, xt)

    def _entity_checks(self, entity: str) -> None:
        ctx = self.ctx
        if not self.wants(*ENTITY_CHECKS):
            return
        if self._src(entity) is None:
            # no source rows: every distinct destination id of a kept entity is a false positive
            if entity not in ctx.removed and entity in self.dest:
                ids = self._dest_norm(entity).select("id").distinct()
                self._row(ids, "coverage", "v_cov_false_pos", entity, None, "ratio", b=_f(F.count(F.lit(1))))
            return
        j, x, dvars, tables, part, raw = self._located(entity)
        X = F.coalesce(F.col("__x"), F.lit(False))
        D = F.coalesce(F.col("__d"), F.lit(False))
        xcols = [c for c in x.columns if not c.startswith("__mg_")]
        np_x = self._np_expected(entity)
        np_d = set().union(*[self._np_dest(t) for t in tables])
        is_merge_parent = entity in ctx.merge_parents
        is_base = entity not in ctx.removed
        i1 = lambda c: F.when(c, 1).otherwise(0)
        per: dict[str, Column] = {}

        if is_base or part is not None:
            per["rec_t"] = i1(X)
            per["rec_h"] = i1(X & D)
            per["fp"] = i1(D & ~X)
        scope = X if part is None else X & F.col("x____mg_sub").isNotNull()
        if is_base or is_merge_parent or part is not None:
            fields = [c for c in xcols if not (part is not None and c == part.on_field)]
            tot, hit = [i1(scope & ~D)], [F.lit(0)]
            for fcol in fields:
                px = F.lit(True) if fcol in np_x else F.col(f"x__{fcol}").isNotNull()
                both = scope & D & px & self._dpresent(dvars, fcol, np_d, F.lit(True))
                tot.append(i1(both))
                if fcol in dvars:
                    hit.append(i1(both & self._deq(dvars, fcol, F.col(f"x__{fcol}"), x.schema[fcol].dataType)))
            per["fid_t"] = reduce(lambda a, b: a + b, tot)
            per["fid_h"] = reduce(lambda a, b: a + b, hit)
            if is_base and ctx.unmapped_fields(entity):
                per["unm_t"] = reduce(lambda a, b: a + b, [
                    i1(X & D & self._dpresent(dvars, u, np_d, F.lit(True))) for u in ctx.unmapped_fields(entity)])

        refs = self.schema.refs(entity)
        cands = []
        if refs:
            per["rel_t"] = i1(X) * F.lit(len(refs))
            for i, (fname, target) in enumerate(refs):
                dname = ctx.dest_field_name(entity, fname)
                self._targets.add(target)
                if f"__mg_raw{i}" in raw and dname in dvars:
                    rawc = F.col(f"x____mg_raw{i}")
                    ok = X & D & self._dpresent(dvars, dname, np_d, F.lit(True)) & self._deq(
                        dvars, dname, rawc, x.schema[f"__mg_raw{i}"].dataType)
                    cands.append(F.when(ok, F.struct(F.lit(target).alias("target"),
                                                     rawc.cast("bigint").alias("value"))))
        # the few narrow columns the aggregates below read; stored first if several of them would repeat the join
        jr = j.select(*[v.alias(k) for k, v in per.items()], *(self._id_columns() if part is not None else []),
                      *([F.filter(F.array(*cands), lambda c: c.isNotNull()).alias("cands")] if cands else []))
        if self.store_joins and (cands or part is not None):
            jr = self._narrow[entity] = stored(jr, "located")
        if part is not None:
            by_id = self._id_sets(jr)
        if per:
            S = lambda k: F.coalesce(F.sum(k), F.lit(0))
            if "rec_t" in per:
                rc = "v_cov_recall" if part is None else "v_cov_part_recall"
                fc = "v_cov_false_pos" if part is None else "v_cov_part_false_pos"
                self._row(jr, "coverage", rc, entity, None, "ratio", a=S("rec_h"), b=S("rec_t"))
                self._row(jr, "coverage", fc, entity, None, "ratio", b=S("fp"))
            if "fid_t" in per:
                fc = "v_fid_base" if is_base else ("v_fid_merge" if is_merge_parent else "v_fid_partition")
                self._row(jr, "field_fidelity", fc, entity, None, "ratio", a=S("fid_h"), b=S("fid_t"))
            if "unm_t" in per:
                self._row(jr, "field_fidelity", "v_fid_unmapped_left", entity, None, "ratio", b=S("unm_t"))
            if "rel_t" in per:
                self._row(jr, "relationship_integrity", "v_rel_refs", entity, None, "ratio", b=S("rel_t"))
            if part is not None:
                step = self.log.index(part)
                for s_ in part.subs:
                    at = F.col("sub") == s_
                    cnt = lambda c: F.coalesce(F.sum(F.when(at & c, 1).otherwise(0)), F.lit(0))
                    self._row(by_id, "structural", "v_str_jaccard", s_, step, "jaccard", a=cnt(F.col("x") & F.col("d")),
                              b=cnt(F.col("x") | F.col("d")), c=cnt(F.col("x")), d=cnt(F.col("d")))
        if cands:
            c = jr.select(F.explode("cands").alias("c"))
            c = c.groupBy(F.col("c.target").alias("target"), F.col("c.value").alias("value")).agg(
                F.count(F.lit(1)).alias("n"))
            self._ref_cands.append(c.withColumn("entity", F.lit(entity)))

    def located_rows(self, entity: str) -> DataFrame:
        """The rows of a partitioned entity's located join, narrow and stored: ``_id_columns``, ``fid_t``, ``fid_h`` and, if it
        has references, ``cands``.  Those that ``store_parts`` stored are used again."""
        if entity not in self._narrow:
            v = Verifier(self.schema, self.log, self.source, self.dest, self.user_np, self.dedupe)
            v.store_joins = True
            v._entity_checks(entity)
            self._narrow[entity] = v._narrow[entity]
        return self._narrow[entity]

    @staticmethod
    def _id_columns() -> list[Column]:
        """(sub, id, x, d) of a row of a partitioned entity's located join: is it expected (x), is it written (d)."""
        return [F.coalesce(F.col("x____mg_sub"), F.col("d____mg_sub")).alias("sub"),
                F.coalesce(F.col("x__id"), F.col("d__id")).alias("id"),
                F.coalesce(F.col("__x"), F.lit(False)).alias("x"), F.coalesce(F.col("__d"), F.lit(False)).alias("d")]

    @staticmethod
    def _id_sets(rows: DataFrame) -> DataFrame:
        """The distinct ids per sub-table of rows with ``_id_columns``."""
        return rows.groupBy("sub", "id").agg(F.max("x").alias("x"), F.max("d").alias("d"))

    # -- target ids ----------------------------------------------------------
    def target_ids(self, targets: Iterable[str]) -> DataFrame:
        """Distinct (target, id) where a target's ids live in the destination."""
        frames = []
        for t in sorted(set(targets)):
            for table in self.ctx.id_tables(t):
                if table in self.dest:
                    frames.append(self._dest_norm(table).select(F.lit(t).alias("target"), F.col("id")))
        if not frames:
            return self.spark.createDataFrame([], "target string, id bigint")
        return reduce(lambda a, b: a.unionByName(b), frames).filter(F.col("id").isNotNull()).distinct()

    def _link_valid(self, rows: DataFrame, link: str, target: str, check: str, entity: str, step: int) -> None:
        """+1 per row, hit when the link value is an id of ``target`` (pre-aggregated by value)."""
        if not self.wants(check):
            return
        vals = rows.select(id_value(field_map(rows.schema).get(link)).alias("value"))
        per = vals.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        ids = self.target_ids([target]).select(F.col("id").alias("__tid"))
        hit = per.join(ids, per["value"] == ids["__tid"], "left")
        self._row(hit, "relationship_integrity", check, entity, step, "ratio",
                  a=_f(F.coalesce(F.sum(F.when(F.col("__tid").isNotNull(), F.col("n"))), F.lit(0))),
                  b=_f(F.coalesce(F.sum("n"), F.lit(0))))

    # -- step checks -----------------------------------------------------------
    def _rows_of(self, tables: Sequence[str] | None) -> list[DataFrame]:
        return [self.dest[t] for t in (tables or []) if t in self.dest]

    def _count_rows(self, frames: Sequence[DataFrame], check, axis, entity, step, kind, slot) -> None:
        for fr in frames:
            self._count_row(fr, axis, check, entity, step, kind, slot)

    def _relocated_present(self, entity: str) -> list[DataFrame]:
        out = []
        for m in self.ctx.merges:
            if entity in (m.parent, m.child) and m.into in self.dest:
                out.append(self.dest[m.into])
        p = self.ctx.partition_of.get(entity)
        if p is not None:
            out += [self.dest[s] for s in p.subs if s in self.dest]
        return out

    def _step_checks(self) -> None:
        ctx = self.ctx
        reads = {"split": ("v_cov_split", "v_str_presence", "v_fid_split", "v_rel_split_link"),
                 "extract_nested": ("v_cov_extract", "v_str_presence", "v_fid_extract", "v_fid_extract_extra", "v_rel_extract_link")}
        for i, s in enumerate(self.log):
            tp = s.type
            if tp in reads and not self.wants(*reads[tp]):
                continue  # its tables may not even be built yet
            if tp == "merge":
                src = self._src(s.parent)
                self._count_row(src, "coverage", "v_cov_merge", s.into, i, "least", "a")
                self._count_rows(self._rows_of([s.into]), "v_cov_merge", "coverage", s.into, i, "least", "b")
                self._count_row(src, "structural", "v_str_presence", s.into, i, "presence", "a")
                self._count_rows(self._rows_of([s.into]), "v_str_presence", "structural", s.into, i, "presence", "b")
                if src is None:
                    self._row(None, "structural", "v_str_presence", s.into, i, "presence")
            elif tp == "split":
                src = self._src(s.from_)
                loc = ctx.tables_of(s.detail, self.dest.keys())
                self._count_row(src, "coverage", "v_cov_split", s.detail, i, "least", "a")
                self._count_rows(self._rows_of(loc), "v_cov_split", "coverage", s.detail, i, "least", "b")
                self._count_row(src, "structural", "v_str_presence", s.detail, i, "presence", "a")
                self._count_rows(self._rows_of(loc), "v_str_presence", "structural", s.detail, i, "presence", "b")
                if src is None:
                    self._row(None, "structural", "v_str_presence", s.detail, i, "presence")
                self._split_fidelity(s, i)
                self._link_valid(self.dest[s.detail] if s.detail in self.dest else self._empty_ids().select(
                    F.col("id").alias(s.link_field)), s.link_field, s.from_, "v_rel_split_link", s.detail, i)
            elif tp == "extract_nested":
                self._extract_checks(s, i)
            elif tp == "flatten_nested":
                self._flatten_check(s, i)
            elif tp == "unmapped":
                self._unmapped_check(s, i)
            elif tp == "denormalize":
                self._denorm_checks(s, i)
            elif tp == "computed":
                self._computed_check(s, i)

    def _split_fidelity(self, s, i: int) -> None:
        src = self._src(s.from_)
        if src is None or not self.wants("v_fid_split"):
            return
        moved = [m for m in s.moved_fields if m in self.kinds.get(s.detail, {})]
        post = self._expected(s.from_, split_drop=False)
        post = post.select("id", *[m for m in moved if m in post.columns])
        n_moved = len(moved)
        if s.detail not in self.dest or s.link_field not in field_map(self.dest[s.detail].schema):
            self._row(post, "field_fidelity", "v_fid_split", s.detail, i, "ratio",
                      b=_f(F.count(F.lit(1)) * F.lit(n_moved)))
            return
        det = self.dest[s.detail]
        fm = field_map(det.schema)
        det = det.select(id_value(fm[s.link_field]).alias("__link"),
                         *select_fields(fm, moved, ""), *([F.col(SEQ)] if SEQ in det.columns else []))
        det = self._dedup(det, ["__link"])
        np_d = self._np_dest(s.detail)
        ps = post.select(F.col("id").alias("__pid"), *[F.col(m).alias(f"x__{m}") for m in moved if m in post.columns])
        ds = det.select(F.col("__link"), F.lit(True).alias("__d"),
                        *[F.col(f"`{c}`").alias(f"d__{c}") for c in det.columns if c not in ("__link", SEQ)])
        j = ps.join(ds, ps["__pid"] == ds["__link"], "left")
        D = F.coalesce(F.col("__d"), F.lit(False))
        hits = [F.lit(0.0)]
        for m in moved:
            if m in fm:
                xv = F.col(f"x__{m}") if m in post.columns else F.lit(None)
                xt = post.schema[m].dataType if m in post.columns else T.NullType()
                hits.append(_cntx(D & present(fm[m], m in np_d, "d__") & equal(fm[m], xv, xt, "d__")))
        self._row(j, "field_fidelity", "v_fid_split", s.detail, i, "ratio",
                  a=reduce(lambda a, b: a + b, hits), b=_f(F.count(F.lit(1)) * F.lit(n_moved)))

    def _extract_checks(self, s, i: int) -> None:
        src = self._src(s.entity)
        has_arr = src is not None and s.field in src.columns and isinstance(src.schema[s.field].dataType, T.ArrayType)
        new = self.dest.get(s.new_entity)
        # coverage (count based) and presence
        if has_arr:
            sizes = src.select(F.coalesce(F.size(s.field), F.lit(0)).alias("n"))
            self._row(sizes, "coverage", "v_cov_extract", s.new_entity, i, "least", a=_f(F.sum("n")))
            self._row(sizes, "structural", "v_str_presence", s.new_entity, i, "presence", a=_f(F.sum("n")))
        else:
            self._row(None, "coverage", "v_cov_extract", s.new_entity, i, "least")
            self._row(None, "structural", "v_str_presence", s.new_entity, i, "presence")
        if new is not None:
            self._count_row(new, "coverage", "v_cov_extract", s.new_entity, i, "least", "b")
            self._count_row(new, "structural", "v_str_presence", s.new_entity, i, "presence", "b")
        # link validity
        self._link_valid(new if new is not None else self._empty_ids().select(F.col("id").alias(s.link_field)),
                         s.link_field, s.entity, "v_rel_extract_link", s.new_entity, i)
        # fidelity by position
        if src is None or not self.wants("v_fid_extract", "v_fid_extract_extra"):
            return
        bfs = list(self.schema.blocks.get(s.block, {}))
        if has_arr:
            et = src.schema[s.field].dataType.elementType
            item_fields = {f.name: f.dataType for f in et.fields} if isinstance(et, T.StructType) else {}
            items = src.select(F.col("id").alias("__pid"), F.posexplode(s.field).alias("__pos", "__item"))
            items = items.select("__pid", "__pos", *[
                (F.col(f"__item.`{b}`") if b in item_fields else F.lit(None)).alias(f"x__{b}") for b in bfs])
            xtypes = {b: item_fields.get(b, T.NullType()) for b in bfs}
            sizes = src.select(F.col("id").alias("__pid"), F.coalesce(F.size(s.field), F.lit(0)).alias("__n"))
        else:
            items = None
            xtypes = {}
            sizes = src.select(F.col("id").alias("__pid"), F.lit(0).alias("__n"))
        nfm = field_map(new.schema) if new is not None else {}
        if new is not None and s.link_field in nfm:
            order = [SEQ] if SEQ in new.columns else ["__mg_oid"]
            nn = new.select(id_value(nfm[s.link_field]).alias("__link"),
                            (F.col(SEQ) if SEQ in new.columns else id_value(nfm.get("id"))).alias(order[0]),
                            *select_fields(nfm, bfs, "d__"))
            numbered = position_in_group(nn, "__link", order, "__pos")
            dsel = numbered.select(F.col("__link"), F.col("__pos").alias("__dpos"), F.lit(True).alias("__d"),
                                   *[F.col(f"`{c}`") for c in nn.columns if c.startswith("d__")])
        else:
            dsel = None
        if items is not None:
            if dsel is not None:
                j = items.join(dsel, (items["__pid"] == dsel["__link"]) & (items["__pos"] == dsel["__dpos"]), "left")
            else:
                j = items.withColumn("__d", F.lit(None).cast("boolean"))
            D = F.coalesce(F.col("__d"), F.lit(False))
            hits = [F.lit(0.0)]
            for b in bfs:
                hits.append(_cntx(D & equal(nfm.get(b), F.col(f"x__{b}"), xtypes[b], "d__")))
            self._row(j, "field_fidelity", "v_fid_extract", s.new_entity, i, "ratio",
                      a=reduce(lambda a, b: a + b, hits), b=_f(F.count(F.lit(1)) * F.lit(len(bfs))))
        # surplus rows per known parent
        if new is not None and s.link_field in nfm:
            per = new.select(id_value(nfm[s.link_field]).alias("__link")) \
                .groupBy("__link").agg(F.count(F.lit(1)).alias("__cnt"))
            sj = sizes.join(per, sizes["__pid"] == per["__link"], "inner")
            self._row(sj, "field_fidelity", "v_fid_extract_extra", s.new_entity, i, "ratio",
                      b=_f(F.coalesce(F.sum(F.greatest(F.col("__cnt") - F.col("__n"), F.lit(0))), F.lit(0))))

    def _share(self, frames: Sequence[DataFrame], cond_for, check: str, entity: str, i: int, kind: str,
               num: str = "a", den: str = "b") -> None:
        for fr in frames:
            self._row(fr, "structural", check, entity, i, kind, **{num: _cntx(cond_for(fr)), den: _f(F.count(F.lit(1)))})

    def _flatten_check(self, s, i: int) -> None:
        ctx = self.ctx
        ent = s.entity
        if ent in self.dest:
            host = next(iter(ctx.hosts(ent, s.into)), None)
            parent = self.dest[ent]
            np_p = self._np_dest(ent)
            absent = (lambda fr: ~self._has(fr, s.field, np_p))
            self._share([parent], absent, "v_str_flatten", ent, i, "flatten", "c", "d")
            if host is None:
                # the log itself takes the count away again: nothing to find, so it counts as found
                self._row(None, "structural", "v_str_flatten", ent, i, "flatten", e=1.0)
            elif host in self.dest:
                np_h = self._np_dest(host)
                self._share([self.dest[host]], lambda fr: self._has(fr, s.into, np_h),
                            "v_str_flatten", ent, i, "flatten", "a", "b")
            else:
                self._row(None, "structural", "v_str_flatten", ent, i, "flatten")
        else:
            frames = self._relocated_present(ent)
            if frames:
                for fr in frames:
                    self._row(fr, "structural", "v_str_flatten", ent, i, "relocated", a=_f(F.count(F.lit(1))))
            else:
                self._row(None, "structural", "v_str_flatten", ent, i, "relocated")

    def _unmapped_check(self, s, i: int) -> None:
        ent = s.entity
        if ent in self.dest:
            np_ = self._np_dest(ent)
            self._share([self.dest[ent]], lambda fr: ~self._has(fr, s.field, np_),
                        "v_str_unmapped", ent, i, "share")
        else:
            frames = self._relocated_present(ent)
            for fr in frames:
                self._row(fr, "structural", "v_str_unmapped", ent, i, "relocated", a=_f(F.count(F.lit(1))))
            if not frames:
                self._row(None, "structural", "v_str_unmapped", ent, i, "relocated")

    def _denorm_checks(self, s, i: int) -> None:
        ent = s.entity
        dst = self.dest.get(ent)
        np_ = self._np_dest(ent)
        for k, (_, dfield) in enumerate(s.inlined):
            if dst is not None:
                self._row(dst, "structural", "v_str_denorm", f"{ent}.{dfield}", i, "share",
                          a=_cntx(self._has(dst, dfield, np_)),
                          b=_f(F.count(F.lit(1))))
            else:
                self._row(None, "structural", "v_str_denorm", f"{ent}.{dfield}", i, "share")
        # fidelity: dest value equals a fresh lookup in the original source
        src, frm = self._src(ent), self._src(s.from_entity)
        if src is None or dst is None or not self.wants("v_fid_denorm"):
            return
        via = self.ctx.source_field_name(ent, s.via_field)
        d1 = self._dest_norm(ent)
        dfm = field_map(d1.schema)
        d1 = self._dedup(d1, ["id"], [p for _, d in s.inlined if d in dfm for p in dfm[d].physical()])
        ds = d1.select(F.col("id").alias("__did"), *select_fields(dfm, [d for _, d in s.inlined], "d__"))
        ss = src.select(F.col("id").alias("__sid"),
                        (F.col(via) if via in src.columns else F.lit(None)).cast("bigint").alias("__via"))
        j = ss.join(ds, ss["__sid"] == ds["__did"], "inner")
        if frm is not None:
            fr = self._dedup(frm.select("id", *[c for c in {sf for sf, _ in s.inlined} if c in frm.columns]
                                        + ([SEQ] if SEQ in frm.columns else [])), ["id"])
            fs = fr.select(F.col("id").alias("__fid"), *[F.col(c).alias(f"f__{c}") for c in fr.columns if c != "id"])
            j = j.join(fs, j["__via"] == fs["__fid"], "left")
            ftypes = {c: fr.schema[c].dataType for c in fr.columns}
        else:
            ftypes = {}
        hits = [F.lit(0.0)]
        for sf, dfield in s.inlined:
            fv = F.col(f"f__{sf}") if sf in ftypes else F.lit(None)
            ft = ftypes.get(sf, T.NullType())
            hits.append(_cntx(equal(dfm.get(dfield), fv, ft, "d__")))
        self._row(j, "field_fidelity", "v_fid_denorm", ent, i, "ratio",
                  a=reduce(lambda a, b: a + b, hits), b=_f(F.count(F.lit(1)) * F.lit(len(s.inlined))))

    def _computed_check(self, s, i: int) -> None:
        if not self.wants("v_str_computed"):
            return
        ent = s.entity
        dst = self.dest.get(ent)
        src = self._src(ent)
        if dst is None or src is None:
            self._row(None, "structural", "v_str_computed", ent, i, "computed")
            return
        x = expected_frame(self._dedup(src, ["id"]) if SEQ in src.columns else src, ent, self.log)
        xv = F.col(s.dest_field) if s.dest_field in x.columns else F.lit(None)
        xt = x.schema[s.dest_field].dataType if s.dest_field in x.columns else T.NullType()
        xs = x.select(F.col("id").alias("__sid"), xv.alias("__xv"))
        dn = self._dest_norm(ent)
        np_ = self._np_dest(ent)
        dfm = field_map(dn.schema)
        fa = dfm.get(s.dest_field)
        ds = dn.select(F.col("id").alias("__did"), *select_fields(dfm, [s.dest_field], "d__"), F.lit(True).alias("__d"))
        j = ds.join(xs, ds["__did"] == xs["__sid"], "left")
        matched = F.col("__sid").isNotNull()
        pd_ = present(fa, s.dest_field in np_, "d__")
        self._row(j, "structural", "v_str_computed", ent, i, "computed",
                  a=_cntx(matched & pd_ & equal(fa, F.col("__xv"), xt, "d__")),
                  b=_cntx(matched), c=_f(F.count(F.lit(1))))

    def _type_checks(self) -> None:
        if not self.wants("v_type"):
            return
        for table, kmap in self.kinds.items():
            df = self.dest.get(table)
            if df is None:
                continue
            np_ = self._np_dest(table)
            fm = field_map(df.schema)
            tot, hit = [F.lit(0.0)], [F.lit(0.0)]
            for fcol, kind in kmap.items():
                if kind == "nested" or fcol not in fm:
                    continue
                p = present(fm[fcol], fcol in np_)
                tot.append(_cntx(p))
                hit.append(_cntx(p & valid(fm[fcol], kind)))
            self._row(df, "type_correctness", "v_type", table, None, "ratio",
                      a=reduce(lambda a, b: a + b, hit), b=reduce(lambda a, b: a + b, tot))

    def _ref_hits(self) -> None:
        if not self._ref_cands or not self.wants("v_rel_refs"):
            return
        cands = reduce(lambda a, b: a.unionByName(b), self._ref_cands)
        ids = self.target_ids(self._targets).select(F.col("target").alias("__t"), F.col("id").alias("__tid"))
        j = cands.join(ids, (cands["target"] == ids["__t"]) & (cands["value"] == ids["__tid"]), "left")
        hits = j.groupBy("entity").agg(
            _f(F.coalesce(F.sum(F.when(F.col("__tid").isNotNull(), F.col("n"))), F.lit(0))).alias("a"))
        self._emit(hits.select(F.lit("relationship_integrity").alias("axis"), F.lit("v_rel_refs").alias("check"),
                               "entity", F.lit(None).cast("int").alias("step"), F.lit("ratio").alias("kind"),
                               "a", F.lit(0.0).alias("b"), *[F.lit(0.0).alias(z) for z in "cde"]))

    # -- public ------------------------------------------------------------------
    def _build_parts(self) -> list[DataFrame]:
        if not self._parts:
            for ename in self.schema.entities:
                if ename in self.ctx.merge_children:
                    continue
                self._entity_checks(ename)
            self._step_checks()
            self._type_checks()
            self._ref_hits()
            self._flush()
        return self._parts

    def raw_parts(self) -> DataFrame:
        if self._raw is None:
            self._raw = union_all(self.spark, self._build_parts(), LONG_SCHEMA)
        return self._raw

    def store_parts(self, workers: int = 8) -> "Verifier":
        """Evaluate all checks now: each join once, each aggregate as a small job of its own, several at a time.

        ``checks`` and ``report`` then read the few rows these gave.  One plan of all checks re-plans itself as a
        whole after every stage, and repeats a located join for every aggregate over it.
        """
        if self._raw is None:
            self.store_joins = True
            parts = [p.coalesce(1) for p in self._build_parts()]
            paths = side_by_side(lambda p: written(p, "check"), parts, workers)
            self._raw = self.spark.read.schema(LONG_SCHEMA).parquet(*paths) if paths else union_all(self.spark, [], LONG_SCHEMA)
        return self

    def checks(self) -> DataFrame:
        """Long table ``(axis, check, entity, step, hits, total)``, one row per check item."""
        parts = self.raw_parts()
        g = parts.groupBy("axis", "check", "entity", "step", "kind").agg(*[F.sum(x).alias(x) for x in "abcde"])
        a, b, c, d, e = (F.col(x) for x in "abcde")
        kind = F.col("kind")
        hits = (F.when(kind == "least", F.least(a, b))
                .when(kind == "presence", F.when((a == 0) | (b > 0), 1.0).otherwise(0.0))
                .when(kind == "jaccard", F.when(c == 0, F.when(d == 0, 1.0).otherwise(0.0))
                      .otherwise(F.when(b > 0, a / b).otherwise(1.0)))
                .when(kind == "flatten", F.when(d > 0, (F.when(e > 0, 1.0).when(b > 0, a / b).otherwise(0.0)
                                                        + c / d) * 0.5).otherwise(0.0))
                .when(kind == "relocated", F.when(a > 0, 1.0).otherwise(0.0))
                .when(kind == "share", F.when(b > 0, a / b).otherwise(0.0))
                .when(kind == "computed", F.when((c > 0) & (b > 0), a / b).otherwise(0.0))
                .otherwise(a))
        total = F.when(kind.isin("least", "ratio"), F.when(kind == "least", a).otherwise(b)).otherwise(F.lit(1.0))
        return g.select("axis", "check", "entity", "step", hits.alias("hits"), total.alias("total"))

    def report(self) -> DataFrame:
        return score_report(self.checks(), self.ctx.has_structural)


def union_all(spark: SparkSession, parts: Sequence[DataFrame], empty_schema: str) -> DataFrame:
    """UNION ALL of many same-shaped frames, as a balanced tree (a chain is analysed anew at every step)."""
    if not parts:
        return spark.createDataFrame([], empty_schema)
    parts = list(parts)
    while len(parts) > 1:
        parts = [parts[i].unionAll(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def score_report(checks: DataFrame, has_structural: bool) -> DataFrame:
    """V6: one row with the axis ratios (empty axis -> 1.0) and the 0-100 total."""
    sums = checks.groupBy().agg(*[
        F.sum(F.when(F.col("axis") == ax, F.col(col_))).alias(f"{ax}__{col_}") for ax in AXES for col_ in ("hits", "total")
    ])
    ratio = {ax: F.when(F.coalesce(F.col(f"{ax}__total"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(
        F.col(f"{ax}__hits") / F.col(f"{ax}__total")) for ax in AXES}
    base = sum((ratio[ax] * F.lit(w) for ax, w in WEIGHTS.items()), F.lit(0.0))
    mult = (F.lit(ALPHA) + F.lit(1.0 - ALPHA) * ratio["structural"]) if has_structural else F.lit(1.0)
    cols = [ratio[ax].alias(ax) for ax in AXES[:4]]
    cols.append((ratio["structural"] if has_structural else F.lit(None).cast("double")).alias("structural"))
    cols.append((base * mult * F.lit(100.0)).alias("total"))
    return sums.select(*cols)


def verify(schema: Schema, log: Sequence[Step], source: Mapping[str, DataFrame], dest: Mapping[str, DataFrame],
           **kw) -> DataFrame:
    """Score report of a migration (one row)."""
    return Verifier(schema, log, source, dest, **kw).report()


def grade(schema: Schema, log: Sequence[Step], source: Mapping[str, DataFrame], dest: Mapping[str, DataFrame],
          **kw) -> dict:
    """Score report collected as a dict (the one-row result is the only thing collected)."""
    row = verify(schema, log, source, dest, **kw).first()
    out = row.asDict()
    if out.get("structural") is None:
        out.pop("structural", None)
    return out


def strict_report(v: Verifier) -> DataFrame:
    """Blind spots of the score, listed instead of silently scored (one row per finding).

    * ``merged_child_mismatch``  - merged child values differing from the first child's row
    * ``array_left_after_extract`` - parent rows still carrying an extracted array
    * ``duplicate_ids``          - surplus rows of an id in a destination table
    * ``expected_column_missing``- rows of a table lacking a column the log expects
    * ``enum_out_of_domain``     - present enum values outside the destination domain
    """
    from ..operators.keys import first_per_key
    from ..spec import dest_schema, merged_column_name

    spark, ctx, parts = v.spark, v.ctx, []

    def row(df: DataFrame, issue: str, table: str, column: str, n: Column) -> None:
        parts.append(df.agg(n.cast("bigint").alias("n_rows")).select(
            F.lit(issue).alias("issue"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
            "n_rows"))

    for m in ctx.merges:
        child, parent, merged = v._src(m.child), v._src(m.parent), v.dest.get(m.into)
        if child is None or parent is None or merged is None or m.dropped_link_field not in child.columns:
            continue
        cx = expected_frame(child, m.child, v.log)
        px = v._expected(m.parent)
        fields = [c for c in cx.columns if c not in ("id", m.dropped_link_field)]
        names, taken = {}, list(px.columns)
        for c in fields:
            names[c] = merged_column_name(c, taken, m.child)
            taken.append(names[c])
        first = first_per_key(cx.select(m.dropped_link_field, "id", *fields), m.dropped_link_field, ["id"])
        dfm = field_map(merged.schema)
        mm = merged.select(id_value(dfm.get("id")).alias("__mid"), *select_fields(dfm, names.values(), "d__"))
        j = first.join(mm, first[m.dropped_link_field] == mm["__mid"], "inner")
        for c, n in names.items():
            row(j, "merged_child_mismatch", m.into, n,
                F.count_if(~equal(dfm.get(n), F.col(f"`{c}`"), cx.schema[c].dataType, "d__")))
    for t in ctx.extracts:
        if t.entity in v.dest:
            row(v.dest[t.entity], "array_left_after_extract", t.entity, t.field,
                F.count_if(present(field_map(v.dest[t.entity].schema).get(t.field))))
    ds = dest_schema(v.schema, v.log)
    for table in sorted(v.dest):
        df = v.dest[table]
        fm = field_map(df.schema)
        if "id" in fm:
            ids = df.select(id_value(fm["id"]).alias("__id"))
            row(ids, "duplicate_ids", table, "id", F.count(F.lit(1)) - F.count_distinct("__id"))
        for col_, kind in v.kinds.get(table, {}).items():
            if col_ not in fm:
                row(df, "expected_column_missing", table, col_, F.count(F.lit(1)))
        for col_, fd in ds.entities.get(table, {}).items():
            if fd.kind == "enum" and fd.values and col_ in fm:
                strs = [p for p, dt in fm[col_].vars if isinstance(dt, T.StringType)]
                if strs:
                    bad = reduce(lambda a, b: a | b, [F.col(f"`{p}`").isNotNull() & ~F.col(f"`{p}`").isin(
                        list(fd.values)) for p in strs])
                    row(df, "enum_out_of_domain", table, col_, F.count_if(bad))
    out = union_all(spark, parts, "issue string, table_name string, column_name string, n_rows bigint")
    return out.filter(F.col("n_rows") > 0)
