"""Verification queries (V1-V6) on the TPC-H-derived scenario, each with its DuckDB oracle.

Spark side: one ``Verifier`` over the scenario; a query is the long check table filtered
to one check (Catalyst drops every union branch whose literal check name differs, so
only that check's joins run).  SQL side: the same hits / totals written directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scenario import SQL_VS, VS_LOG, VS_SCHEMA, customer_s, vs_dest, vs_source
from ..sources.storage import stored, stored_set
from .verify import Verifier

ROUND = 9


def vs_verifier(spark: SparkSession, d: str, only=None) -> Verifier:
    return Verifier(VS_SCHEMA, VS_LOG, vs_source(spark, d), vs_dest(spark, d), only=only)


def vs_written_verifier(spark: SparkSession, d: str) -> Verifier:
    """All checks read every destination table, most of them often: as in a job, the destination is a written one.

    So are the nested orders of the source: each use of them would gather all line items by order again."""
    source = vs_source(spark, d)
    source["Orders"] = stored(source["Orders"], "source-Orders")
    return Verifier(VS_SCHEMA, VS_LOG, source, stored_set(vs_dest(spark, d, source), "dest"))


def _check(name: str):
    def q(spark: SparkSession, d: str) -> DataFrame:
        out = vs_verifier(spark, d, only={name}).checks()
        return out.select("axis", "check", "entity", "step", F.round("hits", ROUND).alias("hits"),
                          F.round("total", ROUND).alias("total"))
    q.__name__ = name
    return q


def _row(axis: str, check: str, entity: str, step, hits: str, total: str, frm: str) -> str:
    st = "CAST(NULL AS INTEGER)" if step is None else f"CAST({step} AS INTEGER)"
    ent = f"'{entity}'" if not entity.startswith("=") else entity[1:]
    return (f"SELECT '{axis}' AS axis, '{check}' AS \"check\", {ent} AS entity, {st} AS step, "
            f"CAST({hits} AS DOUBLE) AS hits, CAST({total} AS DOUBLE) AS total {frm}")


def _eqd(a: str, b: str) -> str:
    return f"(CASE WHEN abs({a} - {b}) < 1e-9 THEN 1 ELSE 0 END)"


def _eq(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1 ELSE 0 END)"


# ---------------------------------------------------------------------------
# SQL for every check the verifier emits on the scenario
# ---------------------------------------------------------------------------
CHECK_SQL: dict[str, list[str]] = {}


def _add(check: str, sql: str) -> None:
    CHECK_SQL.setdefault(check, []).append(sql)


for ent, s_tab, d_tab in (("Customer", "customer_s", "customer_d"), ("Orders", "orders_s", "orders_d"),
                          ("Supplier", "supplier_s", "supplier_d")):
    _add("v_cov_recall", _row("coverage", "v_cov_recall", ent, None, "count(d.id)", "count(*)",
                              f"FROM {s_tab} s LEFT JOIN (SELECT DISTINCT id FROM {d_tab}) d ON s.id = d.id"))
    _add("v_cov_false_pos", _row("coverage", "v_cov_false_pos", ent, None, "0", "count(*)",
                                 f"FROM (SELECT DISTINCT id FROM {d_tab}) d WHERE NOT EXISTS "
                                 f"(SELECT 1 FROM {s_tab} s WHERE s.id = d.id)"))

_add("v_fid_base", _row(
    "field_fidelity", "v_fid_base", "Customer", None,
    "sum(CASE WHEN d.id IS NULL THEN 0 ELSE 1 + " + " + ".join(
        _eq(f"x.{c}", f"d.{c}") for c in ("full_name", "nation_key", "segment", "is_building")) + " END)",
    "sum(CASE WHEN d.id IS NULL THEN 1 ELSE 5 END)",
    "FROM customer_x x LEFT JOIN customer_d d ON x.id = d.id"))
_add("v_fid_base", _row(
    "field_fidelity", "v_fid_base", "Orders", None,
    "sum(CASE WHEN d.id IS NULL THEN 0 ELSE 1 + " + " + ".join(
        [_eq("x.customer_id", "d.customer_id"), _eq("x.status", "d.status"), _eqd("x.totalprice", "d.totalprice"),
         _eq("x.orderdate", "d.orderdate"), _eq("x.status_at", "d.status_at")]) + " END)",
    "sum(CASE WHEN d.id IS NULL THEN 1 ELSE 5 + (CASE WHEN d.customer_id IS NULL THEN 0 ELSE 1 END) END)",
    "FROM orders_x x LEFT JOIN orders_d d ON x.id = d.id"))
_add("v_fid_base", _row(
    "field_fidelity", "v_fid_base", "Supplier", None,
    "sum(CASE WHEN d.id IS NULL THEN 0 ELSE 1 + " + " + ".join(
        [_eq("x.name", "d.name"), _eq("x.nation_key", "d.nation_key"), _eqd("x.acctbal", "d.acctbal"),
         _eq("x.lines_count", "d.lines_count")]) + " END)",
    "sum(CASE WHEN d.id IS NULL THEN 1 ELSE 5 END)",
    "FROM supplier_x x LEFT JOIN supplier_d d ON x.id = d.id"))
_add("v_fid_unmapped_left", _row(
    "field_fidelity", "v_fid_unmapped_left", "Orders", None, "0",
    "count(*) FILTER (WHERE d.priority IS NOT NULL)", "FROM orders_x x JOIN orders_d d ON x.id = d.id"))
_add("v_rel_refs", _row(
    "relationship_integrity", "v_rel_refs", "Orders", None,
    "count(*) FILTER (WHERE d.customer_id IS NOT NULL AND d.customer_id = s.customer_id "
    "AND s.customer_id IN (SELECT id FROM customer_d))",
    "count(*)", "FROM orders_s s LEFT JOIN orders_d d ON s.id = d.id"))
_add("v_rel_refs", _row(
    "relationship_integrity", "v_rel_refs", "Event", None,
    "count(*) FILTER (WHERE d.id IS NOT NULL AND d.user_id IS NOT NULL AND d.user_id = x.user_id "
    "AND x.user_id IN (SELECT id FROM customer_d))",
    "count(*)", "FROM event_x x LEFT JOIN sub_d d ON x.sub = d.sub AND x.id = d.id"))
_add("v_cov_part_recall", _row(
    "coverage", "v_cov_part_recall", "Event", None, "count(d.id)", "count(*)",
    "FROM event_x x LEFT JOIN (SELECT DISTINCT sub, id FROM sub_d) d ON x.sub = d.sub AND x.id = d.id"))
_add("v_cov_part_false_pos", _row(
    "coverage", "v_cov_part_false_pos", "Event", None, "0", "count(*)",
    "FROM (SELECT DISTINCT sub, id FROM sub_d) d WHERE NOT EXISTS "
    "(SELECT 1 FROM event_x x WHERE x.sub = d.sub AND x.id = d.id)"))
# ViewEvent.value is written as text in the destination, so it never equals the number
_add("v_fid_partition", _row(
    "field_fidelity", "v_fid_partition", "Event", None,
    "sum(CASE WHEN d.id IS NULL THEN 0 ELSE 1 + " + _eq("x.user_id", "d.user_id")
    + " + (CASE WHEN d.sub = 'ViewEvent' THEN 0 ELSE " + _eqd("x.value", "d.value") + " END) END)",
    "sum(CASE WHEN d.id IS NULL THEN 1 ELSE 3 END)",
    "FROM event_x x LEFT JOIN sub_d d ON x.sub = d.sub AND x.id = d.id WHERE x.sub IS NOT NULL"))
_add("v_str_jaccard", _row(
    "structural", "v_str_jaccard", "=s.sub", 8,
    "CASE WHEN coalesce(e.n, 0) = 0 THEN (CASE WHEN coalesce(a.n, 0) = 0 THEN 1.0 ELSE 0.0 END) "
    "ELSE CAST(coalesce(i.n, 0) AS DOUBLE) / CAST(coalesce(e.n, 0) + coalesce(a.n, 0) - coalesce(i.n, 0) AS DOUBLE) END",
    "1",
    "FROM (VALUES ('ClickEvent'), ('PurchaseEvent'), ('SignupEvent'), ('ViewEvent')) s(sub) "
    "LEFT JOIN (SELECT sub, count(*) AS n FROM event_x WHERE sub IS NOT NULL GROUP BY sub) e ON e.sub = s.sub "
    "LEFT JOIN (SELECT sub, count(DISTINCT id) AS n FROM sub_d GROUP BY sub) a ON a.sub = s.sub "
    "LEFT JOIN (SELECT x.sub, count(*) AS n FROM event_x x JOIN (SELECT DISTINCT sub, id FROM sub_d) d "
    "ON x.sub = d.sub AND x.id = d.id GROUP BY x.sub) i ON i.sub = s.sub"))
_add("v_fid_merge", _row(
    "field_fidelity", "v_fid_merge", "Region", None,
    "sum(CASE WHEN d.id IS NULL THEN 0 ELSE 1 + " + _eq("x.name", "d.name") + " END)",
    "sum(CASE WHEN d.id IS NULL THEN 1 ELSE 2 END)", "FROM region_s x LEFT JOIN regionnation_d d ON x.id = d.id"))
for check, ent, step, src_n, dst_n in (
        ("v_cov_merge", "RegionNation", 7, "(SELECT count(*) FROM region_s)", "(SELECT count(*) FROM regionnation_d)"),
        ("v_cov_split", "CustomerDetail", 6, "(SELECT count(*) FROM customer_s)", "(SELECT count(*) FROM detail_d)"),
        ("v_cov_extract", "OrderLine", 5, "(SELECT count(*) FROM lines_s)", "(SELECT count(*) FROM orderline_d)")):
    _add(check, _row("coverage", check, ent, step, f"least({src_n}, {dst_n})", src_n, ""))
    _add("v_str_presence", _row("structural", "v_str_presence", ent, step,
                                f"CASE WHEN {src_n} = 0 OR {dst_n} > 0 THEN 1.0 ELSE 0.0 END", "1", ""))
_add("v_fid_split", _row(
    "field_fidelity", "v_fid_split", "CustomerDetail", 6,
    "count(*) FILTER (WHERE d.acctbal = CAST(s.acctbal AS VARCHAR))", "count(*)",
    "FROM customer_s s LEFT JOIN detail_d d ON d.customer_id = s.id"))
_add("v_rel_split_link", _row(
    "relationship_integrity", "v_rel_split_link", "CustomerDetail", 6,
    "count(*) FILTER (WHERE customer_id IN (SELECT id FROM customer_d))", "count(*)", "FROM detail_d"))
_add("v_rel_extract_link", _row(
    "relationship_integrity", "v_rel_extract_link", "OrderLine", 5,
    "count(*) FILTER (WHERE order_id IN (SELECT id FROM orders_d))", "count(*)", "FROM orderline_d"))
_add("v_fid_extract", _row(
    "field_fidelity", "v_fid_extract", "OrderLine", 5,
    "sum(CASE WHEN d.id IS NULL THEN 0 ELSE " + " + ".join(
        [_eq("s.linenumber", "d.linenumber"), _eq("s.partkey", "d.partkey"), _eqd("s.quantity", "d.quantity"),
         _eqd("s.price", "d.price"), _eq("s.returnflag", "d.returnflag")]) + " END)",
    "5 * count(*)",
    "FROM lines_s s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY id) - 1 AS dpos "
    "FROM orderline_d) d ON s.order_id = d.order_id AND s.pos = d.dpos"))
_add("v_fid_extract_extra", _row(
    "field_fidelity", "v_fid_extract_extra", "OrderLine", 5, "0",
    "coalesce(sum(greatest(d.n - coalesce(s.n, 0), 0)), 0)",
    "FROM orders_s o JOIN (SELECT order_id, count(*) AS n FROM orderline_d GROUP BY order_id) d ON d.order_id = o.id "
    "LEFT JOIN (SELECT order_id, count(*) AS n FROM lines_s GROUP BY order_id) s ON s.order_id = o.id"))
_add("v_str_flatten", _row(
    "structural", "v_str_flatten", "Supplier", 4,
    "(1.0 + CAST(count(*) FILTER (WHERE NOT has_lines) AS DOUBLE) / CAST(count(*) AS DOUBLE)) * 0.5", "1",
    "FROM supplier_d"))
_add("v_str_unmapped", _row(
    "structural", "v_str_unmapped", "Orders", 3,
    "CAST(count(*) FILTER (WHERE priority IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE)", "1", "FROM orders_d"))
_add("v_str_denorm", _row("structural", "v_str_denorm", "Orders.customer_segment", 9,
                          "CAST(count(*) AS DOUBLE) / CAST(count(*) AS DOUBLE)", "1", "FROM orders_d"))
_add("v_fid_denorm", _row(
    "field_fidelity", "v_fid_denorm", "Orders", 9,
    "count(*) FILTER (WHERE (d.customer_segment IS NULL AND c.segment IS NULL) OR d.customer_segment = c.segment)",
    "count(*)",
    "FROM orders_s s JOIN orders_d d ON s.id = d.id LEFT JOIN customer_s c ON s.customer_id = c.id"))
_add("v_str_computed", _row(
    "structural", "v_str_computed", "Customer", 10,
    "CAST(count(*) FILTER (WHERE x.id IS NOT NULL AND d.is_building = x.is_building) AS DOUBLE) "
    "/ CAST(count(x.id) AS DOUBLE)", "1", "FROM customer_d d LEFT JOIN customer_x x ON d.id = x.id"))
_add("v_str_computed", _row(
    "structural", "v_str_computed", "Orders", 11,
    "CAST(count(*) FILTER (WHERE x.id IS NOT NULL AND d.status_at = x.status_at) AS DOUBLE) "
    "/ CAST(count(x.id) AS DOUBLE)", "1", "FROM orders_d d LEFT JOIN orders_x x ON d.id = x.id"))
for ent, tab, n_cols, extra_t, extra_h in (
        ("Customer", "customer_d", 5, "", ""),
        ("CustomerDetail", "detail_d", 3, "", ""),
        ("Orders", "orders_d", 6, " + count(customer_id)", " + count(customer_id)"),
        ("OrderLine", "orderline_d", 7, "", ""),
        ("RegionNation", "regionnation_d", 1, " + count(name) + count(nation_name)", " + count(name) + count(nation_name)"),
        ("Supplier", "supplier_d", 5, "", "")):
    _add("v_type", _row("type_correctness", "v_type", ent, None, f"{n_cols} * count(*){extra_h}",
                        f"{n_cols} * count(*){extra_t}", f"FROM {tab}"))
for sub, ok in (("ClickEvent", 3), ("PurchaseEvent", 3), ("ViewEvent", 2)):
    _add("v_type", _row("type_correctness", "v_type", sub, None, f"{ok} * count(*)", "3 * count(*)",
                        f"FROM sub_d WHERE sub = '{sub}'"))


def _check_oracle(name: str) -> str:
    parts = CHECK_SQL[name]
    body = "\nUNION ALL\n".join(parts)
    return (f"WITH {SQL_VS}, r AS ({body})\nSELECT axis, \"check\", entity, step, round(hits, {ROUND}) AS hits, "
            f"round(total, {ROUND}) AS total FROM r")


def _all_checks_sql() -> str:
    return "\nUNION ALL\n".join(p for parts in CHECK_SQL.values() for p in parts)


# ---------------------------------------------------------------------------
# Queries with their own shapes
# ---------------------------------------------------------------------------
def v_score_report(spark: SparkSession, d: str) -> DataFrame:
    v = vs_written_verifier(spark, d)
    rep = v.store_parts().report()
    return rep.select(*[F.round(c, ROUND).alias(c) for c in rep.columns])


SQL_SCORE_REPORT = f"""WITH {SQL_VS}, r AS ({_all_checks_sql()}),
s AS (SELECT axis, sum(hits) AS h, sum(total) AS t FROM r GROUP BY axis),
a AS (SELECT
  coalesce(max(CASE WHEN axis = 'coverage' THEN CASE WHEN t = 0 THEN 1.0 ELSE h / t END END), 1.0) AS coverage,
  coalesce(max(CASE WHEN axis = 'field_fidelity' THEN CASE WHEN t = 0 THEN 1.0 ELSE h / t END END), 1.0) AS field_fidelity,
  coalesce(max(CASE WHEN axis = 'relationship_integrity' THEN CASE WHEN t = 0 THEN 1.0 ELSE h / t END END), 1.0)
    AS relationship_integrity,
  coalesce(max(CASE WHEN axis = 'type_correctness' THEN CASE WHEN t = 0 THEN 1.0 ELSE h / t END END), 1.0)
    AS type_correctness,
  coalesce(max(CASE WHEN axis = 'structural' THEN CASE WHEN t = 0 THEN 1.0 ELSE h / t END END), 1.0) AS structural
  FROM s)
SELECT round(coverage, {ROUND}) AS coverage, round(field_fidelity, {ROUND}) AS field_fidelity,
       round(relationship_integrity, {ROUND}) AS relationship_integrity,
       round(type_correctness, {ROUND}) AS type_correctness, round(structural, {ROUND}) AS structural,
       round((coverage * 0.2 + field_fidelity * 0.3 + relationship_integrity * 0.3 + type_correctness * 0.2)
             * (0.2 + 0.8 * structural) * 100.0, {ROUND}) AS total
FROM a"""


def v_expected_rows(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.transforms import expected_frame
    return expected_frame(customer_s(spark, d), "Customer", VS_LOG)


SQL_EXPECTED_ROWS = f"WITH {SQL_VS} SELECT id, full_name, nation_key, segment, is_building FROM customer_x"


def v_values_equal(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import types as T

    from ..functions.values import values_equal
    c = customer_s(spark, d)
    dt = T.DoubleType()
    return c.select(
        "id",
        values_equal(F.col("acctbal"), dt, F.col("acctbal") + F.lit(5e-10), dt).alias("eq_near"),
        values_equal(F.col("nation_key"), T.LongType(), F.col("nation_key") * F.lit(1.0), dt).alias("eq_int_double"),
        values_equal(F.col("name"), T.StringType(), F.col("acctbal"), dt).alias("eq_text_number"),
        values_equal(F.col("acctbal") > 0, T.BooleanType(), F.lit(1).cast("bigint"), T.LongType()).alias("eq_bool_int"),
        values_equal(F.when(F.col("acctbal") < 0, F.col("segment")), T.StringType(),
                     F.when(F.col("acctbal") < 0, F.col("segment")), T.StringType()).alias("eq_null_safe"),
    )


SQL_VALUES_EQUAL = f"""WITH {SQL_VS}
SELECT id, abs(acctbal - (acctbal + 5e-10)) < 1e-9 AS eq_near,
       abs(CAST(nation_key AS DOUBLE) - nation_key * 1.0) < 1e-9 AS eq_int_double,
       false AS eq_text_number,
       (CASE WHEN acctbal > 0 THEN 1 ELSE 0 END) = 1 AS eq_bool_int,
       true AS eq_null_safe
FROM customer_s"""


def v_rel_target_ids(spark: SparkSession, d: str) -> DataFrame:
    return vs_verifier(spark, d).target_ids(["Customer", "Region", "Orders"])


SQL_REL_TARGET_IDS = f"""WITH {SQL_VS}
SELECT DISTINCT 'Customer' AS target, id FROM customer_d
UNION SELECT DISTINCT 'Region', id FROM regionnation_d
UNION SELECT DISTINCT 'Orders', id FROM orders_d"""


CHECK_NAMES = list(CHECK_SQL)


def queries() -> dict:
    q = {name: _check(name) for name in CHECK_NAMES}
    q.update(v_score_report=v_score_report, v_expected_rows=v_expected_rows, v_values_equal=v_values_equal,
             v_rel_target_ids=v_rel_target_ids)
    return q


def oracles() -> dict:
    o = {name: _check_oracle(name) for name in CHECK_NAMES}
    o.update(v_score_report=SQL_SCORE_REPORT, v_expected_rows=SQL_EXPECTED_ROWS, v_values_equal=SQL_VALUES_EQUAL,
             v_rel_target_ids=SQL_REL_TARGET_IDS)
    return o

