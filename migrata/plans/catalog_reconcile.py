"""Queries of identity, standardisation and matching (E1-E6, T3/P4 by table) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reconcile, standardise
from . import matching
from .scenario import load

# ---------------------------------------------------------------------------
# One id space for customers, orders and parts
# ---------------------------------------------------------------------------
SQL_WALK = """walk AS (SELECT source, old, row_number() OVER (ORDER BY source, old) AS new FROM (
  SELECT DISTINCT 'customer' AS source, c_custkey AS old FROM customer UNION ALL SELECT DISTINCT 'orders', o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'part', p_partkey FROM part))"""


def _walk(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.crosswalk({"customer": (load(spark, d, "customer"), "c_custkey"), "orders": (load(spark, d, "orders"), "o_orderkey"),
                                "part": (load(spark, d, "part"), "p_partkey")})


def e_crosswalk(spark, d):
    return _walk(spark, d)


def e_remap_orders(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), "o_totalprice")
    return reconcile.rewrite_refs(o, {"id": "orders", "customer_id": "customer"}, _walk(spark, d))


def e_remap_lines(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return reconcile.rewrite_refs(li, {"l_orderkey": "orders", "l_partkey": "part"}, _walk(spark, d))


def e_remap_nested(spark, d):
    """Part refs inside the arrays of every order, rewritten in place and shown item by item."""
    li = load(spark, d, "lineitem")
    nested = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("lines"))
    return reconcile.rewrite_nested(nested, "lines", "l_partkey", "part", _walk(spark, d)).select("id", F.inline("lines"))


def e_dangling(spark, d):
    """Refs that lost their target: lines of orders beyond 90 % of the order ids, and parts of no table."""
    li = load(spark, d, "lineitem").select((F.col("l_orderkey") * 10 - F.col("l_orderkey") * 9 - F.when(F.col("l_orderkey") % 10 == 0, 1_000_000).otherwise(0)).alias("order_id"),
                                           (F.col("l_partkey") + F.when(F.col("l_partkey") % 7 == 0, 5_000_000).otherwise(0)).alias("part_id"))
    return reconcile.dangling(li, {"order_id": "orders", "part_id": "part"}, _walk(spark, d))


# ---------------------------------------------------------------------------
# Customers entered up to three times
# ---------------------------------------------------------------------------
def _entries(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    k = F.col("c_custkey")
    person = k % 500
    name = F.when(k % 3 == 0, F.concat(F.lit("Client  "), person.cast("string"))).when(k % 3 == 1, F.concat(F.lit("CLIENT-"), person.cast("string"))).otherwise(
        F.concat(F.lit(" client "), person.cast("string"), F.lit(".")))
    return c.select(k.alias("id"), F.when(k % 97 != 5, name).alias("name"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("segment"),
                    F.col("c_acctbal").alias("balance"), F.concat(F.repeat(F.lit("+"), (k % 5).cast("int")), k.cast("string")).alias("phone"))


SQL_ENTRIES = """entries AS (SELECT c_custkey AS id,
  CASE WHEN c_custkey % 97 <> 5 THEN CASE c_custkey % 3 WHEN 0 THEN 'Client  ' || (c_custkey % 500) WHEN 1 THEN 'CLIENT-' || (c_custkey % 500)
    ELSE ' client ' || (c_custkey % 500) || '.' END END AS name,
  CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS segment, c_acctbal AS balance, repeat('+', CAST(c_custkey % 5 AS INTEGER)) || c_custkey AS phone,
  CASE WHEN c_custkey % 97 <> 5 THEN 'client ' || (c_custkey % 500) ELSE 'own ' || c_custkey END AS k FROM customer),
lost AS (SELECT id AS old, first AS new FROM (SELECT id, min(id) OVER (PARTITION BY k) AS first FROM entries) WHERE id <> first)"""
RULES = {"name": "latest", "segment": "earliest", "balance": "max", "phone": "longest"}


def _merged(spark, d):
    return reconcile.merge_duplicates(_entries(spark, d), reconcile.natural_key(F.col("name")), RULES)


def e_merge_duplicates(spark, d):
    return _merged(spark, d)[0]


def e_merge_lost(spark, d):
    return _merged(spark, d)[1]


def e_repoint_orders(spark, d):
    """Orders of customers that went point to the survivors; the orphan count afterwards stays zero."""
    from .constraints import fk_orphans
    kept, lost = _merged(spark, d)
    o = reconcile.repoint(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", lost)
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.min("o_orderkey").alias("first_order"))
    check = fk_orphans(o, "o_custkey", kept, "id", "orders").select(F.col("orphan_rows").alias("o_custkey"), F.lit(-1).cast("bigint").alias("n_orders"), F.lit(-1).cast("bigint").alias("first_order"))
    return per.union(check)


# ---------------------------------------------------------------------------
# Orders whose customer ref broke
# ---------------------------------------------------------------------------
def e_repair_refs(spark, d):
    c = load(spark, d, "customer")
    parent = c.select("c_custkey", F.when(F.col("c_custkey") % 10 == 3, F.concat(F.lit("Shared "), F.floor(F.col("c_custkey") / 20))).otherwise(F.col("c_name")).alias("name"))
    o = load(spark, d, "orders")
    key, ref = F.col("o_orderkey"), F.col("o_custkey")
    shared = F.concat(F.lit("  SHARED-"), F.floor(ref / 20), F.lit("!"))
    name = F.when(key % 35 == 0, "nobody").when(ref % 10 == 3, shared).otherwise(F.upper(F.concat(F.lit("customer "), F.substring_index(F.lpad(ref.cast("string"), 9, "0"), " ", 1))))
    child = o.select("o_orderkey", F.when(key % 7 == 0, -ref - 1).when(key % 11 == 0, F.lit(None)).otherwise(ref).alias("customer_id"), F.when(key % 13 != 0, name).alias("customer_name"))
    return reconcile.repair_refs(child, "customer_id", reconcile.natural_key(F.col("customer_name")), parent, "c_custkey", reconcile.natural_key(F.col("name")))


SQL_REPAIR = """WITH parent AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'shared ' || (c_custkey // 20) ELSE replace(lower(c_name), '#', ' ') END AS k FROM customer),
names AS (SELECT k, min(c_custkey) AS lo, max(c_custkey) AS hi FROM parent GROUP BY k),
child AS (SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 7 = 0 THEN -o_custkey - 1 WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS customer_id,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 35 = 0 THEN 'nobody' WHEN o_custkey % 10 = 3 THEN '  SHARED-' || (o_custkey // 20) || '!'
    ELSE 'CUSTOMER ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS customer_name,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 35 = 0 THEN 'nobody' WHEN o_custkey % 10 = 3 THEN 'shared ' || (o_custkey // 20)
    ELSE 'customer ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS k FROM orders),
found AS (SELECT c.*, p.c_custkey IS NOT NULL OR (customer_id IS NULL AND c.k IS NULL) AS ok, lo, hi FROM child c
  LEFT JOIN customer p ON p.c_custkey = c.customer_id LEFT JOIN names n ON n.k = c.k)
SELECT o_orderkey, CASE WHEN NOT ok AND lo = hi THEN lo ELSE customer_id END AS customer_id, customer_name,
  CASE WHEN ok THEN 'valid' WHEN lo IS NULL THEN 'unmatched' WHEN lo = hi THEN 'repaired' ELSE 'ambiguous' END AS outcome FROM found"""


# ---------------------------------------------------------------------------
# Order dates as three sources write them
# ---------------------------------------------------------------------------
def _dated(spark, d):
    o = load(spark, d, "orders")
    t, key = F.col("o_orderdate"), F.col("o_orderkey")
    early = F.date_add(F.date_trunc("month", t).cast("date"), ((F.dayofmonth(t) - 1) % 12).cast("int"))
    text = (F.when(key % 9 == 0, F.date_format(t, "yyyy-MM-dd")).when(key % 9 == 1, F.date_format(t, "yyyyMMdd")).when(key % 50 == 2, F.lit("soon"))
            .when(key % 50 == 3, F.lit(None)).when(F.col("o_orderstatus") == "F", F.date_format(t, "dd/MM/yyyy"))
            .when(F.col("o_orderstatus") == "O", F.date_format(t, "M/d/yy")).otherwise(F.date_format(early, "dd.MM.yyyy")))
    return o.select("o_orderkey", "o_orderstatus", text.alias("ordered"))


SQL_DATED = """dated AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS d,
    CAST(date_trunc('month', o_orderdate) AS DATE) + CAST((day(o_orderdate) - 1) % 12 AS INTEGER) AS early,
    CASE WHEN o_orderkey % 9 = 0 THEN 'iso' WHEN o_orderkey % 9 = 1 THEN 'plain' WHEN o_orderkey % 50 = 2 THEN 'soon' WHEN o_orderkey % 50 = 3 THEN 'none' ELSE o_orderstatus END AS how FROM orders)"""


def e_date_evidence(spark, d):
    return standardise.date_evidence(_dated(spark, d), "ordered", by="o_orderstatus")


def e_dates(spark, d):
    return standardise.normalise_dates(_dated(spark, d), "ordered", by="o_orderstatus")


SQL_DATES = f"""WITH {SQL_DATED} SELECT o_orderkey, o_orderstatus,
  CASE how WHEN 'iso' THEN strftime(d, '%Y-%m-%d') WHEN 'plain' THEN strftime(d, '%Y%m%d') WHEN 'soon' THEN 'soon' WHEN 'none' THEN NULL
    WHEN 'F' THEN strftime(d, '%d/%m/%Y') WHEN 'O' THEN month(d) || '/' || day(d) || '/' || strftime(d, '%y') ELSE strftime(early, '%d.%m.%Y') END AS ordered,
  CASE WHEN how IN ('soon', 'none') THEN NULL WHEN how <> 'P' THEN d WHEN day(early) = month(early) THEN early END AS parsed,
  CASE WHEN how = 'soon' THEN 'unparsed' WHEN how = 'P' AND day(early) <> month(early) THEN 'ambiguous' END AS reject FROM dated"""
SQL_EVIDENCE = f"""WITH {SQL_DATED}, e AS (SELECT o_orderstatus AS part,
  count(*) FILTER (WHERE how = 'F' AND day(d) > 12) AS n_day_first, count(*) FILTER (WHERE how = 'O' AND day(d) > 12) AS n_month_first,
  count(*) FILTER (WHERE how IN ('F', 'O') AND day(d) <= 12 OR how = 'P') AS n_either FROM dated GROUP BY o_orderstatus)
SELECT 'ordered' AS column_name, part, n_day_first, n_month_first, n_either, CASE WHEN n_day_first > 0 AND n_month_first > 0 THEN 'mixed' WHEN n_day_first > 0 THEN 'day_first'
  WHEN n_month_first > 0 THEN 'month_first' WHEN n_either > 0 THEN 'ambiguous' ELSE 'none' END AS decision FROM e"""


# ---------------------------------------------------------------------------
# T3 / P4 by table, E5
# ---------------------------------------------------------------------------
def e_remap_table(spark, d):
    """Part keys of all lines mapped through a table with an entry for five parts of six."""
    part = load(spark, d, "part").where("p_partkey % 6 <> 0").select(F.col("p_partkey").cast("string").alias("key"), F.concat("p_brand", F.lit("/"), "p_partkey").alias("value"))
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"))
    return standardise.remap_by_table(li, "part", part.union(part.where("key % 5 = 0")), default="suffix", suffix="?")


def e_standardise(spark, d):
    """Segments as people type them, brought to one form through a table of plain texts."""
    k = F.col("c_custkey")
    typed = F.when(k % 4 == 0, F.concat(F.lit("  "), F.lower("c_mktsegment"))).when(k % 4 == 1, F.initcap("c_mktsegment")).when(
        k % 4 == 2, F.concat(F.substring("c_mktsegment", 1, 3), F.lit(" \t"))).otherwise(F.lit("n/a"))
    c = load(spark, d, "customer").select("c_custkey", typed.alias("segment"))
    full = load(spark, d, "customer").select("c_mktsegment").distinct()
    table = full.select(F.col("c_mktsegment").alias("key"), F.lower("c_mktsegment").alias("value")).union(
        full.select(F.substring("c_mktsegment", 1, 3), F.lower("c_mktsegment")))
    return standardise.remap_by_table(c, "segment", table, default="null", normalise=standardise.plain_text)


def e_amount(spark, d):
    """Prices in six spellings, as decimals with their currency."""
    o = load(spark, d, "orders")
    k, v = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    text = v.cast("string")
    us = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    eu = F.translate(us, ".,", ",.")
    raw = (F.when(k % 6 == 0, F.concat(F.lit("$"), us)).when(k % 6 == 1, F.concat(eu, F.lit(" €"))).when(k % 6 == 2, F.concat(F.lit("(£"), us, F.lit(")")))
           .when(k % 6 == 3, F.concat(F.lit("usd "), text)).when(k % 6 == 4, F.concat(F.replace(text, F.lit("."), F.lit(",")), F.lit(" CHF-"))).otherwise(F.lit("on request")))
    return o.select("o_orderkey", standardise.amount(raw).alias("amount"), standardise.currency(raw).alias("currency"))


SQL_AMOUNT = """SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 2 THEN -v WHEN 4 THEN -v WHEN 5 THEN NULL ELSE v END AS DECIMAL(38, 2)) AS amount,
  CASE o_orderkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'USD' WHEN 4 THEN 'CHF' END AS currency
FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS v FROM orders)"""


# ---------------------------------------------------------------------------
# Columns that hold the same values
# ---------------------------------------------------------------------------
MATCHED = {"customer": ["c_custkey", "c_nationkey", "c_mktsegment", "c_name"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
           "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"], "supplier": ["s_suppkey", "s_nationkey", "s_name"],
           "part": ["p_partkey", "p_brand", "p_type", "p_size"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"],
           "events": ["event_id", "user_id", "event_type"]}


def _matched(spark, d):
    return {t: load(spark, d, t).select(*cols) for t, cols in MATCHED.items()}


def e_column_profile(spark, d):
    return matching.column_profiles(matching.column_values(_matched(spark, d)))


def e_column_match(spark, d):
    out = matching.column_matches(_matched(spark, d))
    return out.withColumn("jaccard", F.round("jaccard", 6))


def _sql_cells() -> str:
    text = {"c_mktsegment", "c_name", "o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus", "s_name", "p_brand", "p_type", "n_name", "r_name", "event_type"}
    return "cells AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{c}' AS c, '{'text' if c in text else 'integer'}' AS kind, CAST({c} AS VARCHAR) AS v FROM {t}" for t, cols in MATCHED.items() for c in cols) + ")"


def queries() -> dict:
    return {"e_crosswalk": e_crosswalk, "e_remap_orders": e_remap_orders, "e_remap_lines": e_remap_lines, "e_remap_nested": e_remap_nested, "e_dangling": e_dangling,
            "e_merge_duplicates": e_merge_duplicates, "e_merge_lost": e_merge_lost, "e_repoint_orders": e_repoint_orders, "e_repair_refs": e_repair_refs,
            "e_date_evidence": e_date_evidence, "e_dates": e_dates, "e_remap_table": e_remap_table, "e_standardise": e_standardise, "e_amount": e_amount,
            "e_column_profile": e_column_profile, "e_column_match": e_column_match}


def oracles() -> dict:
    w = f"WITH {SQL_WALK} "
    e = f"WITH {SQL_ENTRIES} "
    return {
        "e_crosswalk": w + "SELECT source, old, new FROM walk",
        "e_remap_orders": w + """SELECT a.new AS id, b.new AS customer_id, o_totalprice FROM orders LEFT JOIN walk a ON a.source = 'orders' AND a.old = o_orderkey
            LEFT JOIN walk b ON b.source = 'customer' AND b.old = o_custkey""",
        "e_remap_lines": w + """SELECT a.new AS l_orderkey, b.new AS l_partkey, l_linenumber, l_quantity FROM lineitem LEFT JOIN walk a ON a.source = 'orders' AND a.old = l_orderkey
            LEFT JOIN walk b ON b.source = 'part' AND b.old = lineitem.l_partkey""",
        "e_remap_nested": w + """SELECT l_orderkey AS id, l_linenumber, b.new AS l_partkey, l_suppkey, l_quantity FROM lineitem
            LEFT JOIN walk b ON b.source = 'part' AND b.old = lineitem.l_partkey""",
        "e_dangling": """WITH r AS (SELECT l_orderkey - CASE WHEN l_orderkey % 10 = 0 THEN 1000000 ELSE 0 END AS order_id,
              l_partkey + CASE WHEN l_partkey % 7 = 0 THEN 5000000 ELSE 0 END AS part_id FROM lineitem)
            SELECT 'order_id' AS ref, order_id AS old, count(*) AS n_rows FROM r WHERE order_id NOT IN (SELECT o_orderkey FROM orders) GROUP BY order_id
            UNION ALL SELECT 'part_id', part_id, count(*) FROM r WHERE part_id NOT IN (SELECT p_partkey FROM part) GROUP BY part_id""",
        "e_merge_duplicates": e + """SELECT min(id) AS id, arg_max(name, id) FILTER (WHERE name IS NOT NULL) AS name, arg_min(segment, id) FILTER (WHERE segment IS NOT NULL) AS segment,
            max(balance) AS balance, arg_min(phone, [CAST(-length(phone) AS VARCHAR), phone]) FILTER (WHERE length(phone) = m) AS phone
            FROM (SELECT *, max(length(phone)) OVER (PARTITION BY k) AS m FROM entries) GROUP BY k""",
        "e_merge_lost": e + "SELECT old, new FROM lost",
        "e_repoint_orders": e + """SELECT coalesce(new, o.o_custkey) AS o_custkey, count(*) AS n_orders, min(o_orderkey) AS first_order FROM orders o
            LEFT JOIN lost ON old = o.o_custkey GROUP BY 1 UNION ALL SELECT 0, -1, -1""",
        "e_repair_refs": SQL_REPAIR,
        "e_date_evidence": SQL_EVIDENCE,
        "e_dates": SQL_DATES,
        "e_remap_table": """SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NOT NULL AND l_partkey % 6 <> 0 THEN p_brand || '/' || p_partkey ELSE l_partkey || '?' END AS part
            FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""",
        "e_standardise": "SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN lower(c_mktsegment) END AS segment FROM customer",
        "e_amount": SQL_AMOUNT,
        "e_column_profile": f"""WITH {_sql_cells()} SELECT t AS table_name, c AS column_name, kind, count(*) AS n_rows, count(*) FILTER (WHERE v IS NULL) AS n_null,
            count(DISTINCT v) AS n_distinct FROM cells GROUP BY t, c, kind""",
        "e_column_match": f"""WITH {_sql_cells()}, held AS (SELECT DISTINCT t, c, kind, v FROM cells WHERE v IS NOT NULL), size AS (SELECT t, c, count(*) AS n FROM held GROUP BY t, c),
            met AS (SELECT a.t AS table_a, a.c AS column_a, b.t AS table_b, b.c AS column_b, a.kind, count(*) AS common FROM held a JOIN held b
              ON a.v = b.v AND a.kind = b.kind AND (a.t, a.c) < (b.t, b.c) GROUP BY ALL),
            scored AS (SELECT met.*, x.n AS distinct_a, y.n AS distinct_b, common / (x.n + y.n - common) AS j FROM met
              JOIN size x ON x.t = table_a AND x.c = column_a JOIN size y ON y.t = table_b AND y.c = column_b)
            SELECT table_a, column_a, table_b, column_b, kind, common, distinct_a, distinct_b, round(j, 6) AS jaccard,
              CAST(row_number() OVER (PARTITION BY table_a, column_a ORDER BY j DESC, table_b, column_b) AS INTEGER) AS rank FROM scored WHERE j >= 0.5""",
    }
