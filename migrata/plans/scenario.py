"""Table sets derived from the TPC-H-style test tables, with their SQL twins.

Every source entity is a projection of a given table (nested arrays are built by a
grouped ``collect_list``), so every query's work grows with the tables.  The matching
DuckDB CTEs (``SQL_*``) define the same rows for the oracles.

The verification scenario ``VS`` is one migration spec over these entities plus a
destination damaged by data-value rules (a segment dropped, names altered, fake ids,
null refs, misrouted rows, wrong-typed values, columns left behind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.transforms import LazyTables, apply_log
from ..spec import Schema, Unmapped, FlattenNested, log_from_dicts


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------------------
# Source entities
# ---------------------------------------------------------------------------
def region_s(spark, d):
    return load(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))


def nation_s(spark, d):
    return load(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"),
                                           F.col("n_regionkey").cast("bigint").alias("region_id"))


def customer_s(spark, d):
    return load(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("bigint").alias("nation_key"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))


def orders_s(spark, d):
    return load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("orderdate"),
        F.col("o_orderpriority").alias("priority"))


LINE_FIELDS = ("linenumber", "partkey", "quantity", "price", "returnflag")


def lines_by_order(spark, d):
    """Line items of each order as an array sorted by all item columns (a total order).

    The fields of an item come first in that order, so items that differ only in the columns after them are equal here:
    those columns are neither read nor gathered."""
    li = load(spark, d, "lineitem")
    item = F.struct(F.col("l_linenumber").cast("bigint").alias("linenumber"), F.col("l_partkey").alias("partkey"),
                    F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
                    F.col("l_returnflag").alias("returnflag"))
    # dealt as plain rows: gathered before the shuffle, few items of an order meet, and the arrays are sorted and spilled twice
    return li.select(F.col("l_orderkey").alias("order_id"), item.alias("item")).repartition("order_id").groupBy("order_id").agg(
        F.array_sort(F.collect_list("item")).alias("lines"))


def orders_nested(spark, d):
    o = orders_s(spark, d)
    lines = lines_by_order(spark, d)
    return o.join(lines, o["id"] == lines["order_id"], "left").drop("order_id")


def supplier_nested(spark, d):
    """Suppliers with a per-row nested ``contacts`` array (1-2 items built from the row itself)."""
    s = load(spark, d, "supplier")
    items = F.when(F.col("s_acctbal") < 0, F.array(
        F.struct(F.lit("nation").alias("kind"), F.col("s_nationkey").cast("double").alias("value")))
    ).otherwise(F.array(
        F.struct(F.lit("nation").alias("kind"), F.col("s_nationkey").cast("double").alias("value")),
        F.struct(F.lit("balance").alias("kind"), F.col("s_acctbal").alias("value"))))
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                    F.col("s_nationkey").cast("bigint").alias("nation_key"), F.col("s_acctbal").alias("acctbal"),
                    items.alias("lines"))


def event_s(spark, d):
    return load(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value")


SQL_SOURCES = """
region_s AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region),
nation_s AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region_id FROM nation),
customer_s AS (SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation_key, c_acctbal AS acctbal,
                      c_mktsegment AS segment FROM customer),
orders_s AS (SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status, o_totalprice AS totalprice,
                    strftime(o_orderdate, '%Y-%m-%d') AS orderdate, o_orderpriority AS priority FROM orders),
lines_s AS (SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS linenumber, l_partkey AS partkey,
                   l_quantity AS quantity, l_extendedprice AS price, l_returnflag AS returnflag,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity,
                       l_extendedprice, l_returnflag, l_suppkey, l_discount, l_tax, l_linestatus, l_shipdate) - 1 AS pos
            FROM lineitem),
supplier_s AS (SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation_key,
                      s_acctbal AS acctbal, CAST(CASE WHEN s_acctbal < 0 THEN 1 ELSE 2 END AS BIGINT) AS n_lines
               FROM supplier),
event_s AS (SELECT event_id AS id, user_id, event_type, value FROM events)
"""


# ---------------------------------------------------------------------------
# Verification scenario (VS)
# ---------------------------------------------------------------------------
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

VS_SCHEMA = Schema.from_dict({
    "entities": {
        "Region": {"fields": {"id": {"kind": "id"}, "name": {"kind": "text"}}},
        "Nation": {"fields": {"id": {"kind": "id"}, "name": {"kind": "text"},
                              "region_id": {"kind": "ref", "target": "Region"}}},
        "Customer": {"fields": {"id": {"kind": "id"}, "name": {"kind": "text"}, "nation_key": {"kind": "number"},
                                "acctbal": {"kind": "number"}, "segment": {"kind": "enum", "values": SEGMENTS}}},
        "Orders": {"fields": {"id": {"kind": "id"}, "customer_id": {"kind": "ref", "target": "Customer"},
                              "status": {"kind": "enum", "values": ["F", "O", "P"]}, "totalprice": {"kind": "number"},
                              "orderdate": {"kind": "date"}, "priority": {"kind": "enum", "values": PRIORITIES},
                              "lines": {"kind": "nested", "of": "LineBlock"}}},
        "Event": {"fields": {"id": {"kind": "id"}, "user_id": {"kind": "ref", "target": "Customer"},
                             "event_type": {"kind": "enum", "values": EVENT_TYPES}, "value": {"kind": "number"}}},
        "Supplier": {"fields": {"id": {"kind": "id"}, "name": {"kind": "text"}, "nation_key": {"kind": "number"},
                                "acctbal": {"kind": "number"}, "lines": {"kind": "nested", "of": "DeliveryBlock"}}},
    },
    "nested_blocks": {
        "LineBlock": {"fields": {"linenumber": {"kind": "number"}, "partkey": {"kind": "number"},
                                 "quantity": {"kind": "number"}, "price": {"kind": "number"},
                                 "returnflag": {"kind": "text"}}},
        "DeliveryBlock": {"fields": {"kind": {"kind": "text"}, "value": {"kind": "number"}}},
    },
})

VS_LOG = log_from_dicts([
    {"type": "rename", "entity": "Customer", "from": "name", "to": "full_name"},
    {"type": "retype", "entity": "Customer", "field": "acctbal", "from": "number", "to": "text"},
    {"type": "enum_remap", "entity": "Orders", "field": "status",
     "mapping": {"F": "FULFILLED", "O": "OPEN", "P": "PENDING"}},
    {"type": "unmapped", "entity": "Orders", "field": "priority"},
    {"type": "flatten_nested", "entity": "Supplier", "field": "lines", "block": "DeliveryBlock", "into": "lines_count",
     "strategy": "count"},
    {"type": "extract_nested", "entity": "Orders", "field": "lines", "block": "LineBlock", "new_entity": "OrderLine",
     "link_field": "order_id"},
    {"type": "split", "from": "Customer", "into": ["Customer", "CustomerDetail"], "moved_fields": ["acctbal"],
     "link_field": "customer_id"},
    {"type": "merge", "from": ["Region", "Nation"], "into": "RegionNation", "dropped_link_field": "region_id"},
    {"type": "partition", "entity": "Event", "on_field": "event_type",
     "mapping": {"click": "ClickEvent", "purchase": "PurchaseEvent", "signup": "SignupEvent", "view": "ViewEvent"}},
    {"type": "denormalize", "entity": "Orders", "via_field": "customer_id", "from_entity": "Customer",
     "inlined": [{"source_field": "segment", "dest_field": "customer_segment"}]},
    {"type": "computed", "entity": "Customer", "operation": "bool_from_enum", "source_field": "segment",
     "value": "BUILDING", "dest_field": "is_building"},
    {"type": "computed", "entity": "Orders", "operation": "concat", "source_fields": ["status", "orderdate"],
     "separator": " @ ", "dest_field": "status_at"},
])
VS_BLOCKS = {b: list(fs) for b, fs in VS_SCHEMA.blocks.items()}
FAKE_ID_OFFSET = 1_000_000


def vs_source(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"Region": region_s(spark, d), "Nation": nation_s(spark, d), "Customer": customer_s(spark, d),
            "Orders": orders_nested(spark, d), "Event": event_s(spark, d), "Supplier": supplier_nested(spark, d)}


def vs_perfect(spark: SparkSession, d: str) -> LazyTables:
    return apply_log(vs_source(spark, d), VS_LOG, blocks=VS_BLOCKS)


def vs_dest(spark: SparkSession, d: str, source: dict[str, DataFrame] | None = None) -> LazyTables:
    """The damaged destination: the log applied (to ``source``, if it is already built), then data-value damage rules."""
    log = [s for s in VS_LOG if not isinstance(s, (Unmapped, FlattenNested))]
    t = apply_log(source or vs_source(spark, d), log, blocks=VS_BLOCKS)
    c = t["Customer"]
    kept = c.filter(F.col("segment") != "HOUSEHOLD").withColumn(
        "full_name", F.when(F.col("segment") == "MACHINERY", F.concat("full_name", F.lit("!"))).otherwise(F.col("full_name")))
    fake = c.filter(F.col("segment") == "AUTOMOBILE").withColumn("id", F.col("id") + F.lit(FAKE_ID_OFFSET))
    o = t["Orders"]
    orders = o.select(
        "id", F.when(F.col("priority") == "1-URGENT", F.lit(None)).otherwise(F.col("customer_id")).alias("customer_id"),
        "status", "totalprice", "orderdate", F.when(F.col("status") == "FULFILLED", F.col("priority")).alias("priority"),
        "customer_segment", "status_at")
    s = t["Supplier"]
    supplier = s.select("id", "name", "nation_key", "acctbal",
                        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("lines_count"),
                        F.when(F.col("acctbal") < 0, F.col("lines")).alias("lines"))
    click = t["ClickEvent"].unionByName(t["PurchaseEvent"].filter(F.col("value") > 400))
    out = LazyTables({
        "Customer": kept.unionByName(fake),
        "Orders": orders,
        "RegionNation": t["RegionNation"],
        "ClickEvent": click,
        "PurchaseEvent": t["PurchaseEvent"],
        "ViewEvent": t["ViewEvent"].withColumn("value", F.col("value").cast("string")),
        "Supplier": supplier,
    })
    out.defer("CustomerDetail", lambda: t["CustomerDetail"])
    out.defer("OrderLine", lambda: t["OrderLine"].filter(F.col("returnflag") != "R"))
    return out


SQL_VS = SQL_SOURCES + """,
customer_x AS (SELECT id, name AS full_name, nation_key, segment, segment = 'BUILDING' AS is_building FROM customer_s),
orders_x AS (SELECT o.id, o.customer_id,
                    CASE o.status WHEN 'F' THEN 'FULFILLED' WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'PENDING' ELSE o.status END AS status,
                    o.totalprice, o.orderdate,
                    (CASE o.status WHEN 'F' THEN 'FULFILLED' WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'PENDING' ELSE o.status END)
                      || ' @ ' || o.orderdate AS status_at
             FROM orders_s o),
supplier_x AS (SELECT id, name, nation_key, acctbal, n_lines AS lines_count FROM supplier_s),
event_x AS (SELECT id, user_id, event_type, value,
                   CASE event_type WHEN 'click' THEN 'ClickEvent' WHEN 'purchase' THEN 'PurchaseEvent'
                        WHEN 'signup' THEN 'SignupEvent' WHEN 'view' THEN 'ViewEvent' END AS sub
            FROM event_s),
customer_d AS (SELECT id, CASE WHEN segment = 'MACHINERY' THEN name || '!' ELSE name END AS full_name, nation_key, segment,
                      segment = 'BUILDING' AS is_building FROM customer_s WHERE segment <> 'HOUSEHOLD'
               UNION ALL
               SELECT id + 1000000, name, nation_key, segment, segment = 'BUILDING' FROM customer_s
               WHERE segment = 'AUTOMOBILE'),
detail_d AS (SELECT row_number() OVER (ORDER BY id) AS id, id AS customer_id, CAST(acctbal AS VARCHAR) AS acctbal
             FROM customer_s),
orders_d AS (SELECT x.id, CASE WHEN s.priority = '1-URGENT' THEN NULL ELSE x.customer_id END AS customer_id, x.status,
                    x.totalprice, x.orderdate, CASE WHEN x.status = 'FULFILLED' THEN s.priority END AS priority,
                    c.segment AS customer_segment, x.status_at
             FROM orders_x x JOIN orders_s s ON x.id = s.id LEFT JOIN customer_s c ON s.customer_id = c.id),
orderline_all AS (SELECT row_number() OVER (ORDER BY order_id, pos) AS id, order_id, linenumber, partkey, quantity, price,
                         returnflag FROM lines_s),
orderline_d AS (SELECT * FROM orderline_all WHERE returnflag <> 'R'),
regionnation_d AS (SELECT r.id, r.name, n.name AS nation_name FROM region_s r
                   LEFT JOIN (SELECT region_id, name, row_number() OVER (PARTITION BY region_id ORDER BY id) AS rn
                              FROM nation_s) n ON n.region_id = r.id AND n.rn = 1),
sub_d AS (SELECT 'ClickEvent' AS sub, id, user_id, value FROM event_s WHERE event_type = 'click'
          UNION ALL SELECT 'ClickEvent', id, user_id, value FROM event_s WHERE event_type = 'purchase' AND value > 400
          UNION ALL SELECT 'PurchaseEvent', id, user_id, value FROM event_s WHERE event_type = 'purchase'
          UNION ALL SELECT 'ViewEvent', id, user_id, value FROM event_s WHERE event_type = 'view'),
supplier_d AS (SELECT id, name, nation_key, acctbal, n_lines AS lines_count, (acctbal < 0 AND n_lines > 0) AS has_lines
               FROM supplier_s)
"""
