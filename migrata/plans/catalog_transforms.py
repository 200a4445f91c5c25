"""Transform, key, relabel and expression-shape queries.

Each query applies the library operator to entities projected from the given tables; the
oracle SQL writes the expected rows directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import inverse_map, remap
from ..operators.keys import dense_id, dense_id_nested, last_wins, position_in_group
from ..operators.relabel import relabel, relabel_maps, translate_back
from ..operators.transforms import apply_log, merge_tables, partition_table, ROUTE_COL, routed_union
from ..spec import log_from_dicts
from .scenario import (
    SQL_SOURCES,
    SQL_VS,
    customer_s,
    event_s,
    load,
    nation_s,
    orders_nested,
    orders_s,
    region_s,
    vs_perfect,
)

W = f"WITH {SQL_SOURCES} "


def _one(entity: str, frame_fn, steps: list[dict], out: str | None = None):
    """Query applying a small log to one entity (``out`` picks the resulting table)."""
    log = log_from_dicts(steps)

    def q(spark: SparkSession, d: str) -> DataFrame:
        return apply_log({entity: frame_fn(spark, d)}, log)[out or entity]
    return q


def customer_flag(spark, d):
    return customer_s(spark, d).withColumn("positive", F.col("acctbal") > 0)


def orders_dated(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
                                           F.col("o_orderdate").cast("date").alias("orderdate"))


def part_s(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                                         F.col("p_size").cast("bigint").alias("size"),
                                         F.col("p_retailprice").alias("retailprice"))


def customer_nref(spark, d):
    return customer_s(spark, d).withColumnRenamed("nation_key", "nation_id")


CHILD_ORDER = ["linenumber", "partkey", "suppkey", "quantity", "price", "discount", "tax", "returnflag",
               "linestatus", "shipdate"]


def line_child(spark, d, with_status: bool):
    li = load(spark, d, "lineitem")
    cols = [F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("linenumber"),
            F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
            F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
            F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipdate")]
    if with_status:
        cols.append(F.col("l_linestatus").alias("status"))
    return li.select(*cols)


def t_merge_first_child(spark, d):
    return merge_tables(orders_s(spark, d), line_child(spark, d, False), "LineItem", "order_id", CHILD_ORDER)


def t_merge_collision(spark, d):
    return merge_tables(orders_s(spark, d), line_child(spark, d, True), "LineItem", "order_id", CHILD_ORDER)


SQL_FIRST_LINE = """first_line AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         l_returnflag AS returnflag, l_linestatus AS linestatus, strftime(l_shipdate, '%Y-%m-%d') AS shipdate
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
               l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d')) AS rn
        FROM lineitem) WHERE rn = 1)"""
SQL_MERGE_FIRST = (f"{W}, {SQL_FIRST_LINE} SELECT o.*, f.linenumber, f.partkey, f.suppkey, f.quantity, f.price, "
                   "f.discount, f.tax, f.returnflag, f.linestatus, f.shipdate "
                   "FROM orders_s o LEFT JOIN first_line f ON f.l_orderkey = o.id")
SQL_MERGE_COLLISION = (f"{W}, {SQL_FIRST_LINE} SELECT o.*, f.linenumber, f.partkey, f.suppkey, f.quantity, f.price, "
                       "f.discount, f.tax, f.returnflag, f.linestatus, f.shipdate, f.linestatus AS lineitem_status "
                       "FROM orders_s o LEFT JOIN first_line f ON f.l_orderkey = o.id")

EVENT_ROUTES = {"click": "ClickEvent", "purchase": "PurchaseEvent", "signup": "SignupEvent", "view": "ViewEvent"}


def t_partition_routed(spark, d):
    """All routable rows with their sub-table, in one pass."""
    return routed_union(event_s(spark, d), "event_type", EVENT_ROUTES).withColumnRenamed(ROUTE_COL, "sub")


def t_partition_click(spark, d):
    return partition_table(event_s(spark, d), "event_type", EVENT_ROUTES)["ClickEvent"]


SQL_PART_ROUTED = (W + "SELECT id, user_id, value, CASE event_type WHEN 'click' THEN 'ClickEvent' "
                   "WHEN 'purchase' THEN 'PurchaseEvent' WHEN 'signup' THEN 'SignupEvent' WHEN 'view' THEN 'ViewEvent' "
                   "END AS sub FROM event_s WHERE event_type IN ('click', 'purchase', 'signup', 'view')")


def t_denormalize(spark, d):
    log = log_from_dicts([{"type": "denormalize", "entity": "Customer", "via_field": "nation_id", "from_entity": "Nation",
                           "inlined": [{"source_field": "name", "dest_field": "nation_name"},
                                       {"source_field": "region_id", "dest_field": "nation_region"}]}])
    return apply_log({"Customer": customer_nref(spark, d), "Nation": nation_s(spark, d)}, log)["Customer"]


def t_denormalize_orphan(spark, d):
    """Refs into a table that lacks most of the ids: broken refs inline a present None."""
    log = log_from_dicts([{"type": "denormalize", "entity": "Customer", "via_field": "nation_id", "from_entity": "Region",
                           "inlined": [{"source_field": "name", "dest_field": "region_name"}]}])
    return apply_log({"Customer": customer_nref(spark, d), "Region": region_s(spark, d)}, log)["Customer"]


def t_replay_full(spark, d):
    """Full log replay over the scenario; the Orders table (remap, unmapped, extract, denormalize, computed)."""
    return vs_perfect(spark, d)["Orders"]


def _replayed(table: str):
    """The values of one destination table after the full log replay."""
    def q(spark, d):
        return vs_perfect(spark, d)[table]
    q.__name__ = f"t_replay_{table.lower()}"
    return q


SQL_REPLAY_FULL = (f"WITH {SQL_VS} SELECT x.id, x.customer_id, x.status, x.totalprice, x.orderdate, "
                   "c.segment AS customer_segment, x.status_at FROM orders_x x LEFT JOIN customer_s c "
                   "ON c.id = x.customer_id")
SQL_REPLAY = {
    "t_replay_customer": "SELECT id, full_name, nation_key, segment, is_building FROM customer_x",
    "t_replay_customer_detail": "SELECT id, customer_id, acctbal FROM detail_d",
    "t_replay_order_line": "SELECT * FROM orderline_all",
    "t_replay_region_nation": "SELECT * FROM regionnation_d",
    "t_replay_supplier": "SELECT * FROM supplier_x",
    "t_replay_click_event": "SELECT id, user_id, value FROM event_x WHERE sub = 'ClickEvent'",
    "t_replay_view_event": "SELECT id, user_id, value FROM event_x WHERE sub = 'ViewEvent'",
    "t_replay_purchase_event": "SELECT id, user_id, value FROM event_x WHERE sub = 'PurchaseEvent'",
    "t_replay_signup_event": "SELECT id, user_id, value FROM event_x WHERE sub = 'SignupEvent'",
}


# keys -----------------------------------------------------------------------------
def k_dense_id(spark, d):
    o = orders_s(spark, d).select(F.col("id").alias("orderkey"), "orderdate")
    return dense_id(o, ["orderdate", "orderkey"], "dense_id")


def k_dense_id_nested(spark, d):
    out = dense_id_nested(orders_nested(spark, d), "id", "lines", "item_id")
    return out.select("item_id", F.col("id").alias("order_id"), "pos", F.col("item.partkey").alias("partkey"))


def k_last_wins(spark, d):
    e = load(spark, d, "events").select(F.col("user_id").alias("id"), "event_type", "value",
                                        F.col("event_id").alias("_seq"))
    return last_wins(e, "id", "_seq").select("id", "event_type", "value")


def k_position_in_group(spark, d):
    li = line_child(spark, d, False)
    return position_in_group(li, "order_id", CHILD_ORDER, "pos").select("order_id", "linenumber", "partkey", "pos")


# relabel --------------------------------------------------------------------------
def _relabel_set(spark, d):
    return {"Customer": customer_s(spark, d), "Nation": nation_s(spark, d), "Region": region_s(spark, d)}


RELABEL_SEED = 11


def o_relabel(spark, d):
    out, em, _ = relabel(_relabel_set(spark, d), RELABEL_SEED)
    return out[em["Customer"]]


def _sql_relabel() -> str:
    cols = {"Customer": ["id", "name", "nation_key", "acctbal", "segment"], "Nation": ["id", "name", "region_id"],
            "Region": ["id", "name"]}
    _, fm = relabel_maps(cols, RELABEL_SEED)
    sel = ", ".join(f"{c} AS {fm['Customer'][c]}" for c in cols["Customer"])
    return f"{W} SELECT {sel} FROM customer_s"


def o_relabel_roundtrip(spark, d):
    out, em, fm = relabel(_relabel_set(spark, d), RELABEL_SEED)
    return translate_back(out, em, fm)["Customer"]


STATUS_MAP = {"F": "FULFILLED", "O": "OPEN", "P": "PENDING"}


def o_enum_unmap(spark, d):
    o = orders_s(spark, d).select("id", remap(F.col("status"), STATUS_MAP).alias("status"))
    return o.select("id", remap(F.col("status"), inverse_map(STATUS_MAP)).alias("status"))


# expression shapes seen in migration scripts ---------------------------------------
def p_nested_project(spark, d):
    o = orders_nested(spark, d)
    proj = F.transform("lines", lambda x: F.struct(x["partkey"].alias("part"), x["quantity"].alias("qty")))
    o = o.select("id", proj.alias("items"))
    return o.select("id", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"),
                    F.aggregate("items", F.lit(0.0), lambda acc, x: acc + x["qty"]).alias("qty_total"),
                    F.element_at("items", 1)["part"].alias("first_part"))


SQL_NESTED_PROJECT = (W + "SELECT o.id, CAST(coalesce(g.n, 0) AS INTEGER) AS n_items, g.qty AS qty_total, "
                      "g.first_part FROM orders_s o LEFT JOIN (SELECT order_id, count(*) AS n, sum(quantity) AS qty, "
                      "max(CASE WHEN pos = 0 THEN partkey END) AS first_part FROM lines_s GROUP BY order_id) g "
                      "ON g.order_id = o.id")


def p_null_column(spark, d):
    return customer_s(spark, d).select("id", F.lit(None).cast("string").alias("note"),
                                       F.array().cast("array<string>").alias("tags"))


def p_value_map_strict(spark, d):
    return orders_s(spark, d).select("id", remap(F.col("priority"), {"1-URGENT": "high", "2-HIGH": "high"},
                                                 "null").alias("level"))


def p_value_map_suffix(spark, d):
    return orders_s(spark, d).select("id", remap(F.col("status"), {"F": "done"}, "suffix", "_v2").alias("status"))


def p_presence_flags(spark, d):
    o = orders_nested(spark, d)
    return o.select("id", (F.coalesce(F.size("lines"), F.lit(0)) > 0).alias("has_lines"),
                    F.col("priority").isNotNull().alias("has_priority"),
                    F.col("priority").eqNullSafe("1-URGENT").alias("is_urgent"))


def p_fan_out(spark, d):
    """One source table written as three narrower ones (a pass each, reading its own columns)."""
    c = customer_s(spark, d)
    outs = {"CustomerCore": c.select("id", F.concat_ws("/", "name", "segment").alias("v")),
            "CustomerMoney": c.select("id", F.round(F.col("acctbal") * 100).cast("bigint").cast("string").alias("v")),
            "CustomerPlace": c.select("id", F.col("nation_key").cast("string").alias("v"))}
    frames = [df.select(F.lit(k).alias("table_name"), "id", "v") for k, df in outs.items()]
    return frames[0].union(frames[1]).union(frames[2])


def queries() -> dict:
    return {
        "t_rename": _one("Customer", customer_s, [{"type": "rename", "entity": "Customer", "from": "name", "to": "full_name"},
                                                  {"type": "rename", "entity": "Customer", "from": "segment",
                                                   "to": "market_segment"}]),
        "t_retype_num_text": _one("Customer", customer_s, [{"type": "retype", "entity": "Customer", "field": "acctbal",
                                                            "from": "number", "to": "text"}]),
        "t_retype_num_bool": _one("Nation", nation_s, [{"type": "retype", "entity": "Nation", "field": "region_id",
                                                        "from": "number", "to": "bool"}]),
        "t_retype_bool_num": _one("Customer", customer_flag, [{"type": "retype", "entity": "Customer",
                                                               "field": "positive", "from": "bool", "to": "number"}]),
        "t_retype_date_text": _one("Orders", orders_dated, [{"type": "retype", "entity": "Orders", "field": "orderdate",
                                                             "from": "date", "to": "text"}]),
        "t_retype_text_richtext": _one("Customer", customer_s, [{"type": "retype", "entity": "Customer", "field": "name",
                                                                 "from": "text", "to": "richtext"}]),
        "t_enum_remap": _one("Orders", orders_s, [{"type": "enum_remap", "entity": "Orders", "field": "status",
                                                   "mapping": {"F": "FULFILLED", "O": "OPEN"}}]),
        "t_unmapped": _one("Customer", customer_s, [{"type": "unmapped", "entity": "Customer", "field": "acctbal"}]),
        "t_flatten_count": _one("Orders", orders_nested, [{"type": "flatten_nested", "entity": "Orders", "field": "lines",
                                                           "block": "LineBlock", "into": "lines_count"}]),
        "t_split_parent": _one("Customer", customer_s, [{"type": "split", "from": "Customer",
                                                         "into": ["Customer", "CustomerDetail"],
                                                         "moved_fields": ["acctbal", "segment"],
                                                         "link_field": "customer_id"}]),
        "t_split_detail": _one("Customer", customer_s, [{"type": "split", "from": "Customer",
                                                         "into": ["Customer", "CustomerDetail"],
                                                         "moved_fields": ["acctbal", "segment"],
                                                         "link_field": "customer_id"}], "CustomerDetail"),
        "t_merge_first_child": t_merge_first_child,
        "t_merge_collision": t_merge_collision,
        "t_extract_child": _one("Orders", orders_nested, [{"type": "extract_nested", "entity": "Orders", "field": "lines",
                                                           "block": "LineBlock", "new_entity": "OrderLine",
                                                           "link_field": "order_id"}], "OrderLine"),
        "t_extract_parent": _one("Orders", orders_nested, [{"type": "extract_nested", "entity": "Orders",
                                                            "field": "lines", "block": "LineBlock",
                                                            "new_entity": "OrderLine", "link_field": "order_id"}]),
        "t_partition_routed": t_partition_routed,
        "t_partition_click": t_partition_click,
        "t_denormalize": t_denormalize,
        "t_denormalize_orphan": t_denormalize_orphan,
        "t_computed_concat": _one("Customer", customer_s, [{"type": "computed", "entity": "Customer",
                                                            "operation": "concat", "source_fields": ["name", "nation_key"],
                                                            "separator": "#", "dest_field": "label"}]),
        "t_computed_multiply": _one("Part", part_s, [{"type": "computed", "entity": "Part", "operation": "multiply",
                                                      "source_fields": ["size", "retailprice"],
                                                      "dest_field": "size_x_price"}]),
        "t_computed_sum": _one("Part", part_s, [{"type": "computed", "entity": "Part", "operation": "sum_fields",
                                                 "source_fields": ["size", "id"], "dest_field": "size_plus_id"}]),
        "t_computed_bool": _one("Customer", customer_s, [{"type": "computed", "entity": "Customer",
                                                          "operation": "bool_from_enum", "source_field": "segment",
                                                          "value": "BUILDING", "dest_field": "is_building"}]),
        "t_replay_full": t_replay_full,
        "t_replay_customer": _replayed("Customer"),
        "t_replay_customer_detail": _replayed("CustomerDetail"),
        "t_replay_order_line": _replayed("OrderLine"),
        "t_replay_region_nation": _replayed("RegionNation"),
        "t_replay_supplier": _replayed("Supplier"),
        "t_replay_click_event": _replayed("ClickEvent"),
        "t_replay_view_event": _replayed("ViewEvent"),
        "t_replay_purchase_event": _replayed("PurchaseEvent"),
        "t_replay_signup_event": _replayed("SignupEvent"),
        "k_dense_id": k_dense_id,
        "k_dense_id_nested": k_dense_id_nested,
        "k_last_wins": k_last_wins,
        "k_position_in_group": k_position_in_group,
        "o_relabel": o_relabel,
        "o_relabel_roundtrip": o_relabel_roundtrip,
        "o_enum_unmap": o_enum_unmap,
        "p_nested_project": p_nested_project,
        "p_null_column": p_null_column,
        "p_value_map_strict": p_value_map_strict,
        "p_value_map_suffix": p_value_map_suffix,
        "p_presence_flags": p_presence_flags,
        "p_fan_out": p_fan_out,
    }


def oracles() -> dict:
    return {
        "t_rename": W + "SELECT id, name AS full_name, nation_key, acctbal, segment AS market_segment FROM customer_s",
        "t_retype_num_text": W + "SELECT id, name, nation_key, CAST(acctbal AS VARCHAR) AS acctbal, segment FROM customer_s",
        "t_retype_num_bool": W + "SELECT id, name, region_id <> 0 AS region_id FROM nation_s",
        "t_retype_bool_num": W + "SELECT id, name, nation_key, acctbal, segment, CAST(acctbal > 0 AS BIGINT) AS positive "
                                 "FROM customer_s",
        "t_retype_date_text": "SELECT o_orderkey AS id, o_orderstatus AS status, "
                              "strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS orderdate FROM orders",
        "t_retype_text_richtext": W + "SELECT * FROM customer_s",
        "t_enum_remap": W + "SELECT id, customer_id, CASE status WHEN 'F' THEN 'FULFILLED' WHEN 'O' THEN 'OPEN' "
                            "ELSE status END AS status, totalprice, orderdate, priority FROM orders_s",
        "t_unmapped": W + "SELECT id, name, nation_key, segment FROM customer_s",
        "t_flatten_count": W + "SELECT o.*, CAST(coalesce(n.cnt, 0) AS BIGINT) AS lines_count FROM orders_s o LEFT JOIN "
                               "(SELECT order_id, count(*) AS cnt FROM lines_s GROUP BY order_id) n ON n.order_id = o.id",
        "t_split_parent": W + "SELECT id, name, nation_key FROM customer_s",
        "t_split_detail": W + "SELECT row_number() OVER (ORDER BY id) AS id, id AS customer_id, acctbal, segment "
                              "FROM customer_s",
        "t_merge_first_child": SQL_MERGE_FIRST,
        "t_merge_collision": SQL_MERGE_COLLISION,
        "t_extract_child": W + "SELECT row_number() OVER (ORDER BY order_id, pos) AS id, order_id, linenumber, partkey, "
                               "quantity, price, returnflag FROM lines_s",
        "t_extract_parent": W + "SELECT * FROM orders_s",
        "t_partition_routed": SQL_PART_ROUTED,
        "t_partition_click": W + "SELECT id, user_id, value FROM event_s WHERE event_type = 'click'",
        "t_denormalize": W + "SELECT c.id, c.name, c.nation_key AS nation_id, c.acctbal, c.segment, n.name AS nation_name, "
                             "n.region_id AS nation_region FROM customer_s c LEFT JOIN nation_s n ON n.id = c.nation_key",
        "t_denormalize_orphan": W + "SELECT c.id, c.name, c.nation_key AS nation_id, c.acctbal, c.segment, "
                                    "r.name AS region_name FROM customer_s c LEFT JOIN region_s r ON r.id = c.nation_key",
        "t_computed_concat": W + "SELECT *, name || '#' || CAST(nation_key AS VARCHAR) AS label FROM customer_s",
        "t_computed_multiply": "SELECT p_partkey AS id, p_name AS name, CAST(p_size AS BIGINT) AS size, "
                               "p_retailprice AS retailprice, CAST(p_size AS DOUBLE) * p_retailprice AS size_x_price "
                               "FROM part",
        "t_computed_sum": "SELECT p_partkey AS id, p_name AS name, CAST(p_size AS BIGINT) AS size, "
                          "p_retailprice AS retailprice, CAST(p_size AS BIGINT) + p_partkey AS size_plus_id FROM part",
        "t_computed_bool": W + "SELECT *, segment = 'BUILDING' AS is_building FROM customer_s",
        "t_replay_full": SQL_REPLAY_FULL,
        **{k: f"WITH {SQL_VS} {q}" for k, q in SQL_REPLAY.items()},
        "k_dense_id": W + "SELECT id AS orderkey, orderdate, row_number() OVER (ORDER BY orderdate, id) AS dense_id "
                          "FROM orders_s",
        "k_dense_id_nested": W + "SELECT row_number() OVER (ORDER BY order_id, pos) AS item_id, order_id, "
                                 "CAST(pos AS INTEGER) AS pos, partkey FROM lines_s",
        "k_last_wins": "SELECT user_id AS id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value "
                       "FROM events GROUP BY user_id",
        "k_position_in_group": W + "SELECT order_id, linenumber, partkey, pos FROM lines_s",
        "o_relabel": _sql_relabel(),
        "o_relabel_roundtrip": W + "SELECT * FROM customer_s",
        "o_enum_unmap": W + "SELECT id, status FROM orders_s",
        "p_nested_project": SQL_NESTED_PROJECT,
        "p_null_column": W + "SELECT id, CAST(NULL AS VARCHAR) AS note, CAST([] AS VARCHAR[]) AS tags FROM customer_s",
        "p_value_map_strict": W + "SELECT id, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'high' END AS level "
                                  "FROM orders_s",
        "p_value_map_suffix": W + "SELECT id, CASE WHEN status = 'F' THEN 'done' ELSE status || '_v2' END AS status "
                                  "FROM orders_s",
        "p_presence_flags": W + "SELECT o.id, coalesce(n.cnt, 0) > 0 AS has_lines, o.priority IS NOT NULL AS has_priority, "
                                "coalesce(o.priority = '1-URGENT', false) AS is_urgent FROM orders_s o LEFT JOIN "
                                "(SELECT order_id, count(*) AS cnt FROM lines_s GROUP BY order_id) n ON n.order_id = o.id",
        "p_fan_out": W + "SELECT 'CustomerCore' AS table_name, id, name || '/' || segment AS v FROM customer_s UNION ALL "
                         "SELECT 'CustomerMoney', id, CAST(CAST(round(acctbal * 100) AS BIGINT) AS VARCHAR) FROM customer_s "
                         "UNION ALL SELECT 'CustomerPlace', id, CAST(nation_key AS VARCHAR) FROM customer_s",
    }
