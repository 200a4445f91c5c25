"""Audit, constraint, source and sink queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import BatchWriter, read_jsonl, read_runs, read_table_set, scratch_path, write_jsonl, write_runs
from ..operators.keys import last_wins
from ..operators.transforms import apply_log
from ..sources.storage import stored
from ..spec import Schema, log_from_dicts
from . import audit, constraints
from .catalog_verify import CHECK_SQL, ROUND, vs_verifier, vs_written_verifier
from .scenario import SQL_SOURCES, SQL_VS, load, orders_nested, vs_dest, vs_source
from .verify import Verifier

W = f"WITH {SQL_SOURCES} "
R6 = 6


# ---------------------------------------------------------------------------
# runs: one row per event, read as a scored run
# ---------------------------------------------------------------------------
def runs_s(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    err = F.col("value") > 450
    return e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("model"),
                    F.when(F.col("user_id") < 75, 2).otherwise(3).alias("tier"), F.col("user_id").alias("task_id"),
                    F.when(~err, F.col("value")).alias("total"), err.alias("error"), F.col("event_id").alias("seq"),
                    F.when(~err, F.least(F.col("value") / 500.0, F.lit(1.0))).alias("coverage"))


SQL_RUNS = """runs AS (SELECT event_id AS run_id, event_type AS model, CASE WHEN user_id < 75 THEN 2 ELSE 3 END AS tier,
  user_id AS task_id, CASE WHEN value > 450 THEN NULL ELSE value END AS total, value > 450 AS error, event_id AS seq,
  CASE WHEN value > 450 THEN NULL ELSE least(value / 500.0, 1.0) END AS coverage FROM events)"""
MODELS = ["click", "error", "purchase", "signup", "view"]


def _r(df: DataFrame, cols, n=R6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


def a_output_summary(spark, d):
    return audit.output_summary(vs_dest(spark, d))


SUMMARY_BODY = """SELECT 'Customer' AS table_name, count(*) AS n_rows, count(DISTINCT id) AS unique_ids, count(*) - count(DISTINCT id) AS duplicates FROM customer_d
UNION ALL SELECT 'CustomerDetail', count(*), count(DISTINCT id), count(*) - count(DISTINCT id) FROM detail_d
UNION ALL SELECT 'Orders', count(*), count(DISTINCT id), count(*) - count(DISTINCT id) FROM orders_d
UNION ALL SELECT 'OrderLine', count(*), count(DISTINCT id), count(*) - count(DISTINCT id) FROM orderline_d
UNION ALL SELECT 'RegionNation', count(*), count(DISTINCT id), count(*) - count(DISTINCT id) FROM regionnation_d
UNION ALL SELECT 'Supplier', count(*), count(DISTINCT id), count(*) - count(DISTINCT id) FROM supplier_d
UNION ALL SELECT sub, count(*), count(DISTINCT id), count(*) - count(DISTINCT id) FROM sub_d GROUP BY sub"""
SQL_OUTPUT_SUMMARY = f"WITH {SQL_VS}\n{SUMMARY_BODY}"


def a_shotgun(spark, d):
    return audit.shotgun(vs_source(spark, d), vs_dest(spark, d))


SQL_SHOTGUN = f"""WITH {SQL_VS}, t AS ({SUMMARY_BODY}),
src AS (SELECT (SELECT count(*) FROM region_s) + (SELECT count(*) FROM nation_s) + (SELECT count(*) FROM customer_s)
             + (SELECT count(*) FROM orders_s) + (SELECT count(*) FROM event_s) + (SELECT count(*) FROM supplier_s) AS n)
SELECT t.table_name, t.n_rows, src.n AS source_rows, t.n_rows = src.n AS shotgun FROM t, src"""


def a_partition_ablation(spark, d):
    out = audit.partition_ablation(vs_written_verifier(spark, d), "Event")
    return _r(out, [c for c in out.columns if c != "scenario"], ROUND)


def _sql_ablation() -> str:
    subs = ["ClickEvent", "PurchaseEvent", "SignupEvent", "ViewEvent"]
    scen = {"all": subs, "none": []}
    for s in subs:
        scen[f"without_{s}"] = [x for x in subs if x != s]
        scen[f"only_{s}"] = [s]
    ctes, rows = [], []
    body = "\nUNION ALL\n".join(p for parts in CHECK_SQL.values() for p in parts)
    for i, (name, kept) in enumerate(sorted(scen.items())):
        cond = "sub IN (" + ", ".join(f"'{k}'" for k in kept) + ")" if kept else "false"
        ctes.append(f"sub_k{i} AS (SELECT * FROM sub_d WHERE {cond})")
        rows.append(f"SELECT '{name}' AS scenario, axis, hits, total FROM ({body.replace('sub_d', f'sub_k{i}')})")
    r = "\nUNION ALL\n".join(rows)
    ratio = lambda ax: (f"coalesce(max(CASE WHEN axis = '{ax}' THEN CASE WHEN t = 0 THEN 1.0 ELSE h / t END END), 1.0)")
    return f"""WITH {SQL_VS}, {', '.join(ctes)},
r AS ({r}),
s AS (SELECT scenario, axis, sum(hits) AS h, sum(total) AS t FROM r GROUP BY scenario, axis),
a AS (SELECT scenario, {ratio('coverage')} AS coverage, {ratio('field_fidelity')} AS field_fidelity,
        {ratio('relationship_integrity')} AS relationship_integrity, {ratio('type_correctness')} AS type_correctness,
        {ratio('structural')} AS structural FROM s GROUP BY scenario)
SELECT scenario, round(coverage, {ROUND}) AS coverage, round(field_fidelity, {ROUND}) AS field_fidelity,
  round(relationship_integrity, {ROUND}) AS relationship_integrity, round(type_correctness, {ROUND}) AS type_correctness,
  round(structural, {ROUND}) AS structural,
  round((coverage * 0.2 + field_fidelity * 0.3 + relationship_integrity * 0.3 + type_correctness * 0.2)
        * (0.2 + 0.8 * structural) * 100.0, {ROUND}) AS total
FROM a"""


def a_group_stats(spark, d):
    return _r(audit.group_stats(runs_s(spark, d)), ["mean"])


def a_ranking(spark, d):
    return audit.ranking(runs_s(spark, d))


def a_score_pivot(spark, d):
    return _r(audit.score_pivot(runs_s(spark, d), [2, 3]), ["tier_2", "tier_3", "overall"])


def a_metric_pivot(spark, d):
    return _r(audit.metric_pivot(runs_s(spark, d), ["total", "coverage"], MODELS), MODELS)


def a_reward_variance(spark, d):
    return _r(audit.reward_variance(runs_s(spark, d)), ["variance"])


def a_any_variance(spark, d):
    return audit.any_variance(runs_s(spark, d))


FLAT = {"Region": ["id", "name"], "Nation": ["id", "name", "region_id"], "Customer": ["id", "name", "nation_key", "segment"],
        "Event": ["event_type", "id", "user_id"]}


def a_fingerprint(spark, d):
    """Fingerprints of flat source tables, Event with every third user taken for unknown (null)."""
    src = vs_source(spark, d)
    tables = {t: src[t].select(*cols) for t, cols in FLAT.items()}
    tables["Event"] = tables["Event"].withColumn("user_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")))
    return audit.fingerprint(tables)


def _sql_fingerprint() -> str:
    part = []
    for t, cols in FLAT.items():
        value = {c: c for c in cols} | ({"user_id": "CASE WHEN user_id % 3 <> 0 THEN user_id END"} if t == "Event" else {})
        text = " || ".join(f"coalesce(CAST(length(CAST({value[c]} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value[c]} AS VARCHAR), 'n')"
                           for c in sorted(cols))
        part.append(f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(sha256({text}), 1, 15)) AS BIGINT)) "
                    f"AS DECIMAL(38,0)) AS row_hash_sum FROM {t.lower()}_s")
    return W + "\nUNION ALL\n".join(part)


# ---------------------------------------------------------------------------
# constraints
# ---------------------------------------------------------------------------
def c_pk(spark, d):
    li = load(spark, d, "lineitem")
    o = load(spark, d, "orders")
    return constraints.pk_check(li, ["l_orderkey", "l_linenumber"], "lineitem(l_orderkey,l_linenumber)").union(
        constraints.pk_check(o, "o_orderkey", "orders(o_orderkey)"))


SQL_PK = """SELECT 'lineitem(l_orderkey,l_linenumber)' AS key, sum(n) AS n_rows, CAST(0 AS BIGINT) AS null_keys,
  count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS duplicated_keys, sum(n - 1) AS surplus_rows
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
UNION ALL
SELECT 'orders(o_orderkey)', sum(n), 0, count(*), count(*) FILTER (WHERE n > 1), sum(n - 1)
FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1)"""


def c_fk_orphans(spark, d):
    o, c, li = load(spark, d, "orders"), load(spark, d, "customer"), load(spark, d, "lineitem")
    r = load(spark, d, "region")
    return (constraints.fk_orphans(o, "o_custkey", c, "c_custkey", "orders.o_custkey")
            .union(constraints.fk_orphans(li, "l_orderkey", o, "o_orderkey", "lineitem.l_orderkey"))
            .union(constraints.fk_orphans(c, "c_nationkey", r, "r_regionkey", "customer.c_nationkey->region")))


def _sql_fk(label, child, fk, parent, pk):
    return (f"SELECT '{label}' AS ref, count(*) AS n_rows, count(*) FILTER (WHERE {fk} IS NULL) AS null_refs, "
            f"count(*) FILTER (WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {parent})) AS orphan_rows, "
            f"count(DISTINCT CASE WHEN {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {parent}) THEN {fk} END) "
            f"AS orphan_values FROM {child}")


SQL_FK = "\nUNION ALL\n".join([
    _sql_fk("orders.o_custkey", "orders", "o_custkey", "customer", "c_custkey"),
    _sql_fk("lineitem.l_orderkey", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    _sql_fk("customer.c_nationkey->region", "customer", "c_nationkey", "region", "r_regionkey")])


def c_enum_domain(spark, d):
    o = load(spark, d, "orders")
    return constraints.enum_domain(o, "o_orderstatus", ["F", "O"]).union(
        constraints.enum_domain(o, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]))


SQL_ENUM = """SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n_rows FROM orders
WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY o_orderstatus"""


# ---------------------------------------------------------------------------
# sources and sinks
# ---------------------------------------------------------------------------
TPCH = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


TEXT_OF = {"region": "r_name", "nation": "n_name", "customer": "c_name", "supplier": "s_name", "part": "p_name",
           "orders": "o_orderstatus", "lineitem": "l_returnflag", "events": "event_type"}


def s_read(spark, d):
    """Rows, columns, the sum of the first column and the length of one text column of every table read."""
    out = None
    for n, df in read_table_set(spark, d, TPCH).items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(df.columns[0]).cast("bigint").alias("key_sum"),
                      F.sum(F.char_length(TEXT_OF[n])).alias("text_chars")).select(
            F.lit(n).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"), "key_sum", "text_chars")
        out = part if out is None else out.union(part)
    return out


def _sql_read() -> str:
    n_cols = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6}
    key = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
           "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id"}
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST({n_cols[t]} AS BIGINT) AS n_cols, CAST(sum({key[t]}) AS BIGINT) AS key_sum, "
        f"CAST(sum(length({TEXT_OF[t]})) AS BIGINT) AS text_chars FROM {t}" for t in TPCH)


def k_last_in_batch(spark, d):
    """Several versions of an id written in one batch: the last one in write order wins."""
    w = BatchWriter(spark, scratch_path(spark, "versions"))
    e = load(spark, d, "events").select(F.col("user_id").alias("id"), "event_type", "event_id")
    w.write("User", e, ["event_id"])
    back = w.read("User")
    last = last_wins(back.select("id", "event_type", "_seq"), "id", "_seq").select("id", "event_type")
    n = back.groupBy(F.col("id").alias("__id")).agg(F.count(F.lit(1)).alias("n_written"))
    return last.join(n, last["id"].eqNullSafe(n["__id"])).select("id", "event_type", "n_written")


EXTRACT_SCHEMA = Schema.from_dict({
    "entities": {"Orders": {"fields": {"id": {"kind": "id"}, "lines": {"kind": "nested", "of": "LineBlock"}}}},
    "nested_blocks": {"LineBlock": {"fields": {"linenumber": {"kind": "number"}, "partkey": {"kind": "number"}}}}})
EXTRACT_LOG = log_from_dicts([{"type": "extract_nested", "entity": "Orders", "field": "lines", "block": "LineBlock",
                               "new_entity": "OrderLine", "link_field": "order_id"}])


def s_batch_scored(spark, d):
    """A perfect extract written as appended batches (parents in two, children in one) scores 100."""
    src = {"Orders": orders_nested(spark, d).select("id", "lines")}
    dest = apply_log(src, EXTRACT_LOG, blocks={"LineBlock": ["linenumber", "partkey"]})
    w = BatchWriter(spark, scratch_path(spark, "batches"))
    n = [w.write("Orders", dest["Orders"].where(F.col("id") % 2 == k)) for k in (0, 1)]
    n.append(w.write("OrderLine", dest["OrderLine"]))
    report = Verifier(EXTRACT_SCHEMA, EXTRACT_LOG, src, w.tables()).report()
    return report.select(F.lit(n[0] + n[1]).cast("bigint").alias("n_parents"), F.lit(n[2]).cast("bigint").alias("n_children"),
                         F.round("total", ROUND).alias("total"))


BATCHES = [["click", "view"], ["purchase", "signup"], ["error"]]


def s_append_batches(spark, d):
    """Events written as three appended batches, read back with their batch number."""
    w = BatchWriter(spark, scratch_path(spark, "batches"))
    e = load(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value")
    for kinds in BATCHES:
        w.write("Event", e.filter(F.col("event_type").isin(kinds)), ["id"])
    return w.read("Event").select("id", "user_id", "event_type", "value", "_batch")


SQL_APPEND = """SELECT event_id AS id, user_id, event_type, value,
  CASE WHEN event_type IN ('click', 'view') THEN 0 WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 2 END AS _batch
FROM events"""


def s_jsonl(spark, d):
    path = scratch_path(spark, "jsonl")
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props")
    write_jsonl(e, path)
    return read_jsonl(spark, path, "event_id bigint, user_id bigint, event_type string, value double, props string")


def s_run_results(spark, d):
    path = scratch_path(spark, "runs")
    r = runs_s(spark, d)
    steps = F.array(F.struct(F.lit("score").alias("name"), F.col("total").alias("value")),
                    F.struct(F.lit("coverage").alias("name"), F.col("coverage").alias("value")))
    write_runs(r.select("run_id", "model", "tier", steps.alias("steps")), path)
    back = read_runs(spark, path, "run_id bigint, model string, tier int, "
                                  "steps array<struct<name:string,value:double>>")
    return back.select("run_id", "model", "tier", F.size("steps").alias("n_steps"),
                       F.col("steps")[0]["value"].alias("score"))


# ---------------------------------------------------------------------------
# streaming
# ---------------------------------------------------------------------------
STREAM_LOG = [
    {"type": "rename", "entity": "Event", "from": "value", "to": "amount"},
    {"type": "enum_remap", "entity": "Event", "field": "event_type",
     "mapping": {"click": "Click", "view": "View", "purchase": "Purchase", "signup": "Signup"}},
    {"type": "computed", "entity": "Event", "operation": "bool_from_enum", "source_field": "event_type",
     "value": "Purchase", "dest_field": "is_purchase"},
    {"type": "denormalize", "entity": "Event", "via_field": "user_id", "from_entity": "Customer",
     "inlined": [{"source_field": "segment", "dest_field": "user_segment"}]},
]
STREAM_PART = {"type": "partition", "entity": "Event", "on_field": "event_type",
               "mapping": {"Click": "ClickEvent", "View": "ViewEvent", "Purchase": "PurchaseEvent"}}


def st_event_stream(spark, d):
    """Events replayed as a stream (micro-batches of files), routed into sub-table folders."""
    from ..spec import log_from_dicts, step_from_dict
    from ..streaming import replay_stream, route_stream, run_to_table
    from .scenario import customer_s

    schema = load(spark, d, "events").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(d)
              .select(F.col("event_id").alias("id"), "user_id", "event_type", "value"))
    out = replay_stream(stream, "Event", log_from_dicts(STREAM_LOG), {"Customer": customer_s(spark, d)})
    routed = route_stream(out, step_from_dict(STREAM_PART)).withColumnRenamed("__mg_sub", "sub")
    path = scratch_path(spark, "stream-events")
    return run_to_table(spark, routed, path, ["sub"], name=path.rsplit("/", 1)[-1])


SQL_STREAM = W + """SELECT e.id, e.user_id, e.value AS amount, e.event_type = 'purchase' AS is_purchase,
  c.segment AS user_segment,
  CASE e.event_type WHEN 'click' THEN 'ClickEvent' WHEN 'view' THEN 'ViewEvent' WHEN 'purchase' THEN 'PurchaseEvent' END AS sub
FROM event_s e LEFT JOIN customer_s c ON c.id = e.user_id WHERE e.event_type IN ('click', 'view', 'purchase')"""


# ---------------------------------------------------------------------------
# record bags
# ---------------------------------------------------------------------------
EVENT_SCHEMA = Schema.from_dict({"entities": {"Event": {"fields": {
    "id": {"kind": "id"}, "user_id": {"kind": "number"},
    "event_type": {"kind": "enum", "values": ["click", "error", "purchase", "signup", "view"]},
    "value": {"kind": "number"}}}}})


def s_record_bag(spark, d):
    """Events written as JSON lines by a sloppy script (views carry the value as text, errors a null
    user), read back as a record bag and scored against the events table."""
    from ..sources.records import read_records

    e = load(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value")
    line = F.concat(
        F.lit('{"id": '), F.col("id").cast("string"),
        F.lit(', "user_id": '), F.when(F.col("event_type") == "error", F.lit("null"))
        .otherwise(F.col("user_id").cast("string")),
        F.lit(', "event_type": "'), F.col("event_type"),
        F.lit('", "value": '), F.when(F.col("event_type") == "view", F.concat(F.lit('"'), F.col("value").cast("string"),
                                                                                 F.lit('"')))
        .otherwise(F.col("value").cast("string")), F.lit("}"))
    path = scratch_path(spark, "records")
    e.select(line.alias("value")).write.mode("overwrite").text(path)
    dest = {"Event": read_records(spark, path)}
    out = Verifier(EVENT_SCHEMA, [], {"Event": e}, dest).checks()
    return out.select("axis", "check", "entity", "step", F.round("hits", ROUND).alias("hits"),
                      F.round("total", ROUND).alias("total"))


SQL_RECORD_BAG = """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS v,
                         count(*) FILTER (WHERE event_type = 'error') AS e FROM events)
SELECT 'coverage' AS axis, 'v_cov_recall' AS "check", 'Event' AS entity, CAST(NULL AS INTEGER) AS step,
       CAST(n AS DOUBLE) AS hits, CAST(n AS DOUBLE) AS total FROM c
UNION ALL SELECT 'coverage', 'v_cov_false_pos', 'Event', NULL, 0.0, 0.0 FROM c
UNION ALL SELECT 'field_fidelity', 'v_fid_base', 'Event', NULL, CAST(4 * n - v - e AS DOUBLE), CAST(4 * n AS DOUBLE) FROM c
UNION ALL SELECT 'type_correctness', 'v_type', 'Event', NULL, CAST(4 * n - v - e AS DOUBLE), CAST(4 * n AS DOUBLE) FROM c"""


# ---------------------------------------------------------------------------
# order-keeping records, relabelled records, loads, commit log, extract on a stream
# ---------------------------------------------------------------------------
def _checks(v: Verifier) -> DataFrame:
    return v.checks().select("axis", "check", "entity", "step", F.round("hits", ROUND).alias("hits"), F.round("total", ROUND).alias("total"))


def s_record_sink(spark, d):
    """A perfect extract written as JSON lines from many partitions and read back as records, all checks."""
    from ..sources.records import read_record_set, write_record_set

    # the arrays are built once: writing and every check read them
    src = {"Orders": stored(orders_nested(spark, d).select("id", "lines"), "source-Orders")}
    dest = apply_log(src, EXTRACT_LOG, blocks={"LineBlock": ["linenumber", "partkey"]})
    path = scratch_path(spark, "records")
    write_record_set(dict(dest.items()), path)
    back = read_record_set(spark, path, {"Orders": ["id", "lines"], "OrderLine": ["id", "order_id", "linenumber", "partkey"]})
    return _checks(Verifier(EXTRACT_SCHEMA, EXTRACT_LOG, src, back)).where("total > 0")


SQL_RECORD_SINK = W + """, c AS (SELECT (SELECT count(*) FROM orders_s) AS p, (SELECT count(*) FROM lines_s) AS n),
r AS (SELECT 'coverage' AS axis, 'v_cov_extract' AS "check", 'OrderLine' AS entity, 0 AS step, n AS v FROM c
  UNION ALL SELECT 'structural', 'v_str_presence', 'OrderLine', 0, 1 FROM c UNION ALL SELECT 'relationship_integrity', 'v_rel_extract_link', 'OrderLine', 0, n FROM c
  UNION ALL SELECT 'field_fidelity', 'v_fid_extract', 'OrderLine', 0, 2 * n FROM c UNION ALL SELECT 'coverage', 'v_cov_recall', 'Orders', NULL, p FROM c
  UNION ALL SELECT 'field_fidelity', 'v_fid_base', 'Orders', NULL, p FROM c UNION ALL SELECT 'type_correctness', 'v_type', 'OrderLine', NULL, 4 * n FROM c
  UNION ALL SELECT 'type_correctness', 'v_type', 'Orders', NULL, p FROM c)
SELECT axis, "check", entity, step, CAST(v AS DOUBLE) AS hits, CAST(v AS DOUBLE) AS total FROM r"""
SQL_STRICT = W + """SELECT * FROM (SELECT 'array_left_after_extract' AS issue, 'Orders' AS table_name, 'lines' AS column_name,
    (SELECT count(DISTINCT l.order_id) FROM lines_s l JOIN orders_s o ON o.id = l.order_id WHERE l.order_id % 3 = 0) AS n_rows
  UNION ALL SELECT 'duplicate_ids', 'Event', 'id', (SELECT count(*) FROM events WHERE event_id % 50 = 0)
  UNION ALL SELECT 'expected_column_missing', 'Event', 'user_id', (SELECT count(*) + count(*) FILTER (WHERE event_id % 50 = 0) FROM events)
  UNION ALL SELECT 'expected_column_missing', 'OrderLine', 'partkey', (SELECT count(*) FROM lines_s)
  UNION ALL SELECT 'enum_out_of_domain', 'Event', 'event_type', (SELECT count(*) FROM events WHERE event_id % 10 = 1)) WHERE n_rows > 0"""
SQL_LOAD = W + """, g AS (SELECT 0 AS wave, 'Region' AS table_name, (SELECT count(*) FROM region) AS n_rows, CAST(NULL AS VARCHAR) AS ref, 0 AS orphan_rows, true AS published
  UNION ALL SELECT 0, 'Customer', (SELECT count(*) FROM customer_s), NULL, 0, true UNION ALL SELECT 0, 'Supplier', (SELECT count(*) FROM supplier), NULL, 0, true
  UNION ALL SELECT 1, 'Nation', (SELECT count(*) FROM nation), 'Nation.region_id', 0, p FROM (SELECT unnest([true, false]) AS p)
  UNION ALL SELECT 1, 'Orders', (SELECT count(*) FROM orders_s), 'Orders.customer_id', CASE WHEN p THEN 0 ELSE (SELECT count(*) FROM orders WHERE o_custkey % 100 = 1) END, p FROM (SELECT unnest([true, false]) AS p)
  UNION ALL SELECT 1, 'Event', (SELECT count(*) FROM events), 'Event.user_id', CASE WHEN p THEN 0 ELSE (SELECT count(*) FROM events WHERE user_id % 100 = 1) END, p FROM (SELECT unnest([true, false]) AS p))
SELECT wave, table_name, n_rows, ref, CAST(0 AS BIGINT) AS null_refs, CAST(orphan_rows AS BIGINT) AS orphan_rows, published FROM g"""


def o_relabel_records(spark, d):
    """The sloppy event records of ``s_record_bag`` under opaque names, translated back and scored."""
    from ..operators.relabel import relabel_maps, translate_back
    from ..sources.records import read_records

    e = load(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value")
    entity_map, field_maps = relabel_maps({"Event": e.columns}, seed=5)
    f = field_maps["Event"]
    text = F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))
    line = F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit(f', "{f["user_id"]}": '),
                    F.when(F.col("event_type") == "error", F.lit("null")).otherwise(F.col("user_id").cast("string")),
                    F.lit(f', "{f["event_type"]}": "'), F.col("event_type"), F.lit(f'", "{f["value"]}": '),
                    F.when(F.col("event_type") == "view", text).otherwise(F.col("value").cast("string")), F.lit("}"))
    path = scratch_path(spark, "records")
    e.select(line.alias("value")).write.text(path)
    bag = read_records(spark, path, [f[c] for c in e.columns])
    return _checks(Verifier(EVENT_SCHEMA, [], {"Event": e}, translate_back({entity_map["Event"]: bag}, entity_map, field_maps)))


def v_lists_equal(spark, d):
    """The lines of every order as lists of whole numbers and of decimals, one list in seven with a value changed."""
    from ..functions.values import values_equal

    li = load(spark, d, "lineitem")
    changed = F.when((F.col("l_orderkey") % 7 == 0) & (F.col("l_linenumber") == 1), 0.5).otherwise(0.0)
    both = li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("part")))).alias("a"),
        F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("double").alias("l_linenumber"), (F.col("l_partkey") + changed).alias("part")))).alias("b"))
    types = {f.name: f.dataType for f in both.schema.fields}
    return both.select("id", F.size("a").cast("bigint").alias("n_items"), values_equal(F.col("a"), types["a"], F.col("b"), types["b"]).alias("equal"))


def v_strict_report(spark, d):
    """What the score does not look at: an extract and events with arrays left, repeated ids, a lost column and foreign enum values."""
    from .verify import strict_report

    entities = {**EXTRACT_SCHEMA.to_dict()["entities"], **EVENT_SCHEMA.to_dict()["entities"]}
    schema = Schema.from_dict({"entities": entities, "nested_blocks": EXTRACT_SCHEMA.to_dict()["nested_blocks"]})
    e = load(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value")
    src = {"Orders": orders_nested(spark, d).select("id", "lines"), "Event": e}
    dest = apply_log(src, EXTRACT_LOG, blocks={"LineBlock": ["linenumber", "partkey"]})
    bad = e.select("id", F.when(F.col("id") % 10 == 1, F.initcap("event_type")).otherwise(F.col("event_type")).alias("event_type"), "value")
    tables = {"OrderLine": dest["OrderLine"].drop("partkey"), "Event": bad.union(bad.where("id % 50 = 0")),
              "Orders": src["Orders"].withColumn("lines", F.when(F.col("id") % 3 == 0, F.col("lines")))}
    return strict_report(Verifier(schema, EXTRACT_LOG, src, tables))


def c_load(spark, d):
    """The scenario's tables loaded in waves and published; a second load, with orders of customers that are not there, publishes nothing."""
    from ..sources.storage import exists
    from .loading import LoadError, load_in_waves
    from .scenario import VS_SCHEMA
    src = {k: v for k, v in vs_source(spark, d).items()}
    target = scratch_path(spark, "loaded")
    gate = load_in_waves(src, VS_SCHEMA, target)
    bad = dict(src)
    bad["Customer"] = src["Customer"].where("id % 100 <> 1")
    other = scratch_path(spark, "refused")
    try:
        load_in_waves(bad, VS_SCHEMA, other)
        failed = None
    except LoadError as e:
        failed = spark.createDataFrame([tuple(r) for r in e.gate], gate.schema)
    state = [F.lit(exists(spark, target)).alias("published")], [F.lit(exists(spark, other)).alias("published")]
    out = gate.select("*", *state[0])
    return out.union(failed.select("*", *state[1])) if failed is not None else out


def s_commit_log(spark, d):
    """Events written by two writers in turn, one batch twice with its token, as read back."""
    base = scratch_path(spark, "commits")
    one, two = BatchWriter(spark, base), BatchWriter(spark, base)
    e = load(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type")
    for w, kinds, token in ((one, ["click", "view"], "a"), (two, ["purchase"], "b"), (one, ["click", "view"], "a"), (two, ["signup", "error"], "c"), (one, ["purchase"], "b")):
        w.write("Event", e.where(F.col("event_type").isin(kinds)), token=token)
    return two.read("Event").groupBy("_batch", "event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("id").alias("id_sum"))


def st_extract(spark, d):
    """Orders with their lines read as a stream, the lines extracted batch by batch."""
    from ..streaming.replay import extract_stream

    path = scratch_path(spark, "nested")
    # three batches, of as many files together as a shuffle has parts: no task writes a batch alone
    files = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    orders_nested(spark, d).select("id", "lines").repartition(files, "id").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(path)
    out = scratch_path(spark, "extracted")
    tables = extract_stream(spark, stream, "lines", "order_id", out, "Orders", "OrderLine", name=out.rsplit("/", 1)[-1])
    child = tables["OrderLine"].groupBy("order_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("id").alias("n_ids"), F.sum("partkey").cast("bigint").alias("parts"))
    o = tables["Orders"].select("id")
    return o.join(child, o["id"] == child["order_id"], "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_ids", "parts")])


WAVE_TABLES = {"Region": "region", "Nation": "nation", "Customer": "customer", "Orders": "orders",
               "Event": "events", "Supplier": "supplier"}


def c_waves(spark, d):
    """Scenario tables in load order (ref targets first) with the rows each wave loads."""
    from .scenario import VS_SCHEMA
    parts = []
    for w, names in enumerate(constraints.load_waves(VS_SCHEMA)):
        for n in names:
            parts.append(load(spark, d, WAVE_TABLES[n]).agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(w).alias("wave"), F.lit(n).alias("table_name"), "n_rows"))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.union(p_)
    return out


SQL_WAVES = """SELECT 0 AS wave, 'Region' AS table_name, count(*) AS n_rows FROM region
UNION ALL SELECT 1, 'Nation', count(*) FROM nation
UNION ALL SELECT 0, 'Customer', count(*) FROM customer
UNION ALL SELECT 1, 'Orders', count(*) FROM orders
UNION ALL SELECT 1, 'Event', count(*) FROM events
UNION ALL SELECT 0, 'Supplier', count(*) FROM supplier"""


def queries() -> dict:
    return {
        "s_record_sink": s_record_sink, "o_relabel_records": o_relabel_records, "v_lists_equal": v_lists_equal, "v_strict_report": v_strict_report,
        "c_load": c_load, "s_commit_log": s_commit_log, "st_extract": st_extract,
        "c_waves": c_waves,
        "s_record_bag": s_record_bag,
        "st_event_stream": st_event_stream,
        "a_output_summary": a_output_summary, "a_shotgun": a_shotgun, "a_partition_ablation": a_partition_ablation,
        "a_group_stats": a_group_stats, "a_ranking": a_ranking, "a_score_pivot": a_score_pivot,
        "a_metric_pivot": a_metric_pivot, "a_reward_variance": a_reward_variance, "a_any_variance": a_any_variance,
        "a_fingerprint": a_fingerprint, "k_last_in_batch": k_last_in_batch, "s_batch_scored": s_batch_scored,
        "c_pk": c_pk, "c_fk_orphans": c_fk_orphans, "c_enum_domain": c_enum_domain,
        "s_read": s_read, "s_append_batches": s_append_batches, "s_jsonl": s_jsonl, "s_run_results": s_run_results,
    }


def oracles() -> dict:
    wr = f"WITH {SQL_RUNS} "
    return {
        "a_output_summary": SQL_OUTPUT_SUMMARY,
        "a_shotgun": SQL_SHOTGUN,
        "a_partition_ablation": _sql_ablation(),
        "a_group_stats": wr + "SELECT model, tier, round(coalesce(avg(total), 0.0), 6) AS mean, coalesce(min(total), 0.0) "
                              "AS min, coalesce(max(total), 0.0) AS max, count(total) AS n FROM runs GROUP BY model, tier",
        "a_ranking": wr + """, ok AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY total DESC, seq) AS rank
                              FROM runs WHERE total IS NOT NULL)
            SELECT run_id, model, tier, task_id, total, error, seq, coverage, rank,
                   CASE WHEN rank = 1 THEN total - lead(total) OVER (PARTITION BY tier ORDER BY rank) END AS gap_to_next
            FROM ok""",
        "a_score_pivot": wr + """SELECT model,
              round(avg(CASE WHEN tier = 2 AND NOT error THEN total END), 6) AS tier_2,
              round(avg(CASE WHEN tier = 3 AND NOT error THEN total END), 6) AS tier_3,
              count(*) FILTER (WHERE error) AS errors, round(avg(CASE WHEN NOT error THEN total END), 6) AS overall
            FROM runs GROUP BY model""",
        "a_metric_pivot": wr + ", long AS (SELECT model, 'total' AS metric, total AS value FROM runs UNION ALL "
                               "SELECT model, 'coverage', coverage FROM runs) SELECT metric, " + ", ".join(
            f"round(avg(CASE WHEN model = '{m}' THEN value END), 6) AS {m}" for m in MODELS) + " FROM long GROUP BY metric",
        "a_reward_variance": wr + "SELECT task_id, round(var_pop(total), 6) AS variance, count(DISTINCT total) AS n_distinct, "
                                  "count(total) AS n, count(DISTINCT total) > 1 AS varies FROM runs GROUP BY task_id",
        "a_any_variance": wr + ", t AS (SELECT task_id, count(DISTINCT total) > 1 AS varies FROM runs GROUP BY task_id) "
                               "SELECT count(*) AS n_tasks, count(*) FILTER (WHERE varies) AS n_varying, "
                               "coalesce(bool_or(varies), false) AS any_varies FROM t",
        "a_fingerprint": _sql_fingerprint(),
        "k_last_in_batch": "SELECT user_id AS id, arg_max(event_type, event_id) AS event_type, count(*) AS n_written "
                           "FROM events GROUP BY user_id",
        "s_batch_scored": W + "SELECT (SELECT count(*) FROM orders_s) AS n_parents, (SELECT count(*) FROM lines_s) AS n_children, "
                              "CAST(100.0 AS DOUBLE) AS total",
        "c_pk": SQL_PK,
        "c_fk_orphans": SQL_FK,
        "c_enum_domain": SQL_ENUM,
        "s_read": _sql_read(),
        "s_append_batches": SQL_APPEND,
        "s_jsonl": "SELECT event_id, user_id, event_type, value, props FROM events",
        "s_run_results": wr + "SELECT run_id, model, tier, 2 AS n_steps, total AS score FROM runs",
        "st_event_stream": SQL_STREAM,
        "s_record_bag": SQL_RECORD_BAG,
        "c_waves": SQL_WAVES,
        "o_relabel_records": SQL_RECORD_BAG, "s_record_sink": SQL_RECORD_SINK, "v_strict_report": SQL_STRICT, "c_load": SQL_LOAD,
        "v_lists_equal": "SELECT l_orderkey AS id, count(*) AS n_items, NOT bool_or(l_orderkey % 7 = 0 AND l_linenumber = 1) AS equal FROM lineitem GROUP BY l_orderkey",
        "s_commit_log": "SELECT CASE WHEN event_type IN ('click', 'view') THEN 0 WHEN event_type = 'purchase' THEN 1 ELSE 2 END AS _batch, event_type, "
                        "count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY event_type",
        "st_extract": W + "SELECT o.id, count(l.order_id) AS n_lines, count(l.order_id) AS n_ids, CAST(coalesce(sum(l.partkey), 0) AS BIGINT) AS parts "
                          "FROM orders_s o LEFT JOIN lines_s l ON l.order_id = o.id GROUP BY o.id",
    }
