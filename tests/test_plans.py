"""Plan shapes that matter at scale, read from ``explain`` output."""

import io
from contextlib import redirect_stdout

from migrata.operators.keys import dense_id, position_in_group
from migrata.plans import catalog_transforms as ct

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_partition_filter_reaches_parquet_and_prunes_columns(spark):
    p = plan(ct.t_partition_click(spark, SF))
    assert "EqualTo(event_type,click)" in p
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in p


def test_ranks_have_no_single_task_step_at_any_size(spark):
    for n in (10, 5000):
        df = spark.range(0, n).selectExpr("id * 7 % 1000 AS k", "id % 2 AS g")
        for out in (dense_id(df, ["k"], "rid"), position_in_group(df, "g", ["k"])):
            p = plan(out, "simple")
            assert "SinglePartition" not in p and "Window" not in p and "CASE" not in p


def test_checks_build_only_the_tables_they_read(spark, monkeypatch):
    from migrata.operators import transforms
    from migrata.plans import catalog_verify as cv
    calls = []
    monkeypatch.setattr(transforms, "dense_id", lambda *a, **k: calls.append(a) or dense_id(*a, **k))
    q = cv.queries()
    q["v_str_unmapped"](spark, SF)
    q["v_str_computed"](spark, SF)
    assert calls == []


def test_ablation_joins_by_equality(spark):
    from migrata.plans import catalog_misc
    assert "CartesianProduct" not in plan(catalog_misc.a_partition_ablation(spark, SF), "simple")


def test_merge_first_child_is_partially_aggregated(spark):
    p = plan(ct.t_merge_first_child(spark, SF), "simple")
    assert "partial_min_by" in p


def test_partition_after_remap_filters_the_raw_column(spark):
    from migrata.operators.transforms import apply_log
    from migrata.spec import log_from_dicts
    from migrata.plans.scenario import event_s
    log = log_from_dicts([
        {"type": "enum_remap", "entity": "Event", "field": "event_type",
         "mapping": {"click": "Click", "view": "View"}},
        {"type": "partition", "entity": "Event", "on_field": "event_type",
         "mapping": {"Click": "ClickEvent", "View": "ViewEvent", "purchase": "PurchaseEvent"}}])
    out = apply_log({"Event": event_s(spark, SF)}, log)
    p = plan(out["ClickEvent"])
    # raw "click" maps to "Click"; a raw "Click" would pass the remap unchanged, so both route here
    assert "PushedFilters: [In(event_type, [Click,click])]" in p
    assert out["ClickEvent"].columns == ["id", "user_id", "value"]
    n = event_s(spark, SF).groupBy("event_type").count().collect()
    want = {r.event_type: r["count"] for r in n}
    assert out["ClickEvent"].count() == want["click"] and out["PurchaseEvent"].count() == want["purchase"]


def test_report_and_ablation_read_stored_tables(spark):
    from migrata.plans import catalog_misc, catalog_verify
    for fn, scans in ((catalog_verify.v_score_report, 1), (catalog_misc.a_partition_ablation, 9)):
        assert plan(fn(spark, SF), "simple").count("FileScan parquet") <= scans


def test_nested_source_is_gathered_once(spark):
    from migrata.plans import catalog_verify
    v = catalog_verify.vs_written_verifier(spark, SF)
    assert "collect_list" not in plan(v.source["Orders"]) and v.source["Orders"].count() > 0


def test_denormalize_check_carries_the_looked_up_columns_only(spark):
    from migrata.plans import catalog_verify
    v = catalog_verify.vs_written_verifier(spark, SF)
    one = v._dedup(v._dest_norm("Orders"), ["id"], ["customer_segment"])
    every = v._dedup(v._dest_norm("Orders"), ["id"]).select("id", "customer_segment")
    assert one.columns == ["id", "customer_segment"] and one.exceptAll(every).isEmpty() and one.count() == every.count()


def test_record_sink_stores_its_source(spark, monkeypatch):
    from migrata.plans import catalog_misc
    seen = []
    made = catalog_misc.Verifier
    monkeypatch.setattr(catalog_misc, "Verifier", lambda schema, log, src, dest: seen.append(src) or made(schema, log, src, dest))
    catalog_misc.s_record_sink(spark, SF)
    assert "collect_list" not in plan(seen[0]["Orders"])


def test_extract_numbers_only_the_fields_that_stay(spark, monkeypatch):
    from migrata.operators import transforms
    seen = []
    made = transforms.dense_id
    monkeypatch.setattr(transforms, "dense_id", lambda df, *a, **kw: seen.append(df) or made(df, *a, **kw))
    src = spark.createDataFrame([(2, [(1, "x", "long")]), (1, [(5, "y", "text"), (6, None, None)])], "id long, xs array<struct<a:int,b:string,c:string>>")
    parent, child = transforms.extract_items(src, "xs", "p", ["a", "z", "b"])
    assert len(seen[0].columns) == 4 and parent.columns == ["id"]
    assert child.columns == ["id", "p", "a", "z", "b"]
    assert sorted(map(tuple, child.collect())) == [(1, 1, 5, None, "y"), (2, 1, 6, None, None), (3, 2, 1, None, "x")]


def test_stream_input_is_written_by_all_parts(spark, monkeypatch):
    from migrata.plans import catalog_misc
    from migrata.sources.storage import files
    made, kept = [], spark.conf.get("spark.sql.shuffle.partitions")
    path = catalog_misc.scratch_path
    monkeypatch.setattr(catalog_misc, "scratch_path", lambda s, name: made.append(path(s, name)) or made[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = catalog_misc.st_extract(spark, SF).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len([f for f in files(spark, made[0]) if f.endswith(".parquet")]) == 7
    assert rows == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_lines_are_gathered_with_the_columns_they_keep(spark, tmp_path):
    from migrata.plans.scenario import lines_by_order
    rows = [(1, 2, 7, 3.0, 9.5, "R", 4, 0.1, 0.2, "O", "x"), (1, 1, 7, 3.0, 9.5, "R", 4, 0.1, 0.2, "O", "x"),
            (1, 2, 7, 3.0, 9.5, "R", 1, 0.0, 0.2, "O", "a"), (1, 2, 6, 3.0, 9.5, "N", 9, 0.1, 0.2, "O", "x"),
            (1, 2, 6, None, 9.5, "N", 9, 0.1, 0.2, "O", "x"), (None, None, 5, 1.0, 1.0, None, 1, 0.0, 0.0, "F", "b")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string, "
                          "l_suppkey long, l_discount double, l_tax double, l_linestatus string, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = lines_by_order(spark, str(tmp_path))
    got = {r.order_id: [tuple(x) for x in r.lines] for r in out.collect()}
    assert got == {1: [(1, 7, 3.0, 9.5, "R"), (2, 6, None, 9.5, "N"), (2, 6, 3.0, 9.5, "N"), (2, 7, 3.0, 9.5, "R"), (2, 7, 3.0, 9.5, "R")],
                   None: [(None, 5, 1.0, 1.0, None)]}
    p = plan(out)
    assert "l_shipdate" not in p and "l_suppkey" not in p
    # plain rows are dealt: nothing is gathered below the exchange
    steps = plan(lines_by_order(spark, str(tmp_path)), "simple")
    assert "collect_list" in steps and "collect_list" not in steps[steps.index("Exchange"):]


def test_ablation_locates_its_rows_once(spark, monkeypatch):
    from migrata.plans import catalog_misc
    from migrata.plans.verify import Verifier
    calls, made = [], Verifier._located
    monkeypatch.setattr(Verifier, "_located", lambda self, entity: calls.append(entity) or made(self, entity))
    assert catalog_misc.a_partition_ablation(spark, SF).count() == 10
    assert calls.count("Event") == 1


def test_located_rows_without_stored_checks(spark):
    from migrata.plans import catalog_verify
    v = catalog_verify.vs_written_verifier(spark, SF)
    alone = v.located_rows("Event")
    again = catalog_verify.vs_written_verifier(spark, SF).store_parts().located_rows("Event")
    assert alone.exceptAll(again.select(*alone.columns)).isEmpty() and alone.count() == again.count() > 0
