"""Relabelling, constraints, generator, batch sink, streaming and the partition ablation."""

import pytest
from pyspark.sql import functions as F

from migrata.operators.relabel import entity_label, field_label, relabel, translate_back
from migrata.operators.transforms import apply_log
from migrata.plans import audit, constraints
from migrata.plans.verify import Verifier, grade
from migrata.sources.generate import generate
from migrata.sources.io import BatchWriter, scratch_path
from migrata.spec import dest_kinds
from tests.helpers import tables
from tests.specs import BLOCKS, LOG, SCHEMA


def test_labels():
    assert [entity_label(i) for i in (0, 25, 26, 27)] == ["EntityA", "EntityZ", "EntityAA", "EntityAB"]
    assert [field_label(i) for i in (0, 1, 26)] == ["fa", "fb", "faa"]


def test_relabel_roundtrip(spark):
    ts = tables(spark, {"User": ("id bigint, name string, age bigint", [(1, "a", 3)])})
    out, em, fm = relabel(ts, seed=3)
    assert list(out) == ["EntityA"] and out["EntityA"].columns[0] == "id"
    back = translate_back(out, em, fm)
    assert back["User"].collect() == ts["User"].collect()


def test_constraints(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, None)], "a bigint, b bigint")
    r = constraints.pk_check(df, ["a", "b"]).first()
    assert (r.n_rows, r.null_keys, r.distinct_keys, r.duplicated_keys, r.surplus_rows) == (3, 1, 2, 1, 1)
    parent = spark.createDataFrame([(1,)], "k bigint")
    r = constraints.fk_orphans(df, "a", parent, "k").first()
    assert (r.orphan_rows, r.orphan_values, r.null_refs) == (1, 1, 0)
    e = constraints.enum_domain(spark.createDataFrame([("x",), ("y",), (None,)], "s string"), "s", ["x"]).collect()
    assert [(r.value, r.n_rows) for r in e] == [("y", 1)]
    waves = constraints.load_waves(SCHEMA)
    assert waves[0][0] == "Port" and "Voyage" in waves[2]


def test_generator_contract(spark):
    g = generate(spark, SCHEMA, n=40, seed=1)
    c = g["Carrier"]
    assert c.agg(F.count("id"), F.min("id"), F.max("id")).first() == (40, 1, 40)
    assert c.where(~F.col("port_id").between(1, 40) | ~F.col("rank").isin("gold", "silver", "plain")).count() == 0
    assert c.where((F.size("licences") < 1) | (F.size("licences") > 4)).count() == 0
    assert g["Voyage"].where(~F.size("legs").between(1, 3)).count() == 0
    assert c.collect() == generate(spark, SCHEMA, n=40, seed=1)["Carrier"].repartition(7).sort("id").collect()


def test_batch_writer_last_wins(spark):
    w = BatchWriter(spark, scratch_path(spark, "t"))
    w.write("User", spark.createDataFrame([(1, "a")], "id bigint, name string"))
    w.write("User", spark.createDataFrame([(1, "b")], "id bigint, name string"))
    sch = {"entities": {"User": {"fields": {"id": {"kind": "id"}, "name": {"kind": "text"}}}}}
    from tests.helpers import schema
    src = tables(spark, {"User": ("id bigint, name string", [(1, "b")])})
    dest = {"User": w.read("User").drop("_batch")}
    assert grade(schema(sch), [], src, dest)["total"] == pytest.approx(100.0)


def test_partition_ablation_matches_regrading(spark):
    src = {k: v.cache() for k, v in generate(spark, SCHEMA, n=10, seed=3).items()}
    dest = apply_log(src, LOG, blocks=BLOCKS)
    dest["DryParcel"] = dest["DryParcel"].unionByName(dest["WetParcel"])  # misroute some rows
    v = Verifier(SCHEMA, LOG, src, dest)
    got = {r.scenario: r.total for r in audit.partition_ablation(v, "Parcel").collect()}
    subs = ["DryParcel", "WetParcel", "GasParcel"]
    for name, kept in [("all", subs), ("none", []), ("without_DryParcel", subs[1:]), ("only_GasParcel", subs[2:])]:
        d = {k: df for k, df in dest.items() if k not in subs or k in kept}
        assert got[name] == pytest.approx(grade(SCHEMA, LOG, src, d)["total"], abs=1e-9), name


def test_dest_kinds_fold():
    k = dest_kinds(SCHEMA, LOG)
    assert k["VoyageDetail"] == {"id": "id", "voyage_id": "ref", "cost": "number", "state": "enum"}
    assert "Parcel" not in k and k["GasParcel"] == {"id": "id", "shipper_id": "ref", "weight": "number", "marks": "text"}
    assert k["PilotRecord"] == {"id": "id", "motto": "text", "grade": "number", "pilotlog_grade": "number", "entry": "text"}
    assert (k["Carrier"]["port_zone"], k["Carrier"]["is_gold"], k["Port"]["alerts_count"]) == ("enum", "bool", "number")


def test_jobs_migrate_then_verify(spark, tmp_path):
    import json

    from migrata.plans import jobs
    from migrata.sources.io import write_table_set
    from migrata.spec import log_to_dicts

    spec = tmp_path / "spec.json"
    spec.write_text(json.dumps({"schema": SCHEMA.to_dict(), "log": log_to_dicts(LOG)}))
    src = generate(spark, SCHEMA, n=6, seed=2)
    write_table_set(src, str(tmp_path / "src"))
    jobs.migrate(spark, str(spec), str(tmp_path / "src"), str(tmp_path / "dst"))
    jobs.verify(spark, str(spec), str(tmp_path / "src"), str(tmp_path / "dst"), str(tmp_path / "out"))
    rep = spark.read.parquet(str(tmp_path / "out" / "report")).first()
    assert rep.total == pytest.approx(100.0, abs=1e-6)
    # the same by URI, as on remote storage: sub-tables written by partition are found again
    u = tmp_path.as_uri()
    jobs.migrate(spark, f"{u}/spec.json", f"{u}/src", f"{u}/dst2")
    assert (tmp_path / "dst2" / "_routed").is_dir()
    jobs.verify(spark, f"{u}/spec.json", f"{u}/src", f"{u}/dst2", f"{u}/out2")
    assert spark.read.parquet(f"{u}/out2/report").first().total == pytest.approx(100.0, abs=1e-6)
    with pytest.raises(FileNotFoundError):
        jobs.migrate(spark, f"{u}/spec.json", f"{u}/nowhere", f"{u}/dst3")


def test_jobs_verify_json_records(spark, tmp_path):
    import json

    from migrata.plans import jobs
    from migrata.sources.io import write_table_set
    from migrata.spec import log_to_dicts

    spec = tmp_path / "spec.json"
    spec.write_text(json.dumps({"schema": SCHEMA.to_dict(), "log": log_to_dicts(LOG)}))
    src = generate(spark, SCHEMA, n=5, seed=4)
    write_table_set(src, str(tmp_path / "src"))
    jobs.migrate(spark, str(spec), str(tmp_path / "src"), str(tmp_path / "dst"), records=True)
    jobs.verify(spark, str(spec), str(tmp_path / "src"), str(tmp_path / "dst"), str(tmp_path / "out"), records=True)
    assert spark.read.parquet(str(tmp_path / "out" / "report")).first().total == pytest.approx(100.0, abs=1e-6)


def test_stream_rejects_whole_table_steps(spark):
    from migrata.spec import SpecError, log_from_dicts
    from migrata.streaming import replay_stream
    stream = spark.readStream.format("rate").option("rowsPerSecond", 1).load().selectExpr("value AS id")
    log = log_from_dicts([{"type": "split", "from": "E", "into": ["E", "EDetail"], "moved_fields": ["x"],
                           "link_field": "e_id"}])
    with pytest.raises(SpecError):
        replay_stream(stream, "E", log)
    ok = replay_stream(stream, "E", log_from_dicts([{"type": "rename", "entity": "E", "from": "id", "to": "key"}]))
    assert ok.isStreaming and ok.columns == ["key"]


def test_preconditions_reject_unsafe_steps():
    from migrata.spec import Schema, check_preconditions, log_from_dicts
    sch = Schema.from_dict({"entities": {
        "A": {"fields": {"id": {"kind": "id"}, "x": {"kind": "text"}}},
        "B": {"fields": {"id": {"kind": "id"}, "a_id": {"kind": "ref", "target": "A"},
                         "k": {"kind": "enum", "values": ["p", "q"]}}},
        "C": {"fields": {"id": {"kind": "id"}, "a_id": {"kind": "ref", "target": "A"}}}}})
    split = log_from_dicts([{"type": "split", "from": "A", "into": ["A", "ADetail"], "moved_fields": ["x"],
                             "link_field": "a_id"}])
    assert any("needs >= 4 fields" in p for p in check_preconditions(sch, split))
    merge = log_from_dicts([{"type": "merge", "from": ["A", "B"], "into": "AB", "dropped_link_field": "a_id"}])
    assert any("C.a_id refers to the parent" in p for p in check_preconditions(sch, merge))
    part = log_from_dicts([{"type": "partition", "entity": "A", "on_field": "x", "mapping": {"p": "P"}}])
    probs = check_preconditions(sch, part)
    assert any("referenced by" in p for p in probs) and any("must be an enum" in p for p in probs)


def test_preconditions_of_new_rules():
    from migrata.spec import Schema, SpecError, check_preconditions, log_from_dicts, require
    text = {"kind": "text"}
    sch = Schema.from_dict({"entities": {
        "Dock": {"fields": {"id": {"kind": "id"}, "name": text}},
        "Crane": {"fields": {"id": {"kind": "id"}, "dock_id": {"kind": "ref", "target": "Dock"}, "a": text, "b": text}}}})
    gone = log_from_dicts([
        {"type": "merge", "from": ["Dock", "Crane"], "into": "Yard", "dropped_link_field": "dock_id"},
        {"type": "denormalize", "entity": "Yard", "via_field": "dock_id", "from_entity": "Dock",
         "inlined": [{"source_field": "name", "dest_field": "dock_name"}]},
        {"type": "computed", "entity": "Yard", "operation": "concat", "source_fields": ["a", "dock_name"], "dest_field": "c"},
        {"type": "split", "from": "Shed", "into": ["Shed", "ShedDetail"], "moved_fields": ["x"], "link_field": "shed_id"}])
    problems = check_preconditions(sch, gone)
    assert any("did not survive" in p for p in problems) and any("inlined column dock_name" in p for p in problems)
    assert any("no such table" in p for p in problems)
    with pytest.raises(SpecError):
        require(sch, gone)


def test_write_order_decides_inside_a_batch(spark):
    w = BatchWriter(spark, scratch_path(spark, "t"))
    rows = [(1, f"v{i}", i) for i in range(6)]
    assert w.write("User", spark.createDataFrame(rows[::-1], "id bigint, name string, at int").repartition(3), ["at"]) == 6
    # a second writer goes on where the first stopped
    again = BatchWriter(spark, w.base)
    assert again.write("User", spark.createDataFrame([(2, "x", 0)], "id bigint, name string, at int"), ["at"]) == 1
    back = again.read("User")
    assert sorted(r[0] for r in back.select("_batch").distinct().collect()) == [0, 1]
    from migrata.operators.keys import last_wins
    assert {r.id: r.name for r in last_wins(back.drop("_batch"), "id", "_seq").collect()} == {1: "v5", 2: "x"}


def test_fingerprint_tells_null_places_apart(spark):
    a = spark.createDataFrame([(None, 5)], "a int, b int")
    b = spark.createDataFrame([(5, None)], "a int, b int")
    got = {r.table_name: r.row_hash_sum for r in audit.fingerprint({"a": a, "b": b}).collect()}
    assert got["a"] != got["b"]


def test_run_files_of_either_shape(spark, tmp_path):
    import json
    from migrata.sources.io import read_runs
    runs = [{"run_id": "r1", "tier": 2}, {"run_id": "r2", "tier": 3}]
    for name, text in (("lines", "\n".join(map(json.dumps, runs))), ("document", json.dumps(runs[0], indent=2)), ("list", json.dumps(runs, indent=2))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "runs.json").write_text(text)
        got = sorted(tuple(r) for r in read_runs(spark, str(tmp_path / name), "run_id string, tier int").collect())
        assert got == [("r1", 2), ("r2", 3)][:1 if name == "document" else 2], name


def test_run_files_of_mixed_shapes(spark, tmp_path):
    import json
    from migrata.sources.io import read_runs
    run = lambda k: {"run_id": f"r{k}", "tier": k}
    line = lambda k: json.dumps(run(k))
    texts = {"lines one.json": "\n".join(map(line, (1, 2, 3))), "doc.json": json.dumps(run(4), indent=2),
             "list.json": json.dumps([run(5), run(6)], indent=2), "feed.json": "\n\n" + line(7) + "\n" + line(8),
             "cut.json": line(9)[:12] + "\n" + line(10) + "\n" + line(11)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {tuple(r) for r in read_runs(spark, str(tmp_path), "run_id string, tier int").where("run_id is not null").collect()}
    assert got >= {(f"r{k}", k) for k in (*range(1, 9), 10, 11)}


def test_jaccard_over_distinct_ids(spark):
    sch = {"entities": {"Job": {"fields": {"id": {"kind": "id"}, "state": {"kind": "enum", "values": ["up", "down"]}}}}}
    from migrata.spec import Schema, log_from_dicts
    part = log_from_dicts([{"type": "partition", "entity": "Job", "on_field": "state", "mapping": {"up": "UpJob", "down": "DownJob"}}])
    src = tables(spark, {"Job": ("id bigint, state string", [(1, "up"), (1, "up"), (1, "up"), (2, "up")])})
    dest = tables(spark, {"UpJob": ("id bigint", [(1,)])})
    checks = Verifier(Schema.from_dict(sch), part, src, dest, only=["v_str_jaccard"]).checks()
    assert checks.where("entity = 'UpJob'").first().hits == pytest.approx(0.5)


def test_flattened_count_dropped_again(spark):
    sch = {"entities": {"Box": {"fields": {"id": {"kind": "id"}, "label": {"kind": "text"}, "parts": {"kind": "nested", "of": "Part"}}}},
           "nested_blocks": {"Part": {"fields": {"n": {"kind": "number"}}}}}
    from migrata.spec import Schema, log_from_dicts
    steps = log_from_dicts([{"type": "flatten_nested", "entity": "Box", "field": "parts", "block": "Part", "into": "n_parts"},
                            {"type": "unmapped", "entity": "Box", "field": "n_parts"}])
    src = {"Box": spark.createDataFrame([(1, "a", [(1,)]), (2, "b", [])], "id bigint, label string, parts array<struct<n:bigint>>")}
    assert grade(Schema.from_dict(sch), steps, src, apply_log(src, steps))["total"] == pytest.approx(100.0)
