"""Order of record sinks, injective fingerprints, relabelled record bags, nested equality, shapes of run files."""

import json
from datetime import date

from pyspark.sql import functions as F

from migrata.functions.values import values_equal
from migrata.operators.relabel import relabel_maps, translate_back
from migrata.plans import audit
from migrata.sources.io import read_runs, run_files
from migrata.sources.records import read_records, write_records


def test_records_come_back_in_order_from_uneven_files(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 7).select((F.col("id") * 37 % 4001).alias("id"), F.when(F.col("id") % 5 == 0, F.repeat(F.lit("x"), 300)).alias("pad"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_records(rows.repartition(13), str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "t").glob("part-*.json"))) > 1
    back = [r["id"] for r in read_records(spark, str(tmp_path / "t"), ["id"]).orderBy("_seq").collect()]
    assert back == sorted(back) and len(back) == 4000


def test_fingerprint_tells_separators_apart(spark):
    def of(rows):
        return audit.fingerprint({"t": spark.createDataFrame(rows, "a string, b string")}).first()["row_hash_sum"]
    pairs = [[("a|vb", "c")], [("a", "b|vc")], [("a", None)], [("a", "n")], [("a1:n", None)], [("1:a", "")], [("", "1:a")], [("1", ":a")], [(None, "a")], [("na", None)]]
    assert len({of(p) for p in pairs}) == len(pairs)
    assert of([("x", "y"), ("z", None)]) == of([("z", None), ("x", "y")])


def test_translate_back_takes_all_columns_of_a_field(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(json.dumps(r) for r in [{"id": 1, "n": 5, "m": None}, {"id": 2, "n": "5", "m": 1}, {"id": 3}]))
    names = {"T": ["id", "n", "m"]}
    emap, fmaps = relabel_maps(names, seed=3)
    bag = read_records(spark, str(tmp_path / "r.json"), ["id", "n", "m"])
    relabelled = bag.select(*[F.col(c).alias(next((fmaps["T"][f] + c[len(f):] for f in ("n", "m") if c == f or c.startswith(f + "__")), c)) for c in bag.columns])
    back = translate_back({emap["T"]: relabelled}, emap, fmaps)["T"]
    assert sorted(back.columns) == sorted(bag.columns) and any(c.startswith("n__mgt") for c in back.columns)
    assert sorted(map(str, back.select(*bag.columns).collect())) == sorted(map(str, bag.collect()))


def test_lists_and_records_compare_by_value(spark):
    cases = [("array(1, 2)", "array(1.0D, 2.0D)", True), ("array(1, 2)", "array(2, 1)", False), ("array(1)", "array(1, 2)", False),
             ("array(1, null)", "array(1.0D, null)", True), ("array(1, null)", "array(1.0D, 2.0D)", False), ("array(true)", "array(1)", True),
             ("array('1')", "array(1)", False), ("array(named_struct('a', 1, 'b', 'x'))", "array(named_struct('b', 'x', 'a', 1.0D))", True),
             ("named_struct('a', 1, 'b', CAST(null AS STRING))", "named_struct('a', 1)", True), ("named_struct('a', 1, 'b', 'y')", "named_struct('a', 1)", False),
             ("array(array(1), array())", "array(array(1.0D), array())", True), ("array(array(1))", "array(1)", False),
             ("map('k', 1)", "map('k', 1.0D)", True), ("map('k', 1)", "map('j', 1)", False),
             ("CAST(parse_json('[1, \"a\", true, null]') AS ARRAY<VARIANT>)", "CAST(parse_json('[1.0, \"a\", 1, null]') AS ARRAY<VARIANT>)", True),
             ("CAST(parse_json('[\"1\"]') AS ARRAY<VARIANT>)", "array(1)", False), ("CAST(parse_json('[1.0]') AS ARRAY<VARIANT>)", "array(1)", True),
             ("CAST(null AS ARRAY<INT>)", "CAST(null AS ARRAY<DOUBLE>)", True), ("array()", "CAST(null AS ARRAY<INT>)", False)]
    for a, b, want in cases:
        df = spark.sql(f"SELECT {a} AS a, {b} AS b")
        types = {f.name: f.dataType for f in df.schema.fields}
        for x, y in (("a", "b"), ("b", "a")):
            got = df.select(values_equal(F.col(x), types[x], F.col(y), types[y]).alias("e")).first()["e"]
            assert got is want, (a, b)


def test_run_files_by_shape(spark, tmp_path):
    doc = {"run": 1, "steps": [{"name": "a"}, {"name": "b"}]}
    shapes = {"lines.json": "\n\n" + "\n".join(json.dumps({"run": k}) for k in (1, 2, 3)) + "\n", "indented.json": json.dumps(doc, indent=2),
              "list.json": json.dumps([{"run": 7}, {"run": 8}], indent=1), "cut.json": '{"run": 4, "st\n{"run": 5}\n{"run": 6}\n',
              "oneline.json": json.dumps([{"run": 9}, {"run": 10}]), "blank name.json": json.dumps({"run": 11}, indent=2), "empty.json": "", "flat.json": "[\n{\"run\": 12},\n{\"run\": 13}\n]"}
    for name, text in shapes.items():
        (tmp_path / name).write_text(text)
    got = {r["file"].rsplit("/", 1)[1]: r["single"] for r in run_files(spark, str(tmp_path)).collect()}
    assert got == {"lines.json": False, "indented.json": True, "list.json": True, "cut.json": False, "oneline.json": False, "blank%20name.json": True, "flat.json": True}
    runs = sorted(r["run"] for r in read_runs(spark, str(tmp_path), "run int").where("run is not null").collect())
    assert runs == [1, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13]
