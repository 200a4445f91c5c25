"""Record bags: mixed value classes, present None versus missing keys, exact scores."""

import pytest

from migrata.plans.verify import grade
from migrata.sources.records import records_to_table, parse_records
from tests.helpers import schema, tables

U = {"entities": {"User": {"fields": {"id": {"kind": "id"}, "age": {"kind": "number"}}}}}
OU = {"entities": {"Org": {"fields": {"id": {"kind": "id"}}},
                   "User": {"fields": {"id": {"kind": "id"}, "org_id": {"kind": "ref", "target": "Org"}}}}}


def bag(spark, lines):
    return records_to_table(parse_records(spark.createDataFrame([(x,) for x in lines], "value string")))


def test_split_by_class(spark):
    t = bag(spark, ['{"id": 1, "age": 5}', '{"id": 2, "age": "6"}', '', '{"id": 3, "age": null}', '{"id": 4}'])
    cols = set(t.columns)
    assert {"id", "age__mgt0", "age__mgt1", "age__mgnone", "_seq"} <= cols
    rows = sorted((r.id, r.age__mgt0, r.age__mgt1, r.age__mgnone) for r in t.collect())
    assert rows == [(1, 5, None, False), (2, None, "6", False), (3, None, None, True), (4, None, None, False)]


def test_mixed_classes_score(spark):
    src = tables(spark, {"User": ("id bigint, age bigint", [(1, 5), (2, 6)])})
    dest = {"User": bag(spark, ['{"id": 1, "age": 5}', '{"id": 2, "age": "6"}'])}
    r = grade(schema(U), [], src, dest)
    assert r["field_fidelity"] == pytest.approx(3 / 4)
    assert r["type_correctness"] == pytest.approx(3 / 4)
    assert r["total"] == pytest.approx(87.5)


def test_missing_versus_none(spark):
    src = tables(spark, {"User": ("id bigint, age bigint", [(1, 5), (2, 6)])})
    dest = {"User": bag(spark, ['{"id": 1}', '{"id": 2, "age": null}'])}
    r = grade(schema(U), [], src, dest)
    assert r["field_fidelity"] == pytest.approx(2 / 3)
    assert r["type_correctness"] == pytest.approx(2 / 3)
    assert r["total"] == pytest.approx(100 * (0.2 + 0.3 * 2 / 3 + 0.3 + 0.2 * 2 / 3))


def test_null_ref_as_record(spark):
    src = {"Org": bag(spark, ['{"id": 1}']), "User": bag(spark, ['{"id": 1, "org_id": null}'])}
    r = grade(schema(OU), [], src, dict(src))
    assert r["relationship_integrity"] == pytest.approx(0)
    assert r["type_correctness"] == pytest.approx(2 / 3)
    assert r["total"] == pytest.approx(63.0 + 1 / 3)


def test_float_id_is_not_an_id(spark):
    src = tables(spark, {"User": ("id bigint, age bigint", [(1, 5)])})
    dest = {"User": bag(spark, ['{"id": 1.0, "age": 5}'])}
    r = grade(schema(U), [], src, dest)
    assert r["coverage"] == pytest.approx(1.0)          # 1.0 matches id 1, as in a Python set
    assert r["type_correctness"] == pytest.approx(1 / 2)  # but a float is not a valid id


def test_order_over_several_files(spark, tmp_path):
    from migrata.operators.keys import last_wins
    from migrata.sources.records import read_records
    # Spark reads the larger file first; the file's name decides all the same
    (tmp_path / "part-0.json").write_text('{"id": 1, "age": 5}\n')
    (tmp_path / "part-1.json").write_text("\n" * 2000 + '{"id": 1, "age": 6}\n{"id": 1, "age": 7}\n')
    t = read_records(spark, str(tmp_path))
    assert [(r.id, r.age) for r in last_wins(t, "id", "_seq").collect()] == [(1, 7)]
