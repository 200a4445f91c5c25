"""Value semantics: str(), truthiness, tolerant equality, kind checks, value maps."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migrata.functions.values import coerce, kind_valid, literal_equal, py_str, remap, values_equal


def one(spark, expr, ddl, rows):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(expr.alias("v")).collect()]


def test_py_str_matches_python(spark):
    vals = [0.0, 1.5, 100.0, 12345678.9, 1e7, 1e16, 1.5e16, 1e-4, 0.00012, 1e-5, -2.5e20, 123456.78,
            float("nan"), float("inf"), -1e-4, 3.0e15]
    got = one(spark, py_str(F.col("x"), T.DoubleType()), "x double", [(v,) for v in vals])
    assert got == [str(v) for v in vals]
    assert one(spark, py_str(F.col("b"), T.BooleanType()), "b boolean", [(True,), (False,), (None,)]) == \
        ["True", "False", None]


def test_coerce_number_to_bool_and_back(spark):
    assert one(spark, coerce(F.col("n"), T.LongType(), "bool"), "n bigint", [(0,), (3,), (None,)]) == \
        [False, True, None]
    assert one(spark, coerce(F.col("b"), T.BooleanType(), "number"), "b boolean", [(True,), (False,)]) == [1, 0]


def test_values_equal_python_rules(spark):
    df = spark.createDataFrame([(1, 1.0000000001, True, "1", None)], "i bigint, d double, b boolean, s string, n string")
    r = df.select(
        values_equal(F.col("i"), T.LongType(), F.col("d"), T.DoubleType()).alias("int_float"),
        values_equal(F.col("b"), T.BooleanType(), F.col("i"), T.LongType()).alias("bool_int"),
        values_equal(F.col("s"), T.StringType(), F.col("i"), T.LongType()).alias("str_int"),
        values_equal(F.col("n"), T.StringType(), F.col("n"), T.StringType()).alias("none_none"),
        values_equal(F.col("n"), T.StringType(), F.col("s"), T.StringType()).alias("none_str"),
        values_equal(F.lit(float("nan")), T.DoubleType(), F.lit(float("nan")), T.DoubleType()).alias("nan"),
    ).first()
    assert (r.int_float, r.bool_int, r.str_int, r.none_none, r.none_str, r.nan) == (True, True, False, True, False,
                                                                                     False)


def test_literal_equal_and_kind_valid(spark):
    df = spark.createDataFrame([("admin", "2024-01-05", 3)], "r string, dt string, n bigint")
    r = df.select(literal_equal(F.col("r"), T.StringType(), "admin").alias("a"),
                  literal_equal(F.col("n"), T.LongType(), "3").alias("b"),
                  kind_valid(F.col("dt"), T.StringType(), "date").alias("c"),
                  kind_valid(F.col("n"), T.LongType(), "text").alias("d"),
                  kind_valid(F.col("n"), T.LongType(), "id").alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (True, False, True, False, True)


def test_remap_defaults(spark):
    rows = [("a",), ("b",), (None,)]
    assert one(spark, remap(F.col("x"), {"a": "A"}), "x string", rows) == ["A", "b", None]
    assert one(spark, remap(F.col("x"), {"a": "A"}, "null"), "x string", rows) == ["A", None, None]
    assert one(spark, remap(F.col("x"), {"a": "A"}, "suffix", "_v2"), "x string", rows) == ["A", "b_v2", None]


def test_nan_is_not_equal():
    assert not (abs(math.nan - math.nan) < 1e-9)


@pytest.mark.parametrize("kind,ok", [("number", True), ("bool", False), ("multi_enum", False)])
def test_kind_of_number_column(spark, kind, ok):
    assert one(spark, kind_valid(F.col("n"), T.LongType(), kind), "n bigint", [(1,)]) == [ok]
