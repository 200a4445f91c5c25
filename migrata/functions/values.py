"""Column-expression builders for value semantics.

All of these return ``pyspark.sql.Column`` built from built-in functions, so they stay
inside whole-stage codegen.  The Python side only inspects Spark *types* (driver
metadata) to pick the expression; no Python runs per row.

Semantics follow plain Python values:
* ``values_equal``: bools compare with ``==`` (``True == 1``), numbers within 1e-9,
  everything else exactly, ``None == None``; values of unrelated types differ.  Lists and records compare
  element by element (``[1] == [1.0]``).
* ``py_str``: ``str(value)`` as Python prints it (``True``, ``12345678.9``, ``1e+16``).
* ``coerce``: the retype coercions (text, bool, number).
"""

from __future__ import annotations

from typing import Any, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import DATE_PATTERN

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
NESTED = (T.ArrayType, T.StructType, T.MapType)
EPS = 1e-9


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL + FRACTIONAL)


def is_numberish(dt: T.DataType) -> bool:
    """Numeric or boolean (Python bool is an int)."""
    return is_numeric(dt) or isinstance(dt, T.BooleanType)


def is_null_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NullType)


def _as_number(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.BooleanType):
        return c.cast("bigint")
    if isinstance(dt, T.DecimalType):
        return c.cast("double")
    return c


def values_equal(a: Column, at: T.DataType, b: Column, bt: T.DataType) -> Column:
    """Tolerant, null-safe equality of two typed columns (never null)."""
    if is_null_type(at) or is_null_type(bt):
        return a.isNull() & b.isNull()
    both_null = a.isNull() & b.isNull()
    one_null = a.isNull() | b.isNull()
    if isinstance(at, T.BooleanType) or isinstance(bt, T.BooleanType):
        if is_numberish(at) and is_numberish(bt):
            eq = _as_number(a, at) == _as_number(b, bt)
        else:
            return both_null
    elif is_numeric(at) and is_numeric(bt):
        if is_integral(at) and is_integral(bt):
            eq = a.cast("bigint") == b.cast("bigint")
        else:
            eq = F.abs(_as_number(a, at) - _as_number(b, bt)) < F.lit(EPS)
    elif isinstance(at, T.StringType) and isinstance(bt, T.StringType):
        eq = a == b
    elif isinstance(at, (T.DateType, T.TimestampType, T.TimestampNTZType)) and type(at) is type(bt):
        eq = a == b
    elif isinstance(at, NESTED) and isinstance(bt, NESTED):
        eq = _nested_equal(a, at, b, bt)
    else:
        return both_null
    return F.when(one_null, both_null).otherwise(F.coalesce(eq, F.lit(False)))


def _variant_number(v: Column) -> Column:
    """The number a VARIANT holds (booleans count as 0 and 1), null for other values."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(
        kind.startswith("DECIMAL") | kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double"))


def _nested_equal(a: Column, at: T.DataType, b: Column, bt: T.DataType) -> Column:
    """Equality of two values inside lists and records as Python has it: exact, numbers and booleans by value,
    lists place by place, records field by field (a null field equals a missing one)."""
    if isinstance(at, T.ArrayType) and isinstance(bt, T.ArrayType):
        same = F.zip_with(a, b, lambda x, y: _nested_equal(x, at.elementType, y, bt.elementType))
        eq = (F.size(a) == F.size(b)) & F.forall(same, lambda e: e)
    elif isinstance(at, T.StructType) and isinstance(bt, T.StructType):
        x, y = {f.name: f.dataType for f in at.fields}, {f.name: f.dataType for f in bt.fields}
        eq = F.lit(True)
        for f in sorted({*x, *y}):
            one = _nested_equal(a[f], x[f], b[f], y[f]) if f in x and f in y else (a[f] if f in x else b[f]).isNull()
            eq = eq & one
    elif isinstance(at, T.MapType) and isinstance(bt, T.MapType):
        entries = [T.ArrayType(T.StructType([T.StructField("key", t.keyType), T.StructField("value", t.valueType)])) for t in (at, bt)]
        return _nested_equal(F.array_sort(F.map_entries(a)), entries[0], F.array_sort(F.map_entries(b)), entries[1])
    elif isinstance(at, T.VariantType) and isinstance(bt, T.VariantType):
        x, y = _variant_number(a), _variant_number(b)
        eq = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.to_json(a) == F.to_json(b))
    elif isinstance(at, T.VariantType) or isinstance(bt, T.VariantType):
        v, other, ot = (a, b, bt) if isinstance(at, T.VariantType) else (b, a, at)
        if is_numberish(ot):
            eq = _variant_number(v) == _as_number(other, ot).cast("double")
        elif isinstance(ot, T.StringType):
            eq = (F.schema_of_variant(v) == "STRING") & (F.try_variant_get(v, "$", "string") == other)
        else:
            eq = F.to_json(v) == F.to_json(other)
    elif is_numberish(at) and is_numberish(bt):
        whole = not isinstance(at, FRACTIONAL) and not isinstance(bt, FRACTIONAL)
        x, y = _as_number(a, at), _as_number(b, bt)
        eq = x.cast("bigint") == y.cast("bigint") if whole else x.cast("double") == y.cast("double")
    elif type(at) is type(bt) and not is_null_type(at):
        eq = a == b
    else:
        eq = F.lit(False)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.coalesce(eq, F.lit(False)))


def literal_equal(a: Column, at: T.DataType, value: Any) -> Column:
    """``a == value`` with Python semantics for a Python literal (never null)."""
    if value is None:
        return a.isNull()
    if isinstance(value, bool):
        return values_equal(a, at, F.lit(value), T.BooleanType())
    if isinstance(value, int):
        return values_equal(a, at, F.lit(value).cast("bigint"), T.LongType())
    if isinstance(value, float):
        return values_equal(a, at, F.lit(value).cast("double"), T.DoubleType())
    if isinstance(value, str):
        return values_equal(a, at, F.lit(value), T.StringType())
    return F.lit(False)


# ---------------------------------------------------------------------------
# str(value) as Python prints it
# ---------------------------------------------------------------------------
def _py_float_str(c: Column) -> Column:
    """Python ``repr(float)`` from Spark's shortest-digits double string.

    Between 1e-3 and 1e7 both print the same plain digits.  Outside, Spark prints
    ``1.2345E7`` / ``1.0E-4`` where Python prints plain digits from 1e-4 up to 1e16 and
    ``1e+16`` / ``1e-05`` beyond; only those rows are rebuilt, from digits and exponent
    bound once (a one-element ``transform`` acts as a let-binding, so no subexpression
    is duplicated in the generated code).
    """
    s = c.cast("string")
    body = F.regexp_replace(s, "^-", "")
    mant = F.substring_index(body, "E", 1)
    digits = F.regexp_replace(F.regexp_replace(mant, "[.]", ""), "0+$", "")
    bound = F.struct(s.startswith("-").alias("neg"), digits.alias("d"),
                     F.substring_index(body, "E", -1).cast("int").alias("e"))

    def build(t: Column) -> Column:
        d = F.when(t["d"] == "", F.lit("0")).otherwise(t["d"])
        e, n = t["e"], F.length(F.when(t["d"] == "", F.lit("0")).otherwise(t["d"]))
        exp_form = F.concat(
            F.when(n > 1, F.concat(F.substring(d, 1, 1), F.lit("."), F.substring(d, F.lit(2), n))).otherwise(d),
            F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(e).cast("string"), 2, "0"))
        big_form = F.concat(F.when(n >= e + 1, F.substring(d, F.lit(1), e + 1)).otherwise(F.rpad(d, e + 1, "0")),
                            F.lit("."), F.when(n > e + 1, F.substring(d, e + 2, n)).otherwise(F.lit("0")))
        small_form = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        rebuilt = F.when((e >= 16) | (e < -4), exp_form).when(e >= 0, big_form).otherwise(small_form)
        return F.concat(F.when(t["neg"], F.lit("-")).otherwise(F.lit("")), rebuilt)

    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(c), F.lit("nan"))
            .when(c == F.lit(float("inf")), F.lit("inf"))
            .when(c == F.lit(float("-inf")), F.lit("-inf"))
            .when(~s.contains("E"), s)
            .otherwise(F.element_at(F.transform(F.array(bound), build), 1)))


def py_str(c: Column, dt: T.DataType) -> Column:
    """``str(value)`` for a typed column; null stays null."""
    if isinstance(dt, T.StringType):
        return c
    if isinstance(dt, T.BooleanType):
        return F.when(c.isNull(), F.lit(None).cast("string")).when(c, F.lit("True")).otherwise(F.lit("False"))
    if is_integral(dt):
        return c.cast("string")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return _py_float_str(c.cast("double"))
    if isinstance(dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(dt, T.NullType):
        return F.lit(None).cast("string")
    return F.to_json(c) if isinstance(dt, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")


def py_truthy(c: Column, dt: T.DataType) -> Column:
    """``bool(value)``; null stays null."""
    if isinstance(dt, T.BooleanType):
        return c
    if is_numeric(dt):
        return c != 0
    if isinstance(dt, T.StringType):
        return F.length(c) > 0
    if isinstance(dt, T.ArrayType):
        return F.size(c) > 0
    if isinstance(dt, T.NullType):
        return F.lit(None).cast("boolean")
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(True))


def coerce(c: Column, dt: T.DataType, to_kind: str) -> Column:
    """Retype coercion towards ``to_kind``."""
    if to_kind in ("text", "richtext"):
        return py_str(c, dt)
    if to_kind == "bool":
        return py_truthy(c, dt)
    if to_kind == "number" and isinstance(dt, T.BooleanType):
        return c.cast("bigint")
    return c


# ---------------------------------------------------------------------------
# Kind validity (typed carrier)
# ---------------------------------------------------------------------------
def kind_valid(c: Column, dt: T.DataType, kind: str | None) -> Column:
    """Does a present value have the right kind?  Present nulls fail (like ``None``)."""
    if kind is None or kind not in ("id", "ref", "number", "bool", "date", "text", "richtext", "enum", "multi_enum", "nested"):
        return F.lit(True)
    if kind == "nested":
        return F.lit(True)
    if kind in ("id", "ref"):
        ok = is_integral(dt)
    elif kind == "number":
        ok = is_numeric(dt)
    elif kind == "bool":
        ok = isinstance(dt, T.BooleanType)
    elif kind in ("text", "richtext", "enum"):
        ok = isinstance(dt, T.StringType)
    elif kind == "multi_enum":
        ok = isinstance(dt, T.StringType) or isinstance(dt, T.ArrayType)
    elif kind == "date":
        if isinstance(dt, T.StringType):
            return c.isNotNull() & c.rlike(DATE_PATTERN)
        ok = isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))
    else:
        ok = True
    return c.isNotNull() if ok else F.lit(False)


# ---------------------------------------------------------------------------
# Value maps
# ---------------------------------------------------------------------------
def map_expr(mapping: Mapping[Any, Any]) -> Column:
    """Literal map column from a small driver-side dict (enum domains)."""
    if not mapping:
        return F.create_map().cast("map<string,string>")
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def remap(c: Column, mapping: Mapping[str, str], default: str = "self", suffix: str = "") -> Column:
    """Value map with a default: ``self`` (unknown passes through), ``null``, or ``suffix``."""
    hit = F.when(c.isNull(), F.lit(None).cast("string")).otherwise(F.try_element_at(map_expr(mapping), c)) \
        if mapping else F.lit(None).cast("string")
    if default == "self":
        return F.coalesce(hit, c)
    if default == "null":
        return hit
    if default == "suffix":
        return F.coalesce(hit, F.concat(c, F.lit(suffix)))
    raise ValueError(f"unknown default {default!r}")


def inverse_map(mapping: Mapping[str, str]) -> dict[str, str]:
    """Remapped value -> original; the first original wins on collisions."""
    out: dict[str, str] = {}
    for k, v in mapping.items():
        out.setdefault(v, k)
    return out
