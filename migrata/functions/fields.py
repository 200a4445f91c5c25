"""Logical fields over physical columns: one typed column, or one column per value class.

A destination read from JSON records can hold different value classes in one field
(``5`` in one row, ``"5"`` in another) and can hold a key with ``None`` as well as miss
the key.  Such a field ``f`` is stored as ``f__mgt0``, ``f__mgt1``, ... (one typed column
per class, null where the row has another class) plus ``f__mgnone`` (true when the key is
present with ``None``).  A plain column ``f`` is the one-class case.  Every destination
access of the verifier goes through ``field_map`` and the helpers below, so typed tables
and record bags are scored by the same expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import is_integral, is_numeric, kind_valid, values_equal

VAR_TAG = "__mgt"
NONE_TAG = "__mgnone"
KNOWN_KINDS = ("id", "ref", "number", "bool", "date", "text", "richtext", "enum", "multi_enum")


@dataclass
class FieldAccess:
    vars: list[tuple[str, T.DataType]] = field(default_factory=list)
    none: str | None = None

    def physical(self) -> list[str]:
        return [p for p, _ in self.vars] + ([self.none] if self.none else [])


def logical_name(col: str) -> str:
    if col.endswith(NONE_TAG):
        return col[: -len(NONE_TAG)]
    if VAR_TAG in col:
        return col.split(VAR_TAG)[0]
    return col


def field_map(schema: T.StructType) -> dict[str, FieldAccess]:
    out: dict[str, FieldAccess] = {}
    for f in schema.fields:
        name = logical_name(f.name)
        fa = out.setdefault(name, FieldAccess())
        if f.name.endswith(NONE_TAG):
            fa.none = f.name
        else:
            fa.vars.append((f.name, f.dataType))
    return out


def _c(prefix: str, phys: str) -> Column:
    return F.col(f"`{prefix}{phys}`")


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def present(fa: FieldAccess | None, null_present: bool = False, prefix: str = "") -> Column:
    """Key present in the row (a present ``None`` counts); ``null_present`` makes it always present."""
    if fa is None:
        return F.lit(False)
    if null_present:
        return F.lit(True)
    flags = [_c(prefix, p).isNotNull() for p, _ in fa.vars]
    if fa.none:
        flags.append(F.coalesce(_c(prefix, fa.none), F.lit(False)))
    return _any(flags)


def equal(fa: FieldAccess | None, xv: Column, xt: T.DataType, prefix: str = "") -> Column:
    """Destination value equals ``xv`` (a present ``None`` and a missing key both equal ``None``)."""
    if fa is None:
        return xv.isNull()
    if len(fa.vars) == 1 and not fa.none:
        p, dt = fa.vars[0]
        return values_equal(_c(prefix, p), dt, xv, xt)
    any_val = _any([_c(prefix, p).isNotNull() for p, _ in fa.vars])
    eq = _any([_c(prefix, p).isNotNull() & values_equal(_c(prefix, p), dt, xv, xt) for p, dt in fa.vars])
    out = F.when(any_val, eq).otherwise(xv.isNull())
    if fa.none:
        out = F.when(F.coalesce(_c(prefix, fa.none), F.lit(False)), xv.isNull()).otherwise(out)
    return out


def valid(fa: FieldAccess | None, kind: str | None, prefix: str = "") -> Column:
    """The present value has the right kind (a present ``None`` fails every known kind)."""
    if kind not in KNOWN_KINDS:
        return F.lit(True)
    if fa is None:
        return F.lit(False)
    return _any([_c(prefix, p).isNotNull() & kind_valid(_c(prefix, p), dt, kind) for p, dt in fa.vars])


def id_value(fa: FieldAccess | None, prefix: str = "") -> Column:
    """A key value as BIGINT for matching (``1 == 1.0 == True``); other classes never match."""
    if fa is None:
        return F.lit(None).cast("bigint")
    cands = []
    for p, dt in fa.vars:
        c = _c(prefix, p)
        if is_integral(dt) or isinstance(dt, T.BooleanType):
            cands.append(c.cast("bigint"))
        elif is_numeric(dt):
            d = c.cast("double")
            cands.append(F.when(d == F.floor(d), d.cast("bigint")))
    if not cands:
        return F.lit(None).cast("bigint")
    return F.coalesce(*cands) if len(cands) > 1 else cands[0]


def select_fields(fm: dict[str, FieldAccess], names, prefix: str) -> list[Column]:
    """Physical columns of ``names`` renamed with ``prefix`` (missing names are skipped)."""
    cols = []
    for n in names:
        if n in fm:
            cols += [F.col(f"`{p}`").alias(f"{prefix}{p}") for p in fm[n].physical()]
    return cols
