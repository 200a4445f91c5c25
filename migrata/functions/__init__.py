"""Scalar column-expression builders (value equality, coercion, kind checks, value maps)."""

from .values import (
    coerce,
    inverse_map,
    kind_valid,
    literal_equal,
    map_expr,
    py_str,
    py_truthy,
    remap,
    values_equal,
)

__all__ = [
    "coerce", "inverse_map", "kind_valid", "literal_equal", "map_expr", "py_str", "py_truthy", "remap",
    "values_equal",
]
