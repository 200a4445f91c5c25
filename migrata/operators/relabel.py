"""Opaque relabelling of a table set and its inverse.

Labels: tables ``EntityA``, ``EntityB``, ... ``EntityZ``, ``EntityAA``, ...; columns ``fa``,
``fb``, ... (``id`` keeps its name).  The order is a seeded hash of the names, so the maps
are deterministic across processes.  Relabelling a table is one ``select`` with aliases.
"""

from __future__ import annotations

import hashlib
from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import logical_name
from ..functions.values import inverse_map


def _letters(i: int, alphabet_start: str) -> str:
    """Bijective base-26 numeral: 0 -> A, 25 -> Z, 26 -> AA, 27 -> AB, ..."""
    out = ""
    n = i + 1
    base = ord(alphabet_start)
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(base + r) + out
    return out


def entity_label(i: int) -> str:
    return f"Entity{_letters(i, 'A')}"


def field_label(i: int) -> str:
    return f"f{_letters(i, 'a')}"


def _seeded_order(names, seed: int, salt: str = "") -> list[str]:
    return sorted(names, key=lambda n: hashlib.sha1(f"{seed}:{salt}:{n}".encode()).hexdigest())


def relabel_maps(columns: Mapping[str, list[str]], seed: int = 0) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """O1 maps: ``entity_map`` {table: label} and ``field_maps`` {table: {column: label}}."""
    tables = _seeded_order(list(columns), seed)
    entity_map = {t: entity_label(i) for i, t in enumerate(tables)}
    field_maps = {}
    for t in tables:
        non_id = _seeded_order([c for c in columns[t] if c != "id"], seed, t)
        fmap = {c: field_label(i) for i, c in enumerate(non_id)}
        if "id" in columns[t]:
            fmap["id"] = "id"
        field_maps[t] = fmap
    return entity_map, field_maps


def relabel(tables: Mapping[str, DataFrame], seed: int = 0):
    """O1: relabel every table and column; returns (tables, entity_map, field_maps)."""
    entity_map, field_maps = relabel_maps({t: df.columns for t, df in tables.items()}, seed)
    out = {}
    for t, df in tables.items():
        fmap = field_maps[t]
        out[entity_map[t]] = df.select(*[F.col(f"`{c}`").alias(fmap.get(c, c)) for c in df.columns])
    return out, entity_map, field_maps


def translate_back(tables: Mapping[str, DataFrame], entity_map: Mapping[str, str],
                   field_maps: Mapping[str, Mapping[str, str]]) -> dict[str, DataFrame]:
    """O2: reverse both maps; unknown tables and columns pass through unchanged.

    A field of a record bag is renamed with all its columns: one per value class, and the present-``None`` flag.
    """
    rev_entity = inverse_map(entity_map)
    out = {}
    for label, df in tables.items():
        real = rev_entity.get(label, label)
        rev_fields = inverse_map(field_maps.get(real, {})) if real in field_maps else {}
        # the tag of a class column follows the field's name
        names = {c: rev_fields[f] + c[len(f):] for c in df.columns if (f := logical_name(c)) in rev_fields}
        out[real] = df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])
    return out


def pre_remap_value(mapping: Mapping[str, str], value: str) -> str:
    """Original value of a remapped enum value (unknown values pass through)."""
    return inverse_map(mapping).get(value, value)
