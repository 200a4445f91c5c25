"""Migration spec: schema, field kinds, ordered transform log, and the one fold over it.

Everything here is driver-side metadata.  No rows ever pass through this module;
it only decides which column expressions and joins the Spark plans are built from.

A log is an ordered tuple of frozen step dataclasses.  ``log_from_dicts`` /
``log_to_dicts`` read and write the plain-dict form (``{"type": "rename", ...}``)
so existing JSON logs can be used unchanged.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any, ClassVar, Iterable, Mapping

# ---------------------------------------------------------------------------
# Kind names, structural step types, coercions, score weights.
# These must equal the reference semantics for scores to match.
# ---------------------------------------------------------------------------
KINDS = ("id", "ref", "number", "bool", "date", "text", "richtext", "enum", "multi_enum", "nested")
STRUCTURAL_TYPES = frozenset(
    {"merge", "split", "flatten_nested", "unmapped", "denormalize", "partition", "computed", "extract_nested"}
)
COERCIONS = {
    "text": ("richtext",),
    "richtext": ("text",),
    "date": ("text",),
    "number": ("text", "bool"),
    "bool": ("number",),
}
WEIGHTS = {"coverage": 0.20, "field_fidelity": 0.30, "relationship_integrity": 0.30, "type_correctness": 0.20}
ALPHA = 0.20
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
COMPUTED_OPS = ("concat", "multiply", "sum_fields", "bool_from_enum")


class SpecError(ValueError):
    """A schema or log that cannot be applied."""


# ---------------------------------------------------------------------------
# Schema
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class FieldDef:
    kind: str | None
    values: tuple[str, ...] | None = None  # enum / multi_enum domain
    target: str | None = None  # ref target entity
    of: str | None = None  # nested block name

    @staticmethod
    def from_dict(d: Mapping[str, Any]) -> "FieldDef":
        vals = d.get("values")
        return FieldDef(d.get("kind"), tuple(vals) if vals is not None else None, d.get("target"), d.get("of"))

    def to_dict(self) -> dict:
        out: dict[str, Any] = {"kind": self.kind}
        if self.values is not None:
            out["values"] = list(self.values)
        if self.target is not None:
            out["target"] = self.target
            out["cardinality"] = "one"
        if self.of is not None:
            out["of"] = self.of
        return out


@dataclass
class Schema:
    """Ordered entities -> ordered fields, plus nested block definitions."""

    entities: dict[str, dict[str, FieldDef]]
    blocks: dict[str, dict[str, FieldDef]] = field(default_factory=dict)

    @staticmethod
    def from_dict(d: Mapping[str, Any]) -> "Schema":
        ents = {
            e: {f: FieldDef.from_dict(fd) for f, fd in edef["fields"].items()} for e, edef in d["entities"].items()
        }
        blocks = {
            b: {f: FieldDef.from_dict(fd) for f, fd in bdef["fields"].items()}
            for b, bdef in (d.get("nested_blocks") or {}).items()
        }
        return Schema(ents, blocks)

    def to_dict(self) -> dict:
        out: dict[str, Any] = {
            "entities": {e: {"fields": {f: fd.to_dict() for f, fd in fs.items()}} for e, fs in self.entities.items()}
        }
        if self.blocks:
            out["nested_blocks"] = {
                b: {"fields": {f: fd.to_dict() for f, fd in fs.items()}} for b, fs in self.blocks.items()
            }
        return out

    def kinds(self, entity: str) -> dict[str, str | None]:
        return {f: fd.kind for f, fd in self.entities.get(entity, {}).items()}

    def refs(self, entity: str) -> list[tuple[str, str]]:
        return [(f, fd.target) for f, fd in self.entities.get(entity, {}).items() if fd.kind == "ref"]


def validate_schema(schema: Schema) -> list[str]:
    """Problems of a schema: name collisions, id count, unknown ref targets / blocks."""
    problems = []
    for name in schema.entities:
        if name in schema.blocks:
            problems.append(f"entity and block share the name {name!r}")
    for ename, fields in schema.entities.items():
        n_id = sum(1 for fd in fields.values() if fd.kind == "id")
        if n_id != 1:
            problems.append(f"{ename}: expected exactly one id field, found {n_id}")
        for fname, fd in fields.items():
            if fd.kind == "ref" and fd.target not in schema.entities:
                problems.append(f"{ename}.{fname}: ref to unknown entity {fd.target!r}")
            if fd.kind == "nested" and fd.of not in schema.blocks:
                problems.append(f"{ename}.{fname}: nested of unknown block {fd.of!r}")
    return problems


# ---------------------------------------------------------------------------
# Shape: what the tables look like at one point of a log
# ---------------------------------------------------------------------------
Fields = Mapping[str, FieldDef]


@dataclass(frozen=True)
class Shape:
    """Tables between two steps, and where the names of the source went.

    Every step maps one shape to the next (``Step.on``); nothing is changed in place.  All that the
    verifier asks about a log is read off the last shape:

    * ``tables``  - field definitions per table
    * ``blocks``  - fields of nested blocks
    * ``names``   - (entity, name before its renames) -> name it was last seen under
    * ``homes``   - table that a step took away -> tables that hold its rows instead
    * ``absorbed``- tables whose rows went into another one's rows (merge children)
    * ``filled``  - table -> columns that the log writes in every row
    """

    tables: Mapping[str, Fields]
    blocks: Mapping[str, Fields]
    names: Mapping[tuple[str, str], str]
    homes: Mapping[str, tuple[str, ...]]
    absorbed: frozenset[str]
    filled: Mapping[str, frozenset[str]]

    @staticmethod
    def start(schema: "Schema") -> "Shape":
        return Shape(schema.entities, schema.blocks, {}, {}, frozenset(), {})

    def fields(self, table: str) -> Fields:
        return self.tables.get(table, {})

    def with_tables(self, changed: Mapping[str, Fields], without: Iterable[str] = ()) -> "Shape":
        gone = set(without) - set(changed)
        return replace(self, tables={t: f for t, f in {**self.tables, **changed}.items() if t not in gone})

    def with_fields(self, table: str, changed: Fields, without: Iterable[str] = ()) -> "Shape":
        """``table`` with fields added or replaced and others left out (an unknown table stays unknown)."""
        if table not in self.tables:
            return self
        gone = set(without) - set(changed)
        return self.with_tables({table: {f: d for f, d in {**self.tables[table], **changed}.items() if f not in gone}})

    def moved(self, table: str, to: Iterable[str]) -> "Shape":
        return self if table in self.homes else replace(self, homes={**self.homes, table: tuple(to)})

    def writes(self, table: str, columns: Iterable[str]) -> "Shape":
        return replace(self, filled={**self.filled, table: self.filled.get(table, frozenset()) | set(columns)})

    def refs_to(self, table: str) -> list[tuple[str, str]]:
        return [(t, f) for t, fs in self.tables.items() for f, d in fs.items() if d.kind == "ref" and d.target == table]

    def source_name(self, entity: str, now: str) -> str:
        """The name a field of ``entity`` had in the source, given its present one."""
        return next((before for (e, before), after in self.names.items() if e == entity and after == now), now)


# ---------------------------------------------------------------------------
# Steps: dict form, preconditions and effect on a shape, one class each
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Step:
    """One log step.  ``type`` is its name in the dict form."""

    type: ClassVar[str] = ""

    @classmethod
    def read(cls, d: Mapping[str, Any]) -> "Step":
        raise NotImplementedError

    def write(self) -> dict:
        raise NotImplementedError

    def faults(self, shape: Shape) -> Iterable[str]:
        """What is wrong with applying the step to ``shape``."""
        return ()

    def on(self, shape: Shape) -> Shape:
        return shape


@dataclass(frozen=True)
class Rename(Step):
    entity: str
    from_: str
    to: str
    type: ClassVar[str] = "rename"

    @classmethod
    def read(cls, d):
        return cls(d["entity"], d["from"], d["to"])

    def write(self):
        return {"type": self.type, "entity": self.entity, "from": self.from_, "to": self.to}

    def on(self, shape):
        before = shape.source_name(self.entity, self.from_)
        shape = replace(shape, names={**shape.names, (self.entity, before): self.to})
        held = shape.fields(self.entity)
        if self.from_ not in held:
            return shape
        return shape.with_tables({self.entity: {self.to if f == self.from_ else f: d for f, d in held.items()}})


@dataclass(frozen=True)
class Retype(Step):
    entity: str
    field: str
    from_: str
    to: str
    type: ClassVar[str] = "retype"

    @classmethod
    def read(cls, d):
        return cls(d["entity"], d["field"], d["from"], d["to"])

    def write(self):
        return {"type": self.type, "entity": self.entity, "field": self.field, "from": self.from_, "to": self.to}

    def on(self, shape):
        known = self.field in shape.fields(self.entity)
        return shape.with_fields(self.entity, {self.field: FieldDef(self.to)}) if known else shape


class _Mapped(Step):
    """Steps with an ordered value mapping."""

    @property
    def as_dict(self) -> dict[str, str]:
        return dict(self.mapping)


@dataclass(frozen=True)
class EnumRemap(_Mapped):
    entity: str
    field: str
    mapping: tuple[tuple[str, str], ...]
    type: ClassVar[str] = "enum_remap"

    @classmethod
    def read(cls, d):
        return cls(d["entity"], d["field"], tuple(d["mapping"].items()))

    def write(self):
        return {"type": self.type, "entity": self.entity, "field": self.field, "mapping": self.as_dict}

    def on(self, shape):
        held = shape.fields(self.entity).get(self.field)
        if held is None:
            return shape
        return shape.with_fields(self.entity, {self.field: replace(held, values=tuple(self.as_dict.values()))})


@dataclass(frozen=True)
class Unmapped(Step):
    entity: str
    field: str
    type: ClassVar[str] = "unmapped"

    @classmethod
    def read(cls, d):
        return cls(d["entity"], d["field"])

    def write(self):
        return {"type": self.type, "entity": self.entity, "field": self.field}

    def on(self, shape):
        return shape.with_fields(self.entity, {}, without=[self.field])


@dataclass(frozen=True)
class FlattenNested(Step):
    entity: str
    field: str
    block: str
    into: str
    strategy: str = "count"
    type: ClassVar[str] = "flatten_nested"

    @classmethod
    def read(cls, d):
        return cls(d["entity"], d["field"], d.get("block", ""), d["into"], d.get("strategy", "count"))

    def write(self):
        return {"type": self.type, "entity": self.entity, "field": self.field, "block": self.block, "into": self.into,
                "strategy": self.strategy}

    def on(self, shape):
        return shape.with_fields(self.entity, {self.into: FieldDef("number")}, without=[self.field])


@dataclass(frozen=True)
class Split(Step):
    from_: str
    detail: str
    moved_fields: tuple[str, ...]
    link_field: str
    type: ClassVar[str] = "split"

    @classmethod
    def read(cls, d):
        return cls(d["from"], d["into"][1], tuple(d["moved_fields"]), d["link_field"])

    def write(self):
        return {"type": self.type, "from": self.from_, "into": [self.from_, self.detail],
                "moved_fields": list(self.moved_fields), "link_field": self.link_field}

    def faults(self, shape):
        if self.from_ not in shape.tables:
            yield f"split {self.from_}: no such table"
            return
        held = shape.fields(self.from_)
        plain = [f for f, d in held.items() if d.kind not in ("id", "ref", "nested")]
        if len(held) < 4 or len(plain) < 2:
            yield f"split {self.from_}: needs >= 4 fields and >= 2 scalars"
        if self.detail in shape.tables:
            yield f"split {self.from_}: {self.detail} already exists"

    def on(self, shape):
        held = shape.fields(self.from_)
        detail = {"id": FieldDef("id"), self.link_field: FieldDef("ref", target=self.from_)}
        detail |= {f: held[f] for f in self.moved_fields if f in held}
        return shape.with_fields(self.from_, {}, without=self.moved_fields).with_tables({self.detail: detail})


@dataclass(frozen=True)
class Merge(Step):
    parent: str
    child: str
    into: str
    dropped_link_field: str
    type: ClassVar[str] = "merge"

    @classmethod
    def read(cls, d):
        return cls(d["from"][0], d["from"][1], d["into"], d["dropped_link_field"])

    def write(self):
        return {"type": self.type, "from": [self.parent, self.child], "into": self.into,
                "dropped_link_field": self.dropped_link_field}

    def faults(self, shape):
        for t in (self.parent, self.child):
            if t not in shape.tables:
                yield f"merge {self.parent}+{self.child}: no table {t}"
        if sum(d.kind == "ref" for d in shape.fields(self.child).values()) != 1:
            yield f"merge {self.parent}+{self.child}: child must have exactly one ref"
        for t, f in shape.refs_to(self.child):
            yield f"merge: {t}.{f} refers to the child {self.child}"
        for t, f in shape.refs_to(self.parent):
            if t != self.child:
                yield f"merge: {t}.{f} refers to the parent {self.parent}"

    def on(self, shape):
        joined = dict(shape.fields(self.parent))
        for f, d in shape.fields(self.child).items():
            if d.kind != "id" and f != self.dropped_link_field:
                joined[merged_column_name(f, joined, self.child)] = d
        kept = {t: {f: replace(d, target=self.into) if d.kind == "ref" and d.target == self.parent else d for f, d in fs.items()}
                for t, fs in {**shape.tables, self.into: joined}.items() if t == self.into or t not in (self.parent, self.child)}
        after = replace(shape, absorbed=shape.absorbed | {self.child}).with_tables(kept, without=[self.parent, self.child])
        return after.moved(self.parent, [self.into]).moved(self.child, [self.into])


@dataclass(frozen=True)
class ExtractNested(Step):
    entity: str
    field: str
    block: str
    new_entity: str
    link_field: str
    type: ClassVar[str] = "extract_nested"

    @classmethod
    def read(cls, d):
        return cls(d["entity"], d["field"], d.get("block", ""), d["new_entity"], d["link_field"])

    def write(self):
        return {"type": self.type, "entity": self.entity, "field": self.field, "block": self.block,
                "new_entity": self.new_entity, "link_field": self.link_field}

    def on(self, shape):
        rows = {"id": FieldDef("id"), self.link_field: FieldDef("ref", target=self.entity), **shape.blocks.get(self.block, {})}
        return shape.with_fields(self.entity, {}, without=[self.field]).with_tables({self.new_entity: rows})


@dataclass(frozen=True)
class Partition(_Mapped):
    entity: str
    on_field: str
    mapping: tuple[tuple[str, str], ...]  # (value, sub entity), in declared order
    type: ClassVar[str] = "partition"

    @classmethod
    def read(cls, d):
        return cls(d["entity"], d["on_field"], tuple(d["mapping"].items()))

    def write(self):
        return {"type": self.type, "entity": self.entity, "on_field": self.on_field, "mapping": self.as_dict}

    @property
    def subs(self) -> list[str]:
        return list(dict.fromkeys(sub for _, sub in self.mapping))

    def faults(self, shape):
        for t, f in shape.refs_to(self.entity):
            yield f"partition {self.entity}: referenced by {t}.{f}"
        held = shape.fields(self.entity).get(self.on_field)
        if held is None or held.kind != "enum" or len(held.values or ()) < 2:
            yield f"partition {self.entity}: {self.on_field} must be an enum with >= 2 values"

    def on(self, shape):
        kept = {f: d for f, d in shape.fields(self.entity).items() if f != self.on_field}
        return shape.with_tables({sub: kept for sub in self.subs}, without=[self.entity]).moved(self.entity, self.subs)


@dataclass(frozen=True)
class Denormalize(Step):
    entity: str
    via_field: str
    from_entity: str
    inlined: tuple[tuple[str, str], ...]  # (source_field, dest_field)
    type: ClassVar[str] = "denormalize"

    @classmethod
    def read(cls, d):
        return cls(d["entity"], d["via_field"], d["from_entity"], tuple((i["source_field"], i["dest_field"]) for i in d["inlined"]))

    def write(self):
        return {"type": self.type, "entity": self.entity, "via_field": self.via_field, "from_entity": self.from_entity,
                "inlined": [{"source_field": a, "dest_field": b} for a, b in self.inlined]}

    def faults(self, shape):
        if self.from_entity not in shape.tables:
            gone = self.from_entity in shape.homes
            yield f"denormalize {self.entity}: {self.from_entity} {'did not survive' if gone else 'is an unknown source'}"

    def on(self, shape):
        # values are looked up in the source, so its definitions count, not those of the moment
        looked_up = shape.blocks.get(SOURCE + self.from_entity, shape.fields(self.from_entity))
        added = {now: looked_up.get(before, FieldDef("text")) for before, now in self.inlined}
        return shape.with_fields(self.entity, added).writes(self.entity, added)


@dataclass(frozen=True)
class Computed(Step):
    entity: str
    operation: str
    dest_field: str
    source_fields: tuple[str, ...] = ()
    separator: str = " "
    source_field: str | None = None
    value: Any = None
    type: ClassVar[str] = "computed"

    @classmethod
    def read(cls, d):
        return cls(d["entity"], d["operation"], d["dest_field"], tuple(d.get("source_fields") or ()),
                   d.get("separator", " "), d.get("source_field"), d.get("value"))

    def write(self):
        out = {"type": self.type, "entity": self.entity, "operation": self.operation, "dest_field": self.dest_field}
        if self.operation == "bool_from_enum":
            return out | {"source_field": self.source_field, "value": self.value}
        out["source_fields"] = list(self.source_fields)
        return out | {"separator": self.separator} if self.operation == "concat" else out

    def faults(self, shape):
        if self.operation not in COMPUTED_OPS:
            yield f"computed {self.entity}.{self.dest_field}: unknown operation {self.operation!r}"

    def on(self, shape):
        return shape.with_fields(self.entity, {self.dest_field: FieldDef(computed_kind(self.operation))}).writes(
            self.entity, [self.dest_field])


_STEPS = {c.type: c for c in (Rename, Retype, EnumRemap, Unmapped, FlattenNested, Split, Merge, ExtractNested, Partition,
                              Denormalize, Computed)}
#: prefix under which ``fold`` keeps the source's own tables among the blocks, for look-ups
SOURCE = "source:"


def step_from_dict(d: Mapping[str, Any]) -> Step:
    if d["type"] not in _STEPS:
        raise SpecError(f"unknown step type {d['type']!r}")
    return _STEPS[d["type"]].read(d)


def step_to_dict(s: Step) -> dict:
    return s.write()


def log_from_dicts(items: Iterable[Mapping[str, Any]]) -> tuple[Step, ...]:
    return tuple(step_from_dict(d) for d in items)


def log_to_dicts(log: Iterable[Step]) -> list[dict]:
    return [step_to_dict(s) for s in log]


def log_from_json(text: str) -> tuple[Step, ...]:
    return log_from_dicts(json.loads(text))


def computed_kind(op: str) -> str:
    return {"concat": "text", "bool_from_enum": "bool"}.get(op, "number")


def merged_column_name(field_name: str, existing: Iterable[str], child: str) -> str:
    """Child column name inside a merged table: prefixed with the child name on collision."""
    return f"{child.lower()}_{field_name}" if field_name in set(existing) else field_name


# ---------------------------------------------------------------------------
# The one fold, and what is read off it
# ---------------------------------------------------------------------------
def fold(schema: Schema, log: Iterable[Step]) -> tuple[Shape, list[str]]:
    """The shape after the log, and the preconditions that its steps break."""
    shape = Shape.start(schema)
    shape = replace(shape, blocks={**shape.blocks, **{SOURCE + e: f for e, f in schema.entities.items()}})
    problems: list[str] = []
    inlined: set[tuple[str, str]] = set()
    for s in log:
        problems += s.faults(shape)
        if isinstance(s, Computed):
            problems += [f"computed {s.entity}.{s.dest_field}: reads the inlined column {f}"
                         for f in (*s.source_fields, s.source_field) if (s.entity, f) in inlined]
        elif isinstance(s, Denormalize):
            inlined |= {(s.entity, now) for _, now in s.inlined}
        shape = s.on(shape)
    return shape, problems


def dest_schema(schema: Schema, log: Iterable[Step]) -> Schema:
    """Destination schema (field definitions, ref targets, blocks) after the log."""
    shape, _ = fold(schema, log)
    return Schema({t: dict(f) for t, f in shape.tables.items()}, {b: dict(f) for b, f in schema.blocks.items()})


def dest_kinds(schema: Schema, log: Iterable[Step]) -> dict[str, dict[str, str | None]]:
    """Expected {dest table: {column: kind}} after the log."""
    return {t: {f: d.kind for f, d in fs.items()} for t, fs in fold(schema, log)[0].tables.items()}


def check_preconditions(schema: Schema, log: Iterable[Step]) -> list[str]:
    """Preconditions that keep refs and values valid after structural steps (empty list = fine)."""
    return fold(schema, log)[1]


def require(schema: Schema, log: Iterable[Step]) -> None:
    """Raise ``SpecError`` for a schema or log that cannot be replayed faithfully."""
    problems = [*validate_schema(schema), *check_preconditions(schema, log)]
    if problems:
        raise SpecError("; ".join(problems))


class LogContext:
    """Questions of the verifier about a log, answered from its last shape."""

    def __init__(self, schema: Schema, log: Iterable[Step]):
        self.schema = schema
        self.log = tuple(log)
        self.shape, _ = fold(schema, self.log)
        self.has_structural = any(s.type in STRUCTURAL_TYPES for s in self.log)
        self.merges, self.splits, self.extracts = (self._all(c) for c in (Merge, Split, ExtractNested))
        self.merge_parents = {m.parent: m.into for m in self.merges}
        self.merge_children = set(self.shape.absorbed)
        self.partition_of = {p.entity: p for p in self._all(Partition)}
        self.removed = set(self.shape.homes)

    def _all(self, kind: type) -> list:
        return [s for s in self.log if isinstance(s, kind)]

    @property
    def computeds(self) -> list[Computed]:
        return self._all(Computed)

    def dest_field_name(self, entity: str, source_field: str) -> str:
        return self.shape.names.get((entity, source_field), source_field)

    def source_field_name(self, entity: str, now: str) -> str:
        return self.shape.source_name(entity, now)

    def unmapped_fields(self, entity: str) -> list[str]:
        return [s.field for s in self._all(Unmapped) if s.entity == entity]

    def null_present(self, entity: str) -> set[str]:
        """Columns the log always writes, so a null there is a present None."""
        return set(self.shape.filled.get(entity, ()))

    def tables_of(self, entity: str, written: Iterable[str]) -> list[str] | None:
        """Tables that hold an entity's rows: its own if written, else those it was moved to."""
        if entity in set(written):
            return [entity]
        home = self.shape.homes.get(entity)
        return None if home is None else list(home)

    def id_tables(self, target: str) -> list[str]:
        """Tables whose ids are valid values of a ref to ``target``."""
        return [target] if target in self.shape.absorbed else list(self.shape.homes.get(target, (target,)))

    def hosts(self, entity: str, column: str) -> list[str]:
        """Tables that should hold ``column`` after the log: the entity's own first, then its details."""
        near = [entity, *(s.detail for s in self.splits if s.from_ == entity and column in s.moved_fields)]
        return [t for t in near if column in self.shape.fields(t)]
