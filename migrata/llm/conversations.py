"""Conversation structure repair: the cheapest edits that give every conversation a legal run of roles.

A legal conversation has the role initials ``(s?(ua)+)?``.  Rows are taken by turn (nulls first); rows of one
turn by the SHA-256 of role and text, so ties do not depend on how the table is stored.  A null role or text is
one blank.  A row's fault is the first of: blank (nothing but white space, blank or tab to carriage return),
duplicate (role and text seen earlier in the conversation), truncated (the last character that is no white space
is none of ``.!?``).  Edits: Keep costs 0; Rerole to user or assistant 3; Delete 4, the only one for blank and
duplicate rows; Insert of an empty user or assistant row 3; a truncated row that stays adds 3.  Of edits
of equal cost those whose initials, in order, come first in ASCII are taken.

1. Every row becomes one symbol, its role initial and fault; a conversation's symbols are its signature.
   Signatures collapse over all conversations.
2. Distinct signatures are sorted from their ends over range partitions.  In this order neighbours share the
   longest suffixes, so the automaton whose nodes are the distinct suffixes (the DAWG minimised from the
   end; its edges lead towards the end) is built along one path: a node is made once and left when no further
   signature of the partition ends in it.  At each node, and for each of the four grammar states, the cost to
   go and the first edit of the best audit suffix are computed once, from the node behind (``Node``).
3. The best audit of a signature is read off its nodes and joined back to the conversations; rows and audit
   meet, sorted, in one stream that applies the edits.

The role a reroled or inserted row gets follows from the state (user at the start and after system or
assistant, assistant after user), so the initials alone determine the result, and edits that start with
different initials are different edits: ties are settled at each node by the initial.

Scale: only the last step shuffles texts, once, by conversation; it streams sorted rows and holds one row at a
time, as SHA-256 needs them in order.  Duplicates are found by digests of (conversation, role, text), so a very
long conversation spreads over tasks; its signature is one byte a row.  Clean signatures, which most conversations
share, are one row of the automaton; AQE splits the join back.

Defined results: rows that repeat are duplicates of each other; a null conversation id is a conversation of
its own, ``" "`` in the damage rule, as is a null turn; an empty role, or one with another initial than s, u, a,
can not be kept; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from migrata.llm.common import col, small_batches, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = ("user", "assistant")
_SPACE = "\\x20\\x09-\\x0D"
# grammar states: nothing yet, after system, after user, after assistant
_NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_FORCED = (0, 0, 1, 0)
_AFTER = (2, 2, 3, 2)
_END = (0, None, None, 0)
_NEVER = 1 << 60
# a row's symbol: a letter for initial (s, u, a, other) and fault (none, blank, duplicate, truncated)
_INITIALS, _FAULTS = "sua", 4
SYMBOLS = "ABCDEFGHIJKLMNOP"


class Node:
    """One distinct suffix of signatures: per grammar state the cost to go and the first edit."""

    __slots__ = ("symbol", "behind", "cost", "edit")

    def __init__(self, symbol: str | None = None, behind: Node | None = None):
        self.symbol, self.behind = symbol, behind
        if behind is None:
            cost, edit = [_NEVER if c is None else c for c in _END], [""] * 4
        else:
            cost, edit = self._rows_edit(SYMBOLS.index(symbol), behind)
        # an insert leads from 0, 1 and 3 to 2 and from 2 to 3; two in a row from 3 or 2 would come back at a price
        before = list(zip(cost, edit))
        two = min(before[2], (before[3][0] + INSERT, "I"))
        three = min(before[3], (before[2][0] + INSERT, "I"))
        best = [min(before[0], (two[0] + INSERT, "I")), min(before[1], (two[0] + INSERT, "I")), two, three]
        self.cost, self.edit = [c for c, _ in best], [e for _, e in best]

    @staticmethod
    def _rows_edit(code: int, behind: Node) -> tuple[list[int], list[str]]:
        """The best edit of the first row itself, per state (least cost, then least initial)."""
        initial, fault = "sua."[code // _FAULTS], code % _FAULTS
        cost, edit = [], []
        for q in range(4):
            options = [(behind.cost[q] + DELETE, "D")]
            if fault in (0, 3):
                stays = TRUNCATED if fault == 3 else 0
                kept = _NEXT[initial][q] if initial != "." else None
                if kept is not None:
                    options.append((behind.cost[kept] + KEEP + stays, "K"))
                options.append((behind.cost[_AFTER[q]] + REROLE + stays, "R"))
            c, e = min(options)
            cost.append(c)
            edit.append(e)
        return cost, edit

    def step(self, state: int, edit: str) -> tuple[Node, int]:
        """The node and state behind an edit."""
        if edit == "I":
            return self, _AFTER[state]
        if edit == "D":
            return self.behind, state
        if edit == "K":
            return self.behind, _NEXT["sua"[SYMBOLS.index(self.symbol) // _FAULTS]][state]
        return self.behind, _AFTER[state]

    def audit(self) -> str:
        node, state, out = self, 0, []
        while e := node.edit[state]:
            out.append(e)
            node, state = node.step(state, e)
        return "".join(out)


def repairs(reversed_signatures: Iterator[str]) -> Iterator[tuple[int, str]]:
    """(cost, audit) of each signature; they come written from the end, sorted."""
    path, last = [Node()], ""
    for text in reversed_signatures:
        shared = 0
        for x, y in zip(text, last):
            if x != y:
                break
            shared += 1
        del path[shared + 1:]
        for symbol in text[shared:]:
            path.append(Node(symbol, path[-1]))
        last = text
        yield path[-1].cost[0], path[-1].audit()


def damaged(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, tie, copy, role, text) after the damage rule; ``tie`` orders the rows of a turn."""
    blank = F.lit(" ")
    rows = table.select(col(conv).alias("conv"), col(turn).alias("turn"), F.coalesce(col(role), blank).alias("role"), F.coalesce(col(text), blank).alias("text"))
    rows = rows.withColumn("kind", F.crc32(F.concat(F.coalesce(F.col("conv").cast("string"), blank), F.lit(":"),
                                                    F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20)
    rows = rows.select("conv", "turn", _digest().alias("tie"), "kind", "role", "text").where("kind <> 0")
    spoilt = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", "tie", F.explode(twice).alias("copy"), F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), spoilt.alias("text"))


def rows_of(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The same columns of a table that is taken as it is."""
    blank = F.lit(" ")
    rows = table.select(col(conv).alias("conv"), col(turn).alias("turn"), F.coalesce(col(role), blank).alias("role"), F.coalesce(col(text), blank).alias("text"))
    return rows.select("conv", "turn", _digest().alias("tie"), F.lit(0).alias("copy"), "role", "text")


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _symbols(rows: DataFrame) -> DataFrame:
    """(conv, turn, tie, copy, symbol) of the rows."""
    last = F.regexp_extract("text", f"([^{_SPACE}])[{_SPACE}]*\\z", 1)
    marked = rows.select("conv", "turn", "tie", "copy", _digest().alias("same"), F.substring("role", 1, 1).alias("initial"),
                         F.when(last == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3).alias("own"))
    place = F.struct("turn", "tie", "copy")
    firsts = marked.where("own <> 1").groupBy(F.col("conv").alias("c"), F.col("same").alias("s")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = marked.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    fault = F.when(F.col("own") == 1, 1).when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place), 2).otherwise(F.col("own"))
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    return joined.select("conv", "turn", "tie", "copy", F.substring(F.lit(SYMBOLS), initial * _FAULTS + fault + 1, F.lit(1)).alias("symbol"))


def _in_order(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows dealt by conversation, each one's rows together and in order."""
    return rows.repartition("conv").sortWithinPartitions(F.col("conv").isNull(), "conv", *columns)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, signature, gaps) of every conversation that has rows."""
    small_batches(rows.sparkSession)
    conv_type = rows.schema["conv"].dataType.simpleString()
    ordered = _in_order(_symbols(rows), "turn", "tie", "copy").select("conv", "turn", "tie", "symbol")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, symbols, schema = [], [], None
        now = lo = last = place = None
        turns = 0
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(0).with_name("conv"), ("signature", pa.string()), ("gaps", pa.int64())])
            for conv, turn, tie, symbol in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if symbols and conv != now:
                    out.append({"conv": now, "signature": "".join(symbols), "gaps": 0 if lo is None else last - lo + 1 - turns})
                    symbols, turns, lo, last, place = [], 0, None, None, None
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                now = conv
                code = SYMBOLS.index(symbol)
                # rows of the table that repeat have one place; all but the first are duplicates
                if (turn, tie) == place and code % _FAULTS != 1:
                    symbol = SYMBOLS[code // _FAULTS * _FAULTS + 2]
                place = (turn, tie)
                symbols.append(symbol)
                if turn is not None and turn != last:
                    turns, lo, last = turns + 1, turn if lo is None else lo, turn
        if symbols:
            out.append({"conv": now, "signature": "".join(symbols), "gaps": 0 if lo is None else last - lo + 1 - turns})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return ordered.mapInArrow(run, f"conv {conv_type}, signature string, gaps long")


def audits(distinct: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct signatures."""
    small_batches(distinct.sparkSession)
    ended = distinct.select(F.reverse("signature").alias("ending")).repartitionByRange("ending").sortWithinPartitions("ending")
    schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[str] = []

        def texts() -> Iterator[str]:
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    seen.append(text[::-1])
                    yield text

        out = []
        for cost, audit in repairs(texts()):
            out.append({"signature": seen.pop(), "cost": cost, "audit": audit})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return ended.mapInArrow(run, "signature string, cost long, audit string")


def _edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The rows (role, text) after the edits."""
    state = 0
    for e in audit:
        if e == "I":
            yield ROLES[_FORCED[state]], ""
            state = _AFTER[state]
            continue
        role, text = next(rows)
        if e == "K":
            yield role, text
            state = _NEXT[role[0]][state]
        elif e == "R":
            yield ROLES[_FORCED[state]], text
            state = _AFTER[state]


def _stream(rows: DataFrame, plans: DataFrame, columns: str, make) -> DataFrame:
    """``make(conv, audit, rows of the conversation) -> records`` over rows and audits that meet in one sorted stream."""
    small_batches(rows.sparkSession)
    kind = rows.schema["conv"].dataType.simpleString()
    both = rows.select("conv", F.lit(1).alias("kind"), "turn", "tie", "copy", "role", "text").unionByName(
        plans.select("conv", F.lit(0).alias("kind"), F.col("audit").alias("text")), allowMissingColumns=True)
    ordered = _in_order(both, "kind", "turn", "tie", "copy").select("conv", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([first.schema.field(0).with_name("conv"), *[
            pa.field(c.split()[0], {"string": pa.string(), "long": pa.int64()}[c.split()[1]]) for c in columns.split(", ")]])

        def lines():
            batch = first
            while batch is not None:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)))
                batch = next(batches, None)

        stream = lines()
        line = next(stream, None)
        while line is not None:
            conv, audit = line[0], line[3]
            line = next(stream, None)

            def own():
                nonlocal line
                while line is not None and line[1] == 1 and line[0] == conv:
                    role, text = line[2], line[3]
                    line = next(stream, None)
                    yield role, text

            mine = own()
            out = []
            for record in make(audit, mine):
                out.append({"conv": conv, **record})
                if len(out) == 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            for _ in mine:
                pass
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return ordered.mapInArrow(run, f"conv {kind}, {columns}")


def _hash(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[dict]:
    h, glue = hashlib.sha256(), b""
    for role, text in _edited(audit, rows):
        h.update(glue + role.encode() + b":" + text.encode())
        glue = b"\n"
    yield {"repaired_sha256": h.hexdigest()}


def _numbered(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[dict]:
    for n, (role, text) in enumerate(_edited(audit, rows)):
        yield {"place": n, "role": role, "text": text}


def plan(rows: DataFrame) -> DataFrame:
    """(conv, signature, gaps, cost, audit) of every conversation that has rows."""
    found = stored(signatures(rows), "signatures")
    best = audits(found.select("signature").distinct())
    return stored(found.join(best, "signature"), "audits")


def repaired(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired rows of a table: conversation, ``place`` (from 0), role and text."""
    rows = rows_of(table, conv, turn, role, text)
    out = _stream(rows, plan(rows), "place long, role string, text string", _numbered)
    return out.select(F.col("conv").alias(conv), "place", F.col("role").alias(role), F.col("text").alias(text))


def report(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation of the table, after the damage rule: its faults, the cheapest edits and the hash of the result."""
    rows = damaged(table, conv, turn, role, text)
    plans = plan(rows)
    hashes = _stream(rows, plans, "repaired_sha256 string", _hash)
    of = lambda fault: F.length("signature") - F.length(F.translate("signature", SYMBOLS[fault::_FAULTS], ""))
    # adjacent pairs that are su, ua or au: every such pair's first row, found by looking ahead one symbol
    letters = [SYMBOLS[i * _FAULTS:(i + 1) * _FAULTS] for i in range(3)]
    s, u, a = letters
    fine = F.expr(f"regexp_count(signature, '[{s}{a}](?=[{u}])|[{u}](?=[{a}])')")
    known = plans.select("conv", "gaps", of(1).alias("blank"), of(2).alias("duplicate"), of(3).alias("truncated"),
                         (F.length("signature") - 1 - fine).alias("illegal"), "cost", "audit").join(
        hashes.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    every = table.select(col(conv).alias("all")).distinct()
    out = every.join(known, F.col("all").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("all").alias(conv), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
