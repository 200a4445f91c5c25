"""Resharding by minimum-cost flow.

A sharded table (``Layout``) is a set of Parquet folders, one sub-folder per shard.  ``reshard`` turns
its shard sizes into those of new capacities while moving the fewest bytes:

1. every shard is cut into ``BLOCKS`` blocks by a hash of the row number that the layout stores, and the
   sizes of the blocks are summed (at most shards x BLOCKS rows, whatever the data: the only thing
   that reaches the driver);
2. a minimum-cost flow from old shards (supply: their bytes) to new shards (their capacities), at cost
   0 for staying and 1 per byte for moving, says how many bytes go from where to where;
3. blocks, largest first, fill those flows; a short exchange then evens out what whole blocks leave over;
4. the shards that lose blocks are rewritten and the arriving blocks are added as new files; files of
   shards that lose nothing stay as they are.

The law of the result is ``bytes``: shard sizes are near equal (to a few rows' sizes).  Rows of one hot
key, source or text are cut apart like any others, because blocks follow row numbers.

Defined results: a null text has no bytes (size 1, checksum that of the empty text); repeated rows are
separate rows with slots of their own; a null shard key counts as the empty text; an empty table gives
an empty table; other columns are carried along in the layout unchanged.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migrata.llm.common import col, scratch

BLOCKS = 4096
SHARDS = 16
_SHARD, _ROW, _BLOCK, _SIZE = "__shard", "__row", "__block", "__size"


@dataclass(frozen=True)
class Layout:
    """A sharded table: folders (each with ``__shard=K`` below) and the shards that count in each."""

    columns: T.StructType
    folders: tuple[tuple[str, tuple[int, ...]], ...]

    def read(self, spark) -> DataFrame:
        schema = T.StructType([*self.columns.fields, T.StructField(_ROW, T.LongType()), T.StructField(_BLOCK, T.IntegerType()),
                               T.StructField(_SIZE, T.LongType()), T.StructField("__from", T.IntegerType()), T.StructField(_SHARD, T.IntegerType())])
        parts = [spark.read.schema(schema).parquet(path).where(F.col(_SHARD).isin(*shards)) for path, shards in self.folders if shards]
        out = parts[0] if parts else spark.createDataFrame([], schema)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def lay_out(docs: DataFrame, shard: Column, size: Column, shards: int = SHARDS) -> Layout:
    """``docs`` written as a sharded table; ``shard`` gives each row's old shard."""
    spark = docs.sparkSession
    taken = {c.lower() for c in docs.columns} & {_SHARD, _ROW, _BLOCK, _SIZE, "__from"}
    if taken:
        raise ValueError(f"a layout has columns of its own called {sorted(taken)}")
    path = scratch(spark, "layout")
    # the row number is fixed by the write, so it may depend on the input's partitions
    (docs.withColumn(_ROW, F.monotonically_increasing_id())
     .withColumn(_BLOCK, F.pmod(F.xxhash64(_ROW), F.lit(BLOCKS)).cast("int"))
     .withColumn(_SIZE, size).withColumn(_SHARD, shard.cast("int")).withColumn("__from", F.col(_SHARD))
     .write.partitionBy(_SHARD).parquet(path))
    return Layout(docs.schema, ((path, tuple(range(shards))),))


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost) -> dict[tuple[int, int], int]:
    """Amounts per (from, to) that place all supply within the capacities at the least cost.

    Successive shortest augmenting paths with potentials; the graph has a node per shard.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities hold less than there is")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []

    def arc(a: int, b: int, cap: int, c: int) -> None:
        for x, y, k, p in ((a, b, cap, c), (b, a, 0, -c)):
            graph[x].append(len(to))
            to.append(y)
            room.append(k)
            price.append(p)

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
    first = len(to)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, supply[i], cost(i, j))
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    potential = [0] * (n + m + 2)
    left = sum(supply)
    while left:
        dist: list[float] = [float("inf")] * len(graph)
        via = [-1] * len(graph)
        dist[source] = 0
        queue: list[tuple[float, int]] = [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            for e in graph[u]:
                if room[e]:
                    nd = d + price[e] + potential[u] - potential[to[e]]
                    if nd < dist[to[e]]:
                        dist[to[e]], via[to[e]] = nd, e
                        heapq.heappush(queue, (nd, to[e]))
        reach = max(d for d in dist if d < float("inf"))
        for v, d in enumerate(dist):
            potential[v] += int(min(d, reach))
        push, v = left, sink
        while v != source:
            push, v = min(push, room[via[v]]), to[via[v] ^ 1]
        v = sink
        while v != source:
            room[via[v]] -= push
            room[via[v] ^ 1] += push
            v = to[via[v] ^ 1]
        left -= push
    return {(i, j): room[(first + 2 * (i * m + j)) ^ 1] for i in range(n) for j in range(m) if room[(first + 2 * (i * m + j)) ^ 1]}


def place_blocks(blocks: Sequence[tuple[int, int, int]], flows: dict[tuple[int, int], int], capacity: Sequence[int]) -> dict[tuple[int, int], int]:
    """(old shard, block) -> new shard for ``blocks`` of (old shard, block, bytes), following the flows."""
    need = {}
    for (i, j), f in flows.items():
        need.setdefault(i, []).append([f, j])
    where: dict[tuple[int, int], int] = {}
    got = [0] * len(capacity)
    sizes = {}
    for i, b, n in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        # staying comes first while it fits, else the neediest new shard
        goals = need[i]
        own = next((g for g in goals if g[1] == i), None)
        goal = own if own is not None and own[0] >= n else max(goals, key=lambda g: (g[0], -g[1]))
        goal[0] -= n
        where[i, b] = goal[1]
        got[goal[1]] += n
        sizes[i, b] = n
    # what whole blocks leave over: move a block of half the difference from the fullest to the emptiest
    held: dict[int, list[tuple[int, tuple[int, int]]]] = {j: [] for j in range(len(capacity))}
    for key, j in where.items():
        held[j].append((sizes[key], key))
    for h in held.values():
        h.sort()
    for _ in range(64 * len(capacity)):
        over = [g - c for g, c in zip(got, capacity)]
        a, b = max(range(len(over)), key=over.__getitem__), min(range(len(over)), key=over.__getitem__)
        gap = over[a] - over[b]
        at = min(bisect_left(held[a], (gap // 2 + 1,)), len(held[a])) - 1
        if at < 0 or held[a][at][0] >= gap or gap < 2:
            break
        n, key = held[a].pop(at)
        held[b].insert(bisect_left(held[b], (n, key)), (n, key))
        got[a], got[b], where[key] = got[a] - n, got[b] + n, b
    return where


def reshard(spark, layout: Layout, shards: int = SHARDS, capacity: Sequence[int] | None = None) -> tuple[Layout, DataFrame, dict[str, int]]:
    """The layout after moving the fewest bytes, every (old shard, block) with its new shard, row count
    and first slot, and how many bytes there are and moved.  ``capacity``: bytes per new shard (default: equal)."""
    rows = layout.read(spark)
    blocks = [(r[0], r[1], r[2], r[3]) for r in
              rows.groupBy(_SHARD, _BLOCK).agg(F.sum(_SIZE).alias("n"), F.count(F.lit(1)).alias("k")).collect()]
    old = 1 + max([shards - 1, *(b[0] for b in blocks)])
    supply = [0] * old
    for i, _, n, _ in blocks:
        supply[i] += n
    total = sum(supply)
    if capacity is None:
        capacity = [total // shards + (j < total % shards) for j in range(shards)]
    flows = min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    where = place_blocks([b[:3] for b in blocks], flows, capacity)
    slot = [0] * len(capacity)
    table = []
    for i, b, _, k in sorted(blocks):
        j = where[i, b]
        table.append((i, b, j, slot[j]))
        slot[j] += k
    schema = "__old int, __block int, __new int, __first long"
    placed = spark.createDataFrame(table, schema)
    losing = sorted({i for i, _, j, _ in table if i != j})
    moved = sum(n for i, b, n, _ in blocks if where[i, b] != i)
    folders = [(path, tuple(s for s in keep if s not in losing)) for path, keep in layout.folders]
    if losing:
        path = scratch(spark, "layout")
        # rows of the losing shards alone; the table of blocks is bounded by shards x BLOCKS
        target = rows.where(F.col(_SHARD).isin(*losing)).join(
            F.broadcast(placed.select(F.col("__old").alias(_SHARD), _BLOCK, "__new")), [_SHARD, _BLOCK])
        target.select(*layout.columns.names, _ROW, _BLOCK, _SIZE, "__from", F.col("__new").alias(_SHARD)).write.partitionBy(_SHARD).parquet(path)
        folders.append((path, tuple(range(len(capacity)))))
    return Layout(layout.columns, tuple(folders)), placed, {"total": total, "moved": moved}


def slots(spark, layout: Layout, placed: DataFrame, id_col: str) -> DataFrame:
    """The layout's rows with ``__slot``, gapless from 0 in each shard: numbered inside a block (a bounded
    share of a shard) and shifted by the block's first slot."""
    from pyspark.sql import Window

    rows = layout.read(spark).join(F.broadcast(placed.select(F.col("__old").alias("__from"), _BLOCK, "__first")), ["__from", _BLOCK])
    w = Window.partitionBy("__from", _BLOCK).orderBy(col(id_col), _ROW)
    return rows.withColumn("__slot", F.row_number().over(w) - 1 + F.col("__first"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str = "source", shards: int = SHARDS) -> DataFrame:
    """``docs`` laid out by a hash of ``key_col`` (uneven: a hot key is one shard), resharded to equal bytes, read back."""
    spark = docs.sparkSession
    text = col(text_col)
    narrow = docs.select(col(id_col), text, col(key_col))
    old = F.pmod(F.crc32(F.coalesce(col(key_col).cast("string"), F.lit("")).cast("binary")), F.lit(shards))
    layout, placed, _ = reshard(spark, lay_out(narrow, old, size_of(text), shards), shards)
    digest = Layout(layout.columns, layout.folders)
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")
    rows = _Digested(digest, id_col, crc)
    return slots(spark, rows, placed, id_col).select(
        col(id_col), F.col(_SIZE).alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col(_SHARD).alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


class _Digested:
    """A layout read with the checksum of the text in place of the text, so numbering shuffles narrow rows."""

    def __init__(self, layout: Layout, id_col: str, crc: Column) -> None:
        self.layout, self.id_col, self.crc = layout, id_col, crc

    def read(self, spark) -> DataFrame:
        return self.layout.read(spark).select(col(self.id_col), self.crc.alias("__crc"), _ROW, _BLOCK, _SIZE, "__from", _SHARD)
