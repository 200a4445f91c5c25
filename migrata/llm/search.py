"""Approximate nearest neighbours through learned partitions.

The index is learnt on a bounded hash sample of the vectors (``SAMPLE``): the sample's k-nearest-neighbour
graph is partitioned into ``PARTS`` balanced parts (recursive bisection by the Fiedler vector, refined by
exchanging pairs across the cut), and a small classifier (one hidden layer) learns each vector's part
from its coordinates and from the parts of its neighbours.  Every vector of the table is then indexed
under its most probable part; a query goes to its ``PROBES`` most probable parts, whose vectors are
reranked by the exact Euclidean distance on the original values in double precision.

Scale: assigning parts is a map.  A part is cut into blocks of about ``BLOCK_ROWS`` vectors by row number,
so a hot vector that fills a part is spread over tasks; the queries of a part are cut the same way, and
each (query block, vector block) pair is one group that returns at most k rows per query.  Part counts
(``PARTS`` rows) are all that reaches the driver besides the sample.

Defined results: a query has all its candidates if they are fewer than k in the probed parts, nearest
first, ties to the smaller id; a query never finds rows of its own id; repeated vectors are candidates
each; vectors that are null, all zero, of another length than most, or with null or non-finite components
take no part; an empty table gives an empty table; only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migrata.llm.common import col, small_batches, stored

SAMPLE = 6000
PARTS = 64
PROBES = 48
NEIGHBOURS = 10
HIDDEN = 128
EPOCHS = 12
BLOCK_ROWS = 4096
K = 10


@dataclass(frozen=True)
class Router:
    """The classifier: part probabilities from coordinates."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS, rows: int = 1024) -> np.ndarray:
    """The k nearest other rows of each row."""
    k = min(k, len(x) - 1)
    sq = (x**2).sum(1)
    out = np.empty((len(x), k), dtype=np.int64)
    for a in range(0, len(x), rows):
        d = sq[None] - 2 * x[a:a + rows] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a:a + rows] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, parts: int, steps: int = 60, seed: int = 7) -> np.ndarray:
    """A part for every node, sizes at most one apart per bisection, with few graph edges across parts."""
    n = len(near)
    src = np.repeat(np.arange(n), near.shape[1])
    dst = near.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    part = np.zeros(n, dtype=np.int64)
    rng = np.random.default_rng(seed)
    count = 1
    while count < parts:
        # all parts are bisected at once: edges across parts are left out
        inside = part[src] == part[dst]
        s, d = src[inside], dst[inside]
        degree = np.maximum(np.bincount(s, minlength=n), 1).astype(float)
        size = np.maximum(np.bincount(part, weights=degree, minlength=count), 1)
        v = rng.standard_normal(n)
        for _ in range(steps):
            v = v - (np.bincount(part, weights=v * degree, minlength=count) / size)[part]
            v = 0.5 * v + 0.5 * np.bincount(s, weights=v[d], minlength=n) / degree
            norm = np.sqrt(np.bincount(part, weights=v * v, minlength=count))
            v = v / np.maximum(norm[part], 1e-300)
        order = np.lexsort((np.arange(n), v, part))
        rank = np.empty(n, dtype=np.int64)
        starts = np.searchsorted(part[order], np.arange(count))
        rank[order] = np.arange(n) - starts[part[order]]
        half = (np.bincount(part, minlength=count) + 1) // 2
        new = 2 * part + (rank >= half[part])
        for _ in range(8):  # exchange as many nodes on either side of a cut as gain by it
            mine = np.bincount(s, weights=new[d] == new[s], minlength=n)
            gain = degree - 2 * mine
            want = gain > 0
            moved = new.copy()
            for p in range(count):
                sides = [np.flatnonzero(want & (new == 2 * p + q)) for q in (0, 1)]
                m = min(map(len, sides))
                for q in (0, 1):
                    moved[sides[q][np.argsort(-gain[sides[q]], kind="stable")[:m]]] = 2 * p + 1 - q
            cut = lambda a: np.count_nonzero(a[s] != a[d])
            if cut(moved) >= cut(new):
                break
            new = moved
        part, count = new, 2 * count
    return part


def learn(x: np.ndarray, parts: int = PARTS, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> Router:
    """Partition the neighbour graph of the rows of ``x`` and learn to route to the parts."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(dim)
    spread = float(np.sqrt(((x - mean) ** 2).mean())) if len(x) else 1.0
    scale = 1 / spread if spread > 0 else 1.0
    z = (x - mean) * scale
    if len(x) < 4 * parts:
        parts, target = 1, np.ones((len(x), 1))
    else:
        near = neighbour_graph(x)
        part = balanced_parts(near, parts)
        # soft labels: the parts where a vector and its neighbours lie
        target = np.zeros((len(x), parts))
        np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
        np.add.at(target, (np.arange(len(x)), part), near.shape[1])
        target /= target.sum(1, keepdims=True)
    w = [rng.standard_normal((dim, hidden)) * np.sqrt(2 / dim), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(epochs if parts > 1 else 0):
        rate = 0.01 * (0.5 * (1 + np.cos(np.pi * epoch / epochs))) + 1e-5
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            rows = order[a:a + 256]
            h = np.maximum(z[rows] @ w[0] + w[1], 0)
            logits = h @ w[2] + w[3]
            p = np.exp(logits - logits.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            gh = (g @ w[2].T) * (h > 0)
            grads = [z[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0)]
            t += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, *w)


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part: doubles, finite, not all zero, of the most common length."""
    rows = vectors.select(col(id_col).alias("id"), col(vec_col).cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (size["n"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1)) if len(column) else np.empty((0, 0))


def search(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100,
           k: int = K, sample: int = SAMPLE, parts: int = PARTS, probes: int = PROBES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries: rows of ``queries``, or those whose id ``every`` divides."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = _valid(vectors, id_col, vec_col)
    n = rows.count()
    some = rows if n <= sample else rows.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    x = np.array([r["vec"] for r in some.select("vec").distinct().orderBy("vec").collect()], dtype=np.float64)
    router = learn(x.reshape(len(x), -1) if len(x) else np.empty((0, 1)), parts)
    shipped = spark.sparkContext.broadcast(router)
    parts = len(router.b2)
    probes = min(probes, parts)
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("vec", T.ArrayType(T.DoubleType(), False)),
                           T.StructField("parts", T.ArrayType(T.IntegerType(), False))])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shipped.value
        for batch in batches:
            logits = r.logits(_matrix(batch.column(1))) if batch.num_rows else np.empty((0, parts))
            best = np.argsort(-logits, axis=1, kind="stable")[:, :probes].astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(best) + 1, dtype=np.int32) * probes, pa.array(best.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=schema.names)

    routed = rows.mapInArrow(route, schema).select("id", "vec", "parts", F.col("parts")[0].alias("part"))
    # row numbers are fixed by the write, so blocks may follow them
    index = stored(routed.select("id", "vec", "part", F.monotonically_increasing_id().alias("row"),
                                 *([F.when(F.col("id") % every == 0, F.col("parts")).alias("parts")] if queries is None else [])), "index")
    if queries is None:
        asked = stored(index.where("parts is not null").select("id", "vec", "parts", "row"), "queries")
    else:
        asked = stored(_valid(queries, id_col, vec_col).mapInArrow(route, schema)
                       .select("id", "vec", "parts", F.monotonically_increasing_id().alias("row")), "queries")
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    wanted = asked.select("id", "vec", "row", F.explode("parts").alias("part"))
    asks = {r["part"]: r["count"] for r in wanted.groupBy("part").count().collect()}
    # blocks per part, of vectors and of queries: at most one row per part
    blocks = {p: -(-c // block_rows) for p, c in sizes.items()}
    qblocks = {p: -(-c // block_rows) for p, c in asks.items()}
    table = spark.createDataFrame([(p, blocks[p], qblocks.get(p, 0)) for p in sorted(blocks)] or [(-1, 1, 1)], "part int, blocks int, qblocks int")
    members = (index.join(F.broadcast(table), "part").where("qblocks > 0")
               .select("part", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"),
                       F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)).alias("qblock"), "id", "vec"))
    probing = (wanted.join(F.broadcast(table), "part")
               .select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                       F.pmod(F.xxhash64("row"), "qblocks").cast("int").alias("qblock"), "id", "vec", "row"))
    found = T.StructType([T.StructField("query_id", id_type), T.StructField("qrow", T.LongType()), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])
    types = [index.schema["id"].dataType]

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        names = found.names
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], left.column("id").type), pa.array([], pa.int64()), pa.array([], left.column("id").type), pa.array([], pa.float64())], names=names)
        ids = left.column("id").combine_chunks().to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        ids, vecs = ids[order], _matrix(left.column("vec").combine_chunks())[order]
        qids = right.column("id").combine_chunks().to_numpy(zero_copy_only=False)
        qrows = right.column("row").combine_chunks().to_numpy(zero_copy_only=False)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for qid, qrow, q in zip(qids, qrows, _matrix(right.column("vec").combine_chunks())):
            d = np.sqrt(((vecs - q) ** 2).sum(1))
            d[ids == qid] = np.inf
            m = min(k, len(d))
            kth = np.partition(d, m - 1)[m - 1]
            at = np.flatnonzero(d <= kth)
            at = at[np.argsort(d[at], kind="stable")][:m]  # rows are in id order: ties go to the smaller id
            at = at[np.isfinite(d[at])]
            for column, values in zip(out, (np.full(len(at), qid), np.full(len(at), qrow), ids[at], d[at])):
                column.append(values)
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=names)

    near = members.groupBy("part", "block", "qblock").cogroup(probing.groupBy("part", "block", "qblock")).applyInArrow(rerank, found)
    w = Window.partitionBy("query_id", "qrow").orderBy("score", "vec_id")
    return (near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
