"""SimHash near-duplicates through a segment-popcount embedding and a grid range join.

Fingerprint: A-Z lower-cased, words are what white space (blank, tab to carriage return) separates, each run
of ``SHINGLE`` words (repeats included, joined by one blank; the whole sequence of fewer words) is hashed
with XXH64, seed 42; a bit is 1 if it is set in over half the hashes.  No words: fingerprint zero.

Links: fingerprints that differ in at most ``max_bits`` bits.  Every distinct fingerprint is embedded as
the bit counts of its 32 two-bit segments.  One differing bit changes one count by one, so the Manhattan
distance of two embeddings never exceeds the differing bits: a range join with Manhattan radius
``max_bits`` loses no link.  The join runs on a grid: the segments are cut into ``max_bits`` + 3 groups, so
two embeddings within the radius agree on all the counts of three groups at least, and meet in the grid cell
of the first three groups they agree on.  Each fingerprint is published in the cell of every three groups
(35 cells for 4 bits); inside a cell the Manhattan bound is tested first, then the differing bits
themselves, and a pair is reported by its first common cell alone.  All of it is one equi-join; what leaves
it are links, each once.

Classes are connected components of the links; a class carries its smallest document id.

Scale: fingerprints are a map over the texts, stored with the ids; equal fingerprints collapse by a
map-side combined minimum before the join, so groups of copies cost one row; cells are hashed by their
counts, by a merge join whatever their size (a broadcast would hold every cell in the driver); the labels come back by equi-joins on the fingerprint whose hot keys AQE splits.

Defined results: null and empty texts have fingerprint zero and are linked like any other; rows that repeat
an id keep a row each; a null id never is a class id unless the class has no other; an empty table gives an
empty table; other columns are not read (``near_duplicates``) or kept (``keep_one``).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from migrata.llm.common import col, fresh, map_texts, stored
from migrata.llm.graph import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = 32
CHUNK = 1 << 16
LOW = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one whole text, unsigned."""
    # bytes.lower() and bytes.split() know A-Z and the six ASCII white-space characters alone
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    n = max(len(words) - shingle + 1, 1)
    starts = (ends - sizes)[:n].tolist()
    stops = (ends - 1)[min(shingle, len(words)) - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for a in range(0, n, CHUNK):
        h = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[a:a + CHUNK], stops[a:a + CHUNK])),
                        dtype="<u8", count=min(CHUNK, n - a))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, keep: list[Column], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The ``keep`` columns and ``fp``, the fingerprint as a signed long."""
    def make():
        return lambda texts: ([_signed(fingerprint(t, shingle)) for t in texts],)

    return map_texts(docs, keep, [col(text_col)], [T.StructField("fp", T.LongType())], make)


def embedded(fp: Column) -> Column:
    """Bit counts of the two-bit segments, packed two bits each (both bits set: 10, one: 01)."""
    other = F.shiftrightunsigned(fp, 1)
    both, one = fp.bitwiseAND(other).bitwiseAND(F.lit(LOW)), fp.bitwiseXOR(other).bitwiseAND(F.lit(LOW))
    return F.shiftleft(both, 1).bitwiseOR(one)


def manhattan(p: Column, q: Column) -> Column:
    """Manhattan distance of two packed embeddings: fields differ by 1 (bits 01 or 11 of the exclusive or) or 2 (10)."""
    x = p.bitwiseXOR(q)
    low, high = x.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def group_masks(max_bits: int) -> list[int]:
    """Masks over the packed embedding of ``max_bits`` + 3 groups of neighbouring segments, sizes at most one apart."""
    n = max_bits + 3
    at = [SEGMENTS * i // n for i in range(n + 1)]
    return [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(at, at[1:])]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b, for every two of the distinct fingerprints ``fp`` that differ in at most ``max_bits`` bits."""
    masks = group_masks(max_bits)
    point = embedded(F.col("fp"))
    cells = []
    for three in combinations(range(len(masks)), 3):
        mask = masks[three[0]] | masks[three[1]] | masks[three[2]]
        cells.append(F.struct(F.lit(sum(1 << g for g in three)).alias("groups"), F.col("point").bitwiseAND(F.lit(_signed(mask))).alias("cell")))
    grid = (distinct.select("fp", point.alias("point")).select("fp", F.explode(F.array(*cells)).alias("c"))
            .select("fp", "c.groups", "c.cell"))
    left = grid.select("groups", "cell", F.col("fp").alias("a"))
    right = grid.select(F.col("groups").alias("groups_b"), F.col("cell").alias("cell_b"), F.col("fp").alias("b"))
    p, q = embedded(F.col("a")), embedded(F.col("b"))
    differ = p.bitwiseXOR(q)
    agree = F.lit(0)
    for g, mask in enumerate(masks):
        agree = agree + F.when(differ.bitwiseAND(F.lit(_signed(mask))) == 0, F.lit(1 << g)).otherwise(F.lit(0))
    # the first common cell: up to its last group, the pair agrees on its three groups alone
    upto = F.col("groups")
    for shift in (1, 2, 4, 8):
        upto = upto.bitwiseOR(F.shiftright(upto, shift))
    # Spark sizes what is exploded by its rows before: never broadcast
    return left.hint("merge").join(
        right.hint("merge"),
        (F.col("groups") == F.col("groups_b")) & (F.col("cell") == F.col("cell_b")) & (F.col("a") < F.col("b"))
        & (manhattan(p, q) <= max_bits) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        & (agree.bitwiseAND(upto) == F.col("groups")),
    ).select("a", "b")


def classes(prints: DataFrame, id_name: str, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint of ``prints`` (``id_name``, ``fp``)."""
    distinct = prints.groupBy("fp").agg(F.min(id_name).alias("first"))
    linked = components(links(distinct, max_bits))
    rooted = (distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    label = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.select("fp", "root").join(label, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """Every document's id, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable over links)."""
    prints = stored(fingerprints(docs, [col(id_col).alias("id")], text_col, shingle), "fingerprints")
    return prints.join(classes(prints, "id", max_bits), "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id (among rows of that id, the
    smallest row hash; of rows alike in every column, one).  Texts are shuffled once, by that key."""
    h, k = fresh(docs, "__row"), fresh(docs, "__id")
    rows = docs.withColumn(h, F.xxhash64(*[col(c) for c in docs.columns])).withColumn(k, col(id_col))
    prints = stored(fingerprints(rows, [col(k).alias("id"), col(h).alias("row")], text_col, shingle), "fingerprints")
    labelled = prints.join(classes(prints, "id", max_bits), "fp").groupBy("component_id", "fp", "id", "row").agg(F.count(F.lit(1)).alias("n"))
    best = labelled.groupBy(F.col("component_id").alias("c")).agg(F.min(F.struct("id", "row")).alias("best"))
    chosen = labelled.join(best, F.col("component_id").eqNullSafe(F.col("c"))).select(
        "id", "row", "n", F.col("best").eqNullSafe(F.struct("id", "row")).alias("stays"))
    names = [fresh(rows, f"__{x}") for x in ("lid", "lrow", "n", "stays")]
    marked = stored(chosen.where("not stays or n > 1").toDF(*names), "marked")
    lid, lrow, _, stays = map(col, names)
    out = rows.join(marked, col(k).eqNullSafe(lid) & (col(h) == lrow), "left")
    kept = out.where(stays.isNull()).select(*[col(c) for c in docs.columns])
    if marked.where(stays).isEmpty():
        return kept
    repeated = out.where(stays).dropDuplicates([k, h]).select(*[col(c) for c in docs.columns])
    return kept.unionByName(repeated)
