"""Filter interaction audit: what every order of a set of document filters removes, and for whom.

Five filters judge whole texts (null: empty; words are what white space, blank or tab to carriage return,
separates).  A text fails A with under ``LEAST_WORDS`` words; B if distinct words are under half of the
words; C if A-Z are over ``MOST_CAPITALS`` percent of its code points; D if it holds one of ``#$%&*|``;
E if it equals the text of any document with a smaller id, in the whole table, whatever becomes of that one.

1. Every row becomes a narrow verdict (part, id, failed filters as bits, good, toxic).  E comes from the
   smallest id per SHA-256 of the text, ``good`` and ``toxic`` from ``labels`` (any label row of the id).
2. Verdicts are sorted by (part, id) over range partitions.  Each run of at most ``RANGE`` documents of a
   part is an id range; in it a document is its place, and each filter keeps the sorted posting list of the
   places that fail it.
3. What filter f removes after the filters S is the difference of f's list and the lists of S, whichever
   order S had: 80 pairs (S, f) stand for the 600 steps.  Lists are merged by galloping: cursors leap over
   what other lists do not hold, block by block (``minus``).  Sizes, and sizes of the common places with the
   good and toxic lists, add up over ranges.
4. The 120 orders are an equi-join of the summed pairs with the 600 (order, step) rows.

Scale: texts are read once and never shuffled; the shuffles carry digests and verdicts of some 30 bytes.  A
hot text collapses map-side and the join back is split by AQE; a hot part or a hot id spreads over range
partitions and ranges; a task holds one range.  The driver sees nothing but the fixed order table.

Defined results: documents are rows, so rows that repeat an id count each (equal ids are not smaller: they do
not fail E against each other); a null id fails no E and makes none fail, and has no labels; a null part is
the part ''; labels that are null say nothing; an empty table has no parts and gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migrata.llm.common import col, map_texts, small_batches, stored

FILTERS = "ABCDE"
LEAST_WORDS = 200
MOST_CAPITALS = 3
RANGE = 1 << 16
BLOCK = 1 << 12
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = b"#$%&*|"
_PAIRS = [(s, f) for f in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s >> f & 1]
_COUNTS = ("docs", "gone", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failed(text: str | None) -> int:
    """The filters A to D that one text fails, as bits."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    # bytes.split() separates at the six ASCII white-space characters alone
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return ((len(words) < LEAST_WORDS) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * capitals > MOST_CAPITALS * len(text)) << 2 | (len(raw) > len(raw.translate(None, _SIGNS))) << 3)


def _gallop(places: np.ndarray, at: int, bound: int) -> int:
    """The first index from ``at`` on whose place is above ``bound``: doubling leaps, then a binary search."""
    step, n = 1, len(places)
    while at + step < n and places[at + step] <= bound:
        step *= 2
    lo = at + step // 2 if step > 1 else at
    return lo + int(np.searchsorted(places[lo:min(at + step + 1, n)], bound, side="right"))


def minus(places: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The places of one sorted list that none of the other sorted lists holds, by a galloping k-way merge."""
    cursors = [0] * len(others)
    out = []
    for a in range(0, len(places), BLOCK):
        block = places[a:a + BLOCK]
        keep = np.ones(len(block), bool)
        for k, other in enumerate(others):
            start = _gallop(other, cursors[k], int(block[0]) - 1)
            cursors[k] = end = _gallop(other, start, int(block[-1]))
            if end > start:
                hits = other[start:end]
                found = np.minimum(np.searchsorted(hits, block), len(hits) - 1)
                keep &= hits[found] != block
        out.append(block[keep])
    return np.concatenate(out) if out else places


def tally(bits: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[tuple[int, ...]]:
    """Of the documents of one id range: (filters before, filter, *``_COUNTS``) for each of the 80 pairs."""
    lists = [np.flatnonzero(bits >> f & 1) for f in range(len(FILTERS))]
    no_good, no_toxic = np.flatnonzero(~good), np.flatnonzero(~toxic)
    new = {(s, f): minus(lists[f], [lists[g] for g in range(len(FILTERS)) if s >> g & 1]) for s, f in _PAIRS}
    union = {0: 0}
    for s in range(1, 1 << len(FILTERS)):
        top = s.bit_length() - 1
        union[s] = union[s ^ 1 << top] + len(new[s ^ 1 << top, top])
    every = (1 << len(FILTERS)) - 1
    return [(s, f, len(bits), union[s | 1 << f], len(new[s, f]), len(lists[f]) - len(new[s, f]), len(new[every ^ 1 << f, f]),
             len(minus(new[s, f], [no_good])), len(minus(new[s, f], [no_toxic]))) for s, f in _PAIRS]


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, id, spread, bits, good, toxic) of every document; ``spread`` tells rows of one id apart by their texts."""
    text = F.coalesce(col(text_col), F.lit(""))
    narrow = stored(map_texts(
        docs, [F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest")],
        [text.alias("text")], [T.StructField("bits", T.IntegerType())], lambda: lambda texts: ([failed(t) for t in texts],)), "verdicts")
    first = narrow.groupBy("digest").agg(F.min("id").alias("first"))
    marks = labels.select(col("doc_id").alias("label_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")
                          ).groupBy("label_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    copy = F.when(F.col("id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    joined = narrow.join(first, "digest").join(marks, F.col("id") == F.col("label_id"), "left")
    return joined.select("part", "id", F.xxhash64("digest").alias("spread"), F.col("bits").bitwiseOR(copy).alias("bits"),
                         F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def pair_counts(judged: DataFrame) -> DataFrame:
    """(part, before, filter, *``_COUNTS``): the 80 pairs of every part, summed over its id ranges."""
    small_batches(judged.sparkSession)
    rows = judged.repartitionByRange("part", "id", "spread").sortWithinPartitions("part", "id", "spread").select("part", "bits", "good", "toxic")
    fields = [("part", "string"), ("before", "int"), ("filter", "int"), *((c, "long") for c in _COUNTS)]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(n, types[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = None, [], 0

        def emit() -> pa.RecordBatch:
            lists = [np.concatenate(x) for x in zip(*held)]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (part, *row))) for row in tally(*lists)], schema)

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            code = np.asarray(parts.indices)
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            cols = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (1, 2, 3)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                name = parts.dictionary[int(code[a])].as_py()
                if n and (name != part or n + b - a > RANGE):
                    yield emit()
                    held, n = [], 0
                part = name
                held.append([c[a:b] for c in cols])
                n += b - a
        if n:
            yield emit()

    counted = rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))
    return counted.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _steps(like: DataFrame) -> DataFrame:
    """(filter_order, step, filter, before): the 600 steps of all orders."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(FILTERS[x] for x in order), step, f, before))
            before |= 1 << f
    return like.sparkSession.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, order and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` and ``shapley``."""
    pairs = stored(pair_counts(verdicts(docs, labels, id_col, text_col, part_col)), "pairs")
    steps = _steps(docs)
    # how many of the orders have exactly the filters ``before`` ahead of the filter
    weight = steps.groupBy("before", "filter").agg(F.count(F.lit(1)).alias("orders"))
    shapley = (pairs.join(F.broadcast(weight), ["before", "filter"]).groupBy(F.col("part").alias("p"), F.col("filter").alias("f"))
               .agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley")))
    out = pairs.join(F.broadcast(steps), ["before", "filter"]).join(shapley, (F.col("part") == F.col("p")) & (F.col("filter") == F.col("f")))
    kept: Column = F.col("docs") - F.col("gone")
    return out.select("part", "filter_order", "step", kept.alias("kept"), "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


# fail flags in DuckDB's words: the same rows from 32 classes of documents per part
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > 3 * length(words.t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(words.t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN words.doc_id > first THEN 16 ELSE 0 END AS bits,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words JOIN firsts ON words.t = firsts.t LEFT JOIN marks ON words.doc_id = marks.doc_id),
classes AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, bits),
letters AS (SELECT unnest([0, 1, 2, 3, 4]) AS f, unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS o
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, CAST(o[step] AS INTEGER) AS own, CAST(list_sum(o[1:step]) - o[step] AS INTEGER) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN bits & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bits & own <> 0 AND bits & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bits = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM classes, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
