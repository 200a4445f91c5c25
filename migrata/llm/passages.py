"""Substring dedup: repeated passages are found through a count-min prefilter and exact grouping.

Words are what white space (blank, tab to carriage return) separates, unchanged.  A window is ``WINDOW``
consecutive words of one document.  A word goes if a window that covers it also starts, word by word the
same, in a document with a smaller id.  Windows are judged on the input.

1. Sketch: a window is represented by its least ``GRAM``-word gram (the least hash; equal windows have the
   same one, and a gram represents a dozen neighbouring windows).  Every partition counts the grams of its
   documents in ``DEPTH`` rows of ``WIDTH`` cells; the partial sketches are dealt by blocks of cells and added
   up.  A cell never shows less than any of its grams, and a gram never less than any of its windows: counts
   are over-, never underestimated.  What leaves the merge is one bit a cell: counted twice or more.
2. Second pass: windows whose gram is estimated repeated are grouped exactly, by 96 bits of two independent hashes
   of their words, with the smallest document id of each group.  Windows whose id is larger are joined back to it.
3. Those windows collect per document; only the texts of documents that lose words are shuffled, and cut.

A window that occurs in two documents has a gram that was counted in both, so no repeated window is put aside, however
full the sketch is: a fuller sketch only lets more windows through to the exact grouping.

Scale: the broadcast is ``DEPTH`` * ``WIDTH`` bits (32 MB as set), whatever the input; a task holds one block of cells when
merging, and its own grams when counting.  Hot windows and hot documents' ids collapse map-side (a minimum); the join
back is split by AQE.  The bit table before the last join has a fixed number of rows as well.

Defined results: null and empty texts have no words and stay; documents are rows: rows that repeat id and text
get the same decisions, and equal ids are not smaller than each other; a null id is smaller than none
and has none smaller: its words stay; an empty table gives an empty table; other columns, whatever their names, stay
(``dedupe``) or are not read (``report``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from migrata.llm.common import _slices, col, fresh, map_texts, small_batches, stored

WINDOW = 50
GRAM = 25
DEPTH = 2
WIDTH = 1 << 27
BLOCK = 1 << 16
FILTER_WORDS = 1 << 20
SLICE = 1 << 20
LONG = 256
# cells a task holds before it emits a partial sketch
HELD = 1 << 22
_R1, _R2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WHITE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


class _Hashes:
    """64-bit hashes of words: a polynomial over random values of their bytes, taken from prefix sums over all the bytes at once.

    Words of ``LONG`` bytes and more, where such a polynomial can be tricked, get XXH3 instead."""

    def __init__(self, seed: int):
        random = np.random.default_rng(seed)
        self.seed, self.table = seed, random.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(random.integers(0, 1 << 63)) * 2 + 1
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            self.up, self.down = (np.full(size, x, np.uint64) for x in (self.base, pow(self.base, -1, 1 << 64)))
            for x in (self.up, self.down):
                x[0] = 1
                np.multiply.accumulate(x, out=x)

    def of(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each ``data[begin:end]``."""
        with np.errstate(over="ignore"):
            self._powers(len(data))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.table[data] * self.up[:len(data)], out=sums[1:])
            out = _mixed((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))
        for k in np.flatnonzero(end - begin >= LONG):
            out[k] = xxh3_64_intdigest(data[begin[k]:end[k]].tobytes(), self.seed)
        return out


def rolling(words: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """The hash of every ``n`` consecutive word hashes (polynomial modulo 2^64), by doubling."""
    out, have, rest, run, size = None, 0, n, words, 1
    power = int(base)
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                out, have = (run, size) if out is None else (_glue(out, run, have, size, base), have + size)
            rest >>= 1
            if rest:
                run = run[:len(run) - size] * np.uint64(power) + run[size:]
                power, size = power * power % (1 << 64), 2 * size
    return out


def _glue(left: np.ndarray, right: np.ndarray, n: int, m: int, base: np.uint64) -> np.ndarray:
    count = len(right) - n
    return left[:count] * np.uint64(pow(int(base), m, 1 << 64)) + right[n:n + count]


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` consecutive values, by doubling."""
    run, size = values, 1
    while 2 * size <= n:
        run, size = np.minimum(run[:len(run) - size], run[size:]), 2 * size
    return np.minimum(run[:len(run) - (n - size)], run[n - size:]) if n > size else run


def _mixed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for m in _MIX:
            values = (values ^ (values >> np.uint64(32))) * np.uint64(m)
    return values ^ (values >> np.uint64(32))


class Texts:
    """The words of some documents in a row, and their windows."""

    def __init__(self, texts: pa.Array, hashes: _Hashes, window: int, gram: int):
        raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
        _, offsets, values = raw.buffers()
        cuts = np.frombuffer(offsets, np.int64)[raw.offset:raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        self.data = np.frombuffer(values, np.uint8)[cuts[0]:cuts[-1]] if values is not None else np.zeros(0, np.uint8)
        cuts = cuts - cuts[0]
        black = np.zeros(len(self.data) + 2, bool)
        black[1:-1] = ~_WHITE[self.data]
        # a word begins or ends where white meets black, and where a document does
        edge = np.zeros(len(self.data) + 1, bool)
        edge[cuts] = True
        self.begin = np.flatnonzero(black[1:] & (edge | ~black[:-1]))
        self.end = np.flatnonzero(black[:-1] & (edge | ~black[1:]))
        doc = np.searchsorted(cuts, self.begin, side="right") - 1
        self.starts = np.searchsorted(doc, np.arange(len(raw) + 1))
        n = len(doc)
        self.place = np.zeros(0, np.int64)
        if n < window:
            return
        self.hashed = hashes.of(self.data, self.begin, self.end)
        # grams by mixed hash: the least one is an arbitrary one, not that of a common word
        least = sliding_min(_mixed(rolling(self.hashed, gram, _R1)), window - gram + 1)
        self.place = np.flatnonzero(doc[:n - window + 1] == doc[window - 1:])
        self.doc = doc[self.place]
        self.least = least[self.place]
        # a gram stays the least one for neighbouring windows
        self.new = np.ones(len(self.place), bool)
        self.new[1:] = (self.least[1:] != self.least[:-1]) | (self.doc[1:] != self.doc[:-1])

    def windows(self, at: np.ndarray, hashes: _Hashes, window: int, base: np.uint64, hashed: np.ndarray | None = None) -> np.ndarray:
        """The hash of the windows ``at`` (in increasing order), hashing only the documents they are in."""
        docs = np.unique(self.doc[at])
        spans = [np.arange(self.starts[d], self.starts[d + 1]) for d in docs]
        words = np.concatenate(spans)
        values = hashes.of(self.data, self.begin[words], self.end[words]) if hashed is None else hashed[words]
        return _mixed(rolling(values, window, base)[np.searchsorted(words, self.place[at])])


def cells(grams: np.ndarray, depth: int, width: int) -> list[np.ndarray]:
    """Per row of the sketch the cells of the grams (counted over all rows)."""
    low, high = grams & np.uint64(0xFFFFFFFF), grams >> np.uint64(32)
    with np.errstate(over="ignore"):
        return [((low + np.uint64(r) * (high | np.uint64(1))) * _R1 >> np.uint64(16)) % np.uint64(width) + np.uint64(r * width) for r in range(depth)]


def sketch(docs: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(block, twice): the merged sketch, a bit for each of the ``BLOCK`` cells of a block; blocks without a bit are left out."""
    small_batches(docs.sparkSession)
    partial = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, found, held = _Hashes(1), [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            """The cells counted so far, per block: once (or more), and twice or more."""
            cell, n = np.unique(np.concatenate(found), return_counts=True)
            block, low = cell // np.uint64(BLOCK), (cell % np.uint64(BLOCK)).astype("<u2")
            cuts = np.flatnonzero(np.diff(block)) + 1
            rows = [{"block": int(b[0]), "once": x[k == 1].tobytes(), "more": x[k > 1].tobytes()}
                    for b, x, k in zip(np.split(block, cuts), np.split(low, cuts), np.split(n, cuts))]
            for a in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[a:a + 1000], partial)

        for batch in batches:
            for part in _slices(batch, [0], SLICE):
                texts = Texts(part.column(0), hashes, window, gram)
                if len(texts.place):
                    new = cells(texts.least[texts.new], depth, width)
                    found += new
                    held += sum(map(len, new))
                if held > HELD:
                    yield from emit()
                    found, held = [], 0
        if found:
            yield from emit()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, np.zeros(BLOCK, np.uint8)
        schema = pa.schema([("block", pa.int32()), ("twice", pa.binary())])
        def emit():
            return pa.RecordBatch.from_pylist([{"block": now, "twice": np.packbits(counts >= 2, bitorder="little").tobytes()}], schema)
        for batch in batches:
            for block, once, more in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != now:
                    if now is not None and (counts >= 2).any():
                        yield emit()
                    now = block
                    counts[:] = 0
                x = np.frombuffer(once, "<u2")
                counts[x] = np.minimum(counts[x] + 1, 2)
                counts[np.frombuffer(more, "<u2")] = 2
        if now is not None and (counts >= 2).any():
            yield emit()

    counted = docs.select(col(text_col)).mapInArrow(count, "block int, once binary, more binary")
    return counted.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, twice binary")


def _candidates(docs: DataFrame, id_col: str, text_col: str, twice, window: int, gram: int, depth: int, width: int) -> DataFrame:
    """(k1, k2, id, place): the windows estimated repeated; ``place`` holds the start and 31 bits of the text's hash."""
    small_batches(docs.sparkSession)
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    rows = docs.where(col(id_col).isNotNull()).select(
        col(id_col).alias("id"), F.xxhash64(col(text_col)).bitwiseAND(F.lit(0x7FFFFFFF)).alias("copy"), col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _Hashes(1), _Hashes(2)
        bits = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            for part in _slices(batch, [2], SLICE):
                texts = Texts(part.column(2), first, window, gram)
                if not len(texts.place):
                    continue
                likely = np.ones(int(texts.new.sum()), bool)
                for cell in cells(texts.least[texts.new], depth, width):
                    likely &= (bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                at = np.flatnonzero(likely[np.cumsum(texts.new) - 1])
                if not len(at):
                    continue
                start, doc = texts.place[at], texts.doc[at]
                k1 = texts.windows(at, first, window, _R2, texts.hashed).view(np.int64)
                k2 = (texts.windows(at, second, window, _R1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                copy = np.asarray(part.column(1))
                place = (start - texts.starts[doc]) << 31 | copy[doc]
                ids = part.column(0).take(pa.array(doc))
                whole = pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), ids, pa.array(place)], names=["k1", "k2", "id", "place"])
                for a in range(0, len(at), 50_000):
                    yield whole.slice(a, 50_000)

    return rows.mapInArrow(run, f"k1 long, k2 int, id {kind}, place long")


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(id, copy, starts): per document that loses words, where the windows start that go (``copy``: 31 bits of its text's hash)."""
    spark = docs.sparkSession
    twice = np.zeros(depth * width // 8, np.uint8)
    # bounded: the bits of the whole sketch, depth * width / 8 bytes
    for r in sketch(docs, text_col, window, gram, depth, width).collect():
        twice[r["block"] * (BLOCK // 8):(r["block"] + 1) * (BLOCK // 8)] = np.frombuffer(r["twice"], np.uint8)
    found = _candidates(docs, id_col, text_col, spark.sparkContext.broadcast(twice.tobytes()), window, gram, depth, width)
    # dealt by one more key than the groups were, so that both sides of the join come from exchanges of its own, which AQE splits
    deal = F.xxhash64("k1", "k2").alias("deal")
    least = found.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("k1", "k2", deal, "least")
    later = found.select("*", deal).join(least, ["deal", "k1", "k2"]).where("id > least")
    mine = later.groupBy("id", F.col("place").bitwiseAND(F.lit(0x7FFFFFFF)).alias("copy")).agg(
        F.collect_list(F.shiftright("place", 31).cast("int")).alias("starts"))
    return stored(mine, "repeats")


def _near(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Those of ``rows`` that a bit table of fixed size over the ids in ``found`` lets through (all that join, and few others)."""
    h = F.xxhash64("id")
    word, bit = F.shiftright(h, 6).bitwiseAND(F.lit(FILTER_WORDS - 1)), F.expr("shiftleft(1L, CAST(xxhash64(id) & 63 AS INT))")
    bits = found.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("bits"))
    own = F.xxhash64(col(key))
    return rows.join(F.broadcast(bits), F.shiftright(own, 6).bitwiseAND(F.lit(FILTER_WORDS - 1)) == F.col("w")).where(
        F.col("bits").bitwiseAND(F.expr(f"shiftleft(1L, CAST(xxhash64(`{key}`) & 63 AS INT))")) != 0).drop("w", "bits")


def cut(text: str | None, starts: list[int] | None, window: int = WINDOW) -> tuple[list[bytes], int]:
    """The words that stay once the windows at ``starts`` are gone, and how many went."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not starts:
        return words, 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.asarray(starts))
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    gone = np.cumsum(edges[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **kw) -> DataFrame:
    """``docs`` with the words of repeated passages taken out; a text that loses words is joined by blanks, others stay as they are."""
    names = [fresh(docs, f"__{x}") for x in ("id", "copy", "starts")]
    found = marks(docs, id_col, text_col, window, **kw).toDF(*names)
    here = F.xxhash64(col(text_col)).bitwiseAND(F.lit(0x7FFFFFFF))
    joined = docs.join(found, (col(id_col) == col(names[0])) & (here == col(names[1])), "left")
    at = docs.columns.index(text_col)

    def make():
        return lambda texts, starts: ([t if not s else b" ".join(cut(t, s, window)[0]).decode("utf-8", "surrogatepass") for t, s in zip(texts, starts)],)

    keep = [col(c) for c in docs.columns if c != text_col]
    out = map_texts(joined, keep, [col(text_col), col(names[2])], [T.StructField(text_col, T.StringType())], make)
    order = [c for c in docs.columns if c != text_col]
    order.insert(at, text_col)
    return out.select(*[col(c) for c in order])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **kw) -> DataFrame:
    """Per document ``n_words``, ``n_removed`` and ``kept_sha256``, of the words that stay joined by one blank."""
    small_batches(docs.sparkSession)
    found = marks(docs, id_col, text_col, window, **kw)
    copy = F.xxhash64(col(text_col)).bitwiseAND(F.lit(0x7FFFFFFF)).alias("copy")
    long, text = T.LongType(), T.StringType()

    def whole():
        def f(texts):
            words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
            return [len(w) for w in words], [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
        return f

    def less():
        def f(texts, starts):
            kept = [cut(t, s, window) for t, s in zip(texts, starts)]
            return [n for _, n in kept], [hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in kept]
        return f

    every = map_texts(docs, [col(id_col).alias("id"), copy], [col(text_col)], [T.StructField("n_words", long), T.StructField("whole", text)], whole)
    texts = _near(docs.select(col(id_col).alias("doc"), copy, col(text_col).alias("text")), found, "doc").withColumnRenamed("copy", "c")
    hit = texts.join(found, (F.col("doc") == F.col("id")) & (F.col("c") == F.col("copy")))
    # rows that repeat id and text are cut alike: one of them is enough
    changed = map_texts(hit, [F.col("id").alias("i"), F.col("copy").alias("c")], [F.col("text"), F.col("starts")],
                        [T.StructField("n_removed", long), T.StructField("left", text)], less).dropDuplicates(["i", "c"])
    out = every.join(changed, (F.col("id") == F.col("i")) & (F.col("copy") == F.col("c")), "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                      F.coalesce("left", "whole").alias("kept_sha256"))


# every window as text, in DuckDB's words
ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, s + o AS at FROM windows JOIN firsts USING (k), (SELECT unnest(range(0, 50)) AS o) WHERE doc_id > least),
placed AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM placed WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = placed.doc_id AND gone.at = placed.p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
