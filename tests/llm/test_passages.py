"""Substring dedup against every window written out."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from migrata.llm import passages

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _words(t):
    return [w for w in SPACE.split(t or "") if w]


def _truth(rows, n):
    first = {}
    for i, t in rows:
        w = _words(t)
        for s in range(len(w) - n + 1) if i is not None else ():
            k = tuple(w[s:s + n])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = _words(t)
        gone = {p for s in range(len(w) - n + 1) if i is not None and first[tuple(w[s:s + n])] < i for p in range(s, s + n)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), " ".join(kept)))
    return out


def _check(spark, rows, n, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, passages.report(df, window=n, **kw).collect()), key=str)
    want = sorted(((i, k, g, hashlib.sha256(t.encode()).hexdigest()) for i, k, g, t in _truth(rows, n)), key=str)
    assert got == want


def _corpus(seed, docs, words):
    rng = random.Random(seed)
    shared = [[f"w{rng.randrange(words)}" for _ in range(rng.randrange(8, 40))] for _ in range(4)]
    rows = []
    for i in range(docs):
        w = [f"w{rng.randrange(words)}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(docs + 1, rows[0][1]), (docs + 2, rows[1][1].replace(" ", "  ")), (docs + 3, None), (docs + 4, ""), (docs + 5, " \n ")]
    return rows


def test_passages_against_every_window(spark):
    for seed, words in ((1, 400), (2, 6)):
        _check(spark, _corpus(seed, 40, words), 10, gram=5, width=1 << 16)


def test_full_sketch_loses_nothing(spark):
    # one block of cells for all grams: every window goes on to the exact grouping
    _check(spark, _corpus(3, 40, 300), 8, gram=4, width=1 << 16, depth=1)
    rows = _corpus(4, 30, 5)
    _check(spark, rows, 6, gram=6, width=1 << 16)


def test_default_window_and_ids(spark):
    text = " ".join(f"a{i}" for i in range(120))
    rows = [(5, text), (3, "x y " + text[:400] + " z"), (3, "other " + text), (5, text), (None, text), (9, " ".join(text.split()[:50])), (10, " ".join(text.split()[:49]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, passages.report(df, width=1 << 16).collect()), key=str)
    want = sorted(((i, k, g, hashlib.sha256(t.encode()).hexdigest()) for i, k, g, t in _truth(rows, 50)), key=str)
    assert got == want
    kept = {(r["doc_id"], r["text"]) for r in passages.dedupe(df, width=1 << 16).collect()}
    assert (None, text) in kept and (3, "other " + text) in kept and (9, "") in kept and (10, rows[-1][1]) in kept


def test_odd_rows_and_names(spark, odd, empty):
    kept = passages.dedupe(odd, width=1 << 16)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    want = defaultdict(list)
    for i, n, gone, text in _truth(rows, 50):
        want[i].append((n, gone, hashlib.sha256(text.encode()).hexdigest()))
    got = defaultdict(list)
    for r in passages.report(odd, width=1 << 16).collect():
        got[r["doc_id"]].append((r["n_words"], r["n_removed"], r["kept_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert passages.report(empty, width=1 << 16).count() == 0 and passages.dedupe(empty, width=1 << 16).columns == empty.columns


def test_cells_count_once_or_more(spark):
    text = " ".join(f"q{i}" for i in range(30))
    other = " ".join(f"r{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (2, text), (3, other)], "doc_id long, text string").repartition(3, "doc_id")
    bits = np.zeros(2 * (1 << 16) // 8, np.uint8)
    for r in passages.sketch(df, window=10, gram=5, width=1 << 16).collect():
        bits[r["block"] * 8192:(r["block"] + 1) * 8192] = np.frombuffer(r["twice"], np.uint8)
    on = {int(x) for x in np.flatnonzero(np.unpackbits(bits, bitorder="little"))}
    t, o = (passages.Texts(pa.array([x]), passages._Hashes(1), 10, 5) for x in (text, other))
    assert {int(c) for row in passages.cells(t.least, 2, 1 << 16) for c in row} <= on
    assert len(on) <= 2 * len(set(t.least.tolist())) + 2


def test_rolling_and_sliding():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for n in (1, 2, 5, 25, 50):
        want = [sum(int(v) * pow(int(passages._R1), n - 1 - k, 1 << 64) for k, v in enumerate(x[i:i + n])) % (1 << 64) for i in range(200 - n + 1)]
        assert passages.rolling(x, n, passages._R1).tolist() == want
        assert passages.sliding_min(x, n).tolist() == [min(x[i:i + n].tolist()) for i in range(200 - n + 1)]


def test_words_of_a_batch():
    texts = ["one two", None, "", "  three\u00a0x\n", "four", "é\tü " + "z" * 300 + " q", " "]
    whole = pa.array([None, "cut off", *texts, "rest"])
    got = passages.Texts(whole.slice(2, len(texts)), passages._Hashes(1), 2, 1)
    want = [w.encode() for t in texts for w in _words(t)]
    assert [got.data[a:b].tobytes() for a, b in zip(got.begin, got.end)] == want
    assert np.diff(got.starts).tolist() == [len(_words(t)) for t in texts]
    h = passages._Hashes(1)
    one = {w: int(h.of(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in want}
    assert got.hashed.tolist() == [one[w] for w in want] and len(set(one.values())) == len(set(want))
    assert one[b"z" * 300] == xxhash.xxh3_64_intdigest(b"z" * 300, 1)
