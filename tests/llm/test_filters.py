"""Filter interaction audit against applying every order row by row."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np

from migrata.llm import filters

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _failed(t):
    w = [x for x in SPACE.split(t) if x]
    return "".join(f for f, bad in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search("[#$%&*|]", t))) if bad)


def _truth(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    rows = [(lang or "", i, _failed(t or "") + ("E" if i is not None and first[t or ""] < i else "")) for i, t, lang in docs]
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = defaultdict(int)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                total[f] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), sum(f in r[2] for r in mine) - len(gone), sum(r[2] == f for r in mine),
                                                   sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone))
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step] += (total[f],)
    return out


def _got(docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"])
            for r in filters.report(docs, labels).collect()}


def test_minus_is_a_set_difference():
    rng = np.random.default_rng(4)
    for top in (10, 300, 40_000):
        a, *others = (np.unique(rng.integers(0, top, rng.integers(0, top))) for _ in range(4))
        assert filters.minus(a, others).tolist() == sorted(set(a.tolist()).difference(*(o.tolist() for o in others)))
        assert filters.minus(a, []).tolist() == a.tolist()


def test_ranges_add_up():
    rng = np.random.default_rng(5)
    bits, good, toxic = rng.integers(0, 32, 5000), rng.random(5000) < 0.3, rng.random(5000) < 0.1
    whole = np.array(filters.tally(bits, good, toxic))
    halves = np.array(filters.tally(bits[:1700], good[:1700], toxic[:1700])) + np.array(filters.tally(bits[1700:], good[1700:], toxic[1700:]))
    assert (whole[:, 2:] == halves[:, 2:]).all()


def test_report_against_every_order(spark):
    long = " ".join(f"word{i}" for i in range(250))
    docs = [(1, long, "en"), (2, long, "de"), (3, long + " #", "en"), (4, "A B", None), (5, None, None), (6, "", "en"), (7, "x " * 300, "en"), (8, "x " * 300, "en"),
            (8, "x " * 300, "en"), (None, long, "en"), (None, long, "en"), (9, "ÀÉ" * 90 + "AAA ", "fr"), (10, long.upper(), "de"), (11, long.replace("w", "|"), "de"), (3, long, "de")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (8, None, 1), (None, 1, 1), (7, 1, None), (99, 1, 1), (10, 0, 1)]
    names = "doc_id long, text string, lang string, part string, bits int, `a.b` int"
    df = spark.createDataFrame([(*d, "p", 1, 2) for d in docs], names)
    lab = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    want = _truth(docs, labels)
    assert _got(df, lab) == want
    # ranges that span Arrow batches, and several parts in one
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert _got(df, lab) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert _got(df.limit(0), lab) == {} and set(_got(df, lab.limit(0))) == set(_truth(docs, []))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert _got(docs, labels) == _truth([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
