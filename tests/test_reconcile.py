"""Crosswalks, survivors, ref repair, dates, mapping tables, amounts, column matches by hand."""

import datetime as dt
import itertools
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from migrata.operators import reconcile as rc
from migrata.operators import standardise as st
from migrata.plans import matching
from migrata.spec import SpecError


def _rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


# E1

def test_crosswalk_and_refs(spark):
    a = spark.createDataFrame([(7,), (3,), (None,), (7,)], "k long")
    b = spark.createDataFrame([(3,), (9,)], "id long")
    walk = rc.crosswalk({"a": (a, "k"), "b": (b, "id")})
    assert _rows(walk, "source", "old", "new") == [("a", 3, 1), ("a", 7, 2), ("b", 3, 3), ("b", 9, 4)]
    # a hot ref, a missing one, a null one and a column that is like a name used inside
    child = spark.createDataFrame([(i, 7 if i % 3 else 5, None if i == 4 else 3, "x") for i in range(30)], "id long, a_id long, b_id long, `__mg_x` string")
    out = rc.rewrite_refs(child, {"a_id": "a", "b_id": "b"}, walk)
    assert out.columns == child.columns
    assert _rows(out, "id", "a_id", "b_id") == sorted(((i, 2 if i % 3 else None, None if i == 4 else 3) for i in range(30)), key=str)
    assert _rows(rc.dangling(child, {"a_id": "a", "b_id": "b"}, walk)) == [("a_id", 5, 10)]
    assert rc.rewrite_refs(child.limit(0), {"a_id": "a"}, walk).count() == 0
    text = rc.crosswalk({"a": (a, "k"), "t": (spark.createDataFrame([("q",)], "k string"), "k")})
    assert _rows(text, "source", "old", "new") == [("a", "3", 1), ("a", "7", 2), ("t", "q", 3)]


def test_nested_refs(spark):
    p = spark.createDataFrame([(10,), (20,)], "k long")
    walk = rc.crosswalk({"p": (p, "k")})
    df = spark.createDataFrame([(1, [(10, "a"), (20, "b"), (99, "c")], 5), (2, [], 6), (3, None, 7), (4, [(20, "d"), None, (20, "e")], 8)],
                               "id long, xs array<struct<p:long,t:string>>, n int")
    out = rc.rewrite_nested(df, "xs", "p", "p", walk)
    got = {r["id"]: r["xs"] and [x and tuple(x) for x in r["xs"]] for r in out.collect()}
    assert out.columns == df.columns
    assert got == {1: [(1, "a"), (2, "b"), (None, "c")], 2: [], 3: None, 4: [(2, "d"), None, (2, "e")]}


# E3

def test_survivors_choose_field_by_field(spark):
    rows = [(5, "Ann  Lee", None, 1.0, "bb"), (2, "ann-lee", "x", 9.0, "aa"), (8, "ANN LEE.", "y", 3.0, "c"), (4, "Bo", None, 2.0, None), (6, None, "q", 4.0, "z"), (7, None, "q", 4.0, "z"), (9, " . ", "r", 1.0, "z")]
    df = spark.createDataFrame(rows, "id long, name string, tag string, sum double, note string")
    out, lost = rc.merge_duplicates(df, rc.natural_key(F.col("name")), {"tag": "latest", "sum": "sum", "note": "longest", "name": "earliest"})
    assert _rows(out, "id", "name", "tag", "sum", "note") == sorted([(2, "ann-lee", "y", 13.0, "aa"), (4, "Bo", None, 2.0, None), (6, None, "q", 4.0, "z"), (7, None, "q", 4.0, "z"), (9, " . ", "r", 1.0, "z")], key=str)
    assert _rows(lost) == [(5, 2), (8, 2)]
    refs = spark.createDataFrame([(1, 5), (2, 8), (3, 4), (4, None), (5, 77)], "id long, who long")
    assert _rows(rc.repoint(refs, "who", lost)) == [(1, 2), (2, 2), (3, 4), (4, None), (5, 77)]
    with pytest.raises(ValueError):
        rc.merge_duplicates(df, F.col("name"), {"tag": "best"})
    assert rc.merge_duplicates(df.limit(0), F.col("name"), {})[0].count() == 0


# E4

def test_repair_never_guesses(spark):
    parent = spark.createDataFrame([(1, "Oak St."), (2, "elm"), (3, "ELM "), (4, None), (1, "Oak St.")], "pk long, name string")
    child = spark.createDataFrame([(1, 2, "anything"), (2, 90, "oak  st"), (3, 91, "Elm"), (4, 92, "fir"), (5, 93, None), (6, None, "OAK ST"), (7, None, None)], "id long, ref long, name string")
    out = rc.repair_refs(child, "ref", rc.natural_key(F.col("name")), parent, "pk", rc.natural_key(F.col("name")))
    assert _rows(out, "id", "ref", "outcome") == sorted([(1, 2, "valid"), (2, 1, "repaired"), (3, 91, "ambiguous"), (4, 92, "unmatched"), (5, 93, "unmatched"), (6, 1, "repaired"), (7, None, "valid")], key=str)


# E2

def test_dates_are_never_guessed(spark):
    texts = {"day": ["25/03/2024", "04/03/2024", "3/4/99", "31-01-69", "03/25/2024"], "month": ["3/25/2024", "03/04/2024"], "open": ["01/02/2024", "05.05.2024"],
             "plain": ["2024-02-30", "2024-02-29T10:00:00", "20240229", "9 MAR 2024", "what", "", None]}
    df = spark.createDataFrame([(s, t) for s, ts in texts.items() for t in ts if (s, t) != ("day", "03/25/2024")], "src string, t string")
    got = {(r["src"], r["t"]): (r["parsed"], r["reject"]) for r in st.normalise_dates(df, "t", by="src").collect()}
    d = dt.date
    assert got == {("day", "25/03/2024"): (d(2024, 3, 25), None), ("day", "04/03/2024"): (d(2024, 3, 4), None), ("day", "3/4/99"): (d(1999, 4, 3), None), ("day", "31-01-69"): (d(2069, 1, 31), None),
                   ("month", "3/25/2024"): (d(2024, 3, 25), None), ("month", "03/04/2024"): (d(2024, 3, 4), None),
                   ("open", "01/02/2024"): (None, "ambiguous"), ("open", "05.05.2024"): (d(2024, 5, 5), None),
                   ("plain", "2024-02-30"): (None, "unparsed"), ("plain", "2024-02-29T10:00:00"): (d(2024, 2, 29), None), ("plain", "20240229"): (d(2024, 2, 29), None),
                   ("plain", "9 MAR 2024"): (d(2024, 3, 9), None), ("plain", "what"): (None, "unparsed"), ("plain", ""): (None, None), ("plain", None): (None, None)}
    mixed = spark.createDataFrame([(t,) for t in ("25/03/2024", "03/25/2024", "01/02/2024")], "t string")
    assert st.date_evidence(mixed, "t").first()["decision"] == "mixed"
    assert _rows(st.normalise_dates(mixed, "t")) == sorted([("25/03/2024", d(2024, 3, 25), None), ("03/25/2024", d(2024, 3, 25), None), ("01/02/2024", None, "ambiguous")], key=str)


# T3 / P4 / E5

def test_mapping_tables(spark):
    df = spark.createDataFrame([("a",), ("B ",), ("c",), (None,)], "v string")
    m = spark.createDataFrame([("a", "x"), ("b", None), ("a", "x")], "key string, value string")
    assert _rows(st.remap_by_table(df, "v", m)) == sorted([("x",), ("B ",), ("c",), (None,)], key=str)
    assert _rows(st.remap_by_table(df, "v", m, default="suffix", suffix="_", normalise=st.plain_text)) == sorted([("x",), (None,), ("c_",), (None,)], key=str)
    assert _rows(st.remap_by_table(df, "v", m, default="null")) == sorted([("x",), (None,), (None,), (None,)], key=str)
    with pytest.raises(SpecError):
        st.remap_by_table(df, "v", m.union(spark.createDataFrame([("a", "y")], m.schema)))
    with pytest.raises(SpecError):
        st.remap_by_table(df, "v", spark.createDataFrame([("A", "y"), ("a ", "z")], m.schema), normalise=st.plain_text)
    big = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("v"), "id").alias("value"))
    assert st.remap_by_table(big.select(F.col("key").alias("v")), "v", big).where("v NOT LIKE 'v%'").count() == 0


def test_amounts(spark):
    cases = {"$1,234.50": "1234.50", "1.234,50 €": "1234.50", "USD 12": "12.00", "(45.00)": "-45.00", "£ -3.5": "-3.50", "7-": "-7.00", "1,234": "1234.00", "1,23": "1.23", "1.234.567": "1234567.00",
             "12,34,567": None, "1'234.50 CHF": "1234.50", "abc": None, "": None, "1.2.3,4": None, "0,5": "0.50", "-": None}
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string")
    got = {r["t"]: r["a"] for r in df.select("t", st.amount(F.col("t")).alias("a")).collect()}
    assert got == {**{t: None if v is None else Decimal(v) for t, v in cases.items()}, None: None}
    assert [r[0] for r in spark.createDataFrame([("$1",), ("1 chf",), ("1",), ("€2",)], "t string").select(st.currency(F.col("t"))).collect()] == ["USD", "CHF", None, "EUR"]


# E6

def test_column_matches_against_all_pairs(spark):
    sizes = {"a": range(0, 100), "b": range(0, 90), "c": range(50, 150), "d": range(40, 160), "e": range(1000, 1100), "f": range(0, 5)}
    tables = {f"t{k}": spark.createDataFrame([(int(v), str(v), None) for v in vs] + [(None, "z", None)], f"{k} long, `{k} x` string, n long") for k, vs in sizes.items()}
    got = {(r["column_a"], r["column_b"]): round(r["jaccard"], 9) for r in matching.column_matches(tables).collect()}
    want = {}
    for x, y in itertools.combinations(sizes, 2):
        for fmt, extra in (("{}", set()), ("{} x", {"z"})):
            p, q = {str(v) for v in sizes[x]} | extra, {str(v) for v in sizes[y]} | extra
            if len(p & q) >= 0.5 * len(p | q):
                want[fmt.format(x), fmt.format(y)] = round(len(p & q) / len(p | q), 9)
    assert got == want and len(want) >= 4
    prof = {(r["table_name"], r["column_name"]): (r["kind"], r["n_rows"], r["n_null"], r["n_distinct"]) for r in matching.column_profiles(matching.column_values(tables)).collect()}
    assert prof["tf", "f"] == ("integer", 6, 1, 5) and prof["tf", "n"] == ("integer", 6, 6, 0) and prof["ta", "a x"] == ("text", 101, 0, 101)


def test_repair_spreads_rows_that_ask_for_nothing(spark):
    parent = spark.createDataFrame([(i, f"n{i}") for i in range(40)], "pk long, name string")
    child = spark.range(800).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 40).alias("ref"), F.lit(None).cast("string").alias("name"),
                                    F.create_map(F.lit("a"), F.col("id")).alias("m"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = rc.repair_refs(child, "ref", F.col("name"), parent, "pk", F.col("name"))
        held = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert out.columns == ["id", "ref", "name", "m", "outcome"]
        assert sum(held) == 800 and max(held) < 400 and len(held) == 4
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert _rows(out, "id", "ref", "outcome") == sorted(((i, i % 40 if i % 2 == 0 else None, "valid") for i in range(800)), key=str)
