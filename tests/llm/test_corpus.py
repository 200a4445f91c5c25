"""Operators on the whole corpus: near duplicates, lines, shards, archives, quality, search."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from migrata.llm import graph, lines, quality, reshard, search, simhash, warc

SF = "/root/testdata/sf0.001"


def _roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# components

def test_components_of_paths_stars_and_random_links(spark):
    rng = np.random.default_rng(2)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    some = [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(70)]
    links = path + star + some + [(5, 5), (7, 6)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links + [(None, 1)], "a long, b long")).collect()}
    want = _roots(300, links)
    assert got == {i: r for i, r in enumerate(want) if r != i}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash

def _print(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    s = [" ".join(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(rows):
    prints = [_print(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if bin(prints[a] ^ prints[b]).count("1") <= 4]
    roots = _roots(len(rows), links)
    best = defaultdict(list)
    for (i, _), r in zip(rows, roots):
        best[r].append(i)
    return [(i, f"{p:016x}", min([x for x in best[r] if x is not None], default=None)) for (i, _), p, r in zip(rows, prints, roots)]


def test_simhash_against_all_pairs(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = simhash.near_duplicates(df).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(map(tuple, got), key=key) == sorted(_classes(rows), key=key)


def test_simhash_links_lose_nothing(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 20, dtype=np.int64)
    prints = set(map(int, base))
    for x in base:
        for k in (1, 2, 3, 4, 5, 6):
            y = int(x)
            for b in rng.choice(63, k, replace=False):
                y ^= 1 << int(b)
            prints.add(y)
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(prints), 2) if bin(a ^ b).count("1") <= 4}
    assert got == want


def test_simhash_grid_is_never_broadcast(spark):
    # 35 cells a fingerprint: what Spark takes for a few kilobytes would be a hash table of millions of rows
    prints = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_simhash_keeps_one_of_each(spark, odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert kept.count() == len({c[2] if c[2] is not None else c[1] for c in _classes(rows)})
    assert sum(r["doc_id"] == 9 for r in kept.collect()) == 1
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


# lines

def _near_lines():
    base = "the quick brown fox number {} jumps over the lazy dog while the old grey cat number {} sleeps on a warm window sill in town"
    chain = base.format(1, 2).split()
    rows = [(1, base.format(1, 2) + "\n\nshort\nand this is something else entirely, not like the rest"), (2, base.format(1, 3)), (3, base.format(2, 2) + "\nshort")]
    for k in range(6):  # each differs from the one before in one word: alike in a chain, not end to end
        chain[3 * k + 1] = f"swapped{k}word"
        rows.append((10 + k, " ".join(chain)))
    return rows + [(20, "文字文字文字文字文字文字と文字文字文字"), (21, "文字文字文字文字文字文字と文字文字文字。"), (22, None), (23, ""), (24, " \n "), (None, "short\r")]


def test_lines_of_hand_made_texts(spark):
    rows = _near_lines()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in lines.dedupe(df).collect()}
    assert set(kept) == {i for i, _ in rows} and kept[22] is None and kept[23] == "" and kept[24] == " \n "


def _plain_truth(rows, similarity=0.8, size=5):
    """The lines taken out, by all pairs over the plain character shingles of every line."""
    where = defaultdict(list)
    for i, t in rows:
        for p, x in enumerate((t or "").split("\n")):
            if x := x.strip(" \t\r\v\f"):
                where[x].append((i is not None, i or 0, p))
    keys = sorted(where)
    sets = [{x[k:k + size] for k in range(max(len(x) - size, 0) + 1)} for x in keys]
    links = [(a, b) for a, b in itertools.combinations(range(len(keys)), 2)
             if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    best = {}
    roots = _roots(len(keys), links)
    for x, r in zip(keys, roots):
        best[r] = min([best[r], *where[x]] if r in best else where[x])
    return {(i if known else None, p) for x, r in zip(keys, roots) for known, i, p in where[x] if (known, i, p) != best[r]}


def test_lines_have_a_shingle_at_every_character(spark):
    texts = ["a🎉bcdéfg", "abc", "aaaaaaaaa", "x" * 700 + "y" * 700]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", F.size(lines.shingles(F.col("t"))).alias("n")).collect():
        assert r["n"] == len({r["t"][k:k + 5] for k in range(max(len(r["t"]) - 5, 0) + 1)})
    # the signatures see the same places as the verification
    counted = lines._minima(df.select(F.col("t").alias("node"), F.col("t").alias("line"), F.lit(1).alias("times")), 1, 5).collect()
    for t in texts:
        parts = {r["part"]: r["n"] for r in counted if r["node"] == t}
        n = max(len(t) - 4, 0)
        assert sum(v for k, v in parts.items() if k < 4) == n
        assert {k: v for k, v in parts.items() if k > 3} == ({4: n, 5: n, 6: n, 7: n} if 0 < n < lines.SHORT else {})


def test_lines_near_copies_of_plain_shingles(spark):
    rng = random.Random(8)
    dna = "".join(rng.choice("acgt") for _ in range(400))
    rows = [(1, "Please contact support before returning damaged products to the store"),
            (2, "Please contact suport before returning damaged products to the store"),
            (3, dna), (4, dna[:200] + ("a" if dna[200] != "a" else "c") + dna[201:]),
            (5, "alpha bravo charlie delta echo foxtrot golf hotel"), (6, "hotel golf foxtrot echo delta charlie bravo alpha"),
            (7, "文字列の比較は一文字ずつずらして行うので、語の境目に左右されない長い行"), (8, "文字列の比較は一文字ずつずらして行うので、語の境目に左右されない長い行🎉")]
    got = {(r["doc_id"], p) for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() for p in r["gone"]}
    assert got == _plain_truth(rows) == {(2, 0), (4, 0), (8, 0)}
    rows = _near_lines()
    got = {(r["doc_id"], p) for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() for p in r["gone"]}
    assert got == _plain_truth(rows)


def test_lines_of_the_documents_by_plain_shingles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 90")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {(r["doc_id"], p) for r in lines.report(docs).collect() for p in r["gone"]}
    want = _plain_truth(rows)
    assert len(got ^ want) <= 0.01 * len(want)


def _edited_lines(rng, count, sizes=(150, 200, 300, 1200)):
    """(line, copy) pairs of all similarities: some letters of the copy changed."""
    out = []
    for n in sizes:
        for k in range(count):
            base = [rng.choice("abcdefgh ") for _ in range(n)]
            copy = list(base)
            for _ in range(k % (n // 12)):
                copy[rng.randrange(n)] = rng.choice("xyz")
            out.append(("".join(base).strip(), "".join(copy).strip()))
    return out


def test_lines_bands_and_sketch_let_alike_pairs_through(spark):
    pairs = _edited_lines(random.Random(4), 100)
    texts = sorted({t for p in pairs for t in p})
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "node long, line string, times long")
    s = {r["node"]: r for r in lines._signatures(df, lines.BANDS, 5).collect()}
    place = {t: k for k, t in enumerate(texts)}
    sets = [{t[k:k + 5] for k in range(max(len(t) - 5, 0) + 1)} for t in texts]
    both = spark.createDataFrame([(a, b, *(s[x][c] for x in (a, b) for c in ("s1", "s2"))) for a, b in ((place[x], place[y]) for x, y in pairs)],
                                 "a long, b long, p long, q long, r long, t long")
    through = {(r["a"], r["b"]) for r in both.where(lines.agree(*map(F.col, "pqrt"))).collect()}
    alike = {(place[x], place[y]) for x, y in pairs if len(sets[place[x]] & sets[place[y]]) >= 0.8 * len(sets[place[x]] | sets[place[y]])}
    banded = {(a, b) for a, b in alike if any(x == y for x, y in zip(s[a]["keys"], s[b]["keys"]))}
    assert len(alike) > 100 and alike <= through and len(banded) >= 0.99 * len(alike)
    fields = lambda k: [s[k][c] >> 3 * i & 7 for c in ("s1", "s2") for i in range(20)]
    for a, b in ((place[x], place[y]) for x, y in pairs):
        assert ((a, b) in through) == (sum(x == y for x, y in zip(fields(a), fields(b))) >= lines.AGREE)


def test_lines_hot_groups_meet_once(spark):
    rng = random.Random(6)
    base = [f"word{rng.randrange(900)}" for _ in range(40)]
    copies = []
    for k in range(150):
        w = list(base)
        w[rng.randrange(40)] = f"other{k}"
        copies.append(" ".join(w))
    rows = [(k, t) for k, t in enumerate(copies)] + [(500 + k, " ".join(base)) for k in range(50)]
    got = {(r["doc_id"], p) for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() for p in r["gone"]}
    assert got == _plain_truth(rows) == {(i, 0) for i, _ in rows if i}


def test_lines_that_share_a_passage_do_not_meet_pairwise(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    passage, tails = " ".join(word() for _ in range(36)), [[word() for _ in range(14)] for _ in range(80)]
    rows = [(k, passage + " " + " ".join(t)) for k, t in enumerate(tails)]
    # some have a near copy, which no centre of a bucket needs to lead to
    rows += [(100 + k, passage + " " + " ".join([*tails[k][:-1], word()])) for k in range(10)]
    met = []
    verified = lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *a: (met.append(pairs.count()), verified(pairs, *a))[1])
    got = {(r["doc_id"], p) for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() for p in r["gone"]}
    assert got == _plain_truth(rows) == {(100 + k, 0) for k in range(10)}
    # 90 lines have 3,995 pairs of different components
    assert len(met) == 2 and met[1] < 200


def test_lines_of_a_settled_bucket_do_not_meet_again(spark, monkeypatch):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    rows = []
    # two of a kind, not alike enough, meet as line and centre of buckets of their own
    for k in range(60):
        text = [word() for _ in range(40)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text[:34], *[word() for _ in range(6)]]))]
    met, marked = [], []
    verified, marks = lines._verified, lines._marks
    monkeypatch.setattr(lines, "_verified", lambda pairs, *a: (met.append(pairs.count()), verified(pairs, *a))[1])
    monkeypatch.setattr(lines, "_marks", lambda texts, *a: (marked.append(texts.count()), marks(texts, *a))[1])
    assert all(r["n_gone"] == 0 for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # their texts are read once
    assert met[0] > 40 and met[1:] == [0] and marked == [0]


def test_lines_components_grow_by_their_roots(spark):
    rng = random.Random(9)
    first = [(a, b) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(120)) if a != b]
    then = [(a, b) for a, b in ((rng.randrange(230), rng.randrange(230)) for _ in range(60)) if a != b]
    link = lambda x: spark.createDataFrame(x, "a long, b long")
    got = {r["node"]: r["root"] for r in lines._merged(graph.components(link(first)), link(then)).collect()}
    roots = _roots(230, first + then)
    assert got == {k: r for k, r in enumerate(roots) if r != k}
    assert lines._merged(graph.components(link(first)), link([])).count() == graph.components(link(first)).count()


def test_lines_pairs_meet_their_texts_once(spark, monkeypatch):
    # however many pairs there are, they are settled at once: no texts are dealt anew for a part of them
    rng = random.Random(21)
    texts = [" ".join(f"word{rng.randrange(40)}" for _ in range(8)) for _ in range(165)]
    texts += [t[:-1] + "x" for t in texts] + ["abc", "abd", "aaaaaaaaa", "aaaaaa"]
    sets = [{t[k:k + 5] for k in range(max(len(t) - 5, 0) + 1)} for t in texts]
    alike = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(alike) > 100
    lined = spark.createDataFrame(list(enumerate(texts)), "node long, line string")
    ids = spark.range(len(texts))
    found, made = lines.stored, []
    monkeypatch.setattr(lines, "stored", lambda df, tag, *a: (made.append(tag), found(df, tag, *a))[1])
    for _ in range(2):
        pairs = found(ids.toDF("a").crossJoin(ids.toDF("b")).where("a < b").repartition(4), "pairs")
        got = {(r["a"], r["b"]) for r in lines._verified(pairs, found(lined, "texts"), 0.8, 5).collect()}
        assert got == alike and made == ["alike"]
        # the second time the longer lines are settled row by row
        monkeypatch.setattr(lines, "WHOLE", 50)
        made.clear()
        kept = lines._sets(lined, 5).groupBy("node").agg(F.count("h").alias("n"), F.count_distinct("h").alias("d")).collect()
        assert {r["node"]: r["n"] for r in kept} == {k: len(x) for k, x in enumerate(sets)} and all(r["n"] == r["d"] for r in kept)


def test_lines_odd_rows(odd, empty):
    kept = lines.dedupe(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    text = "\n".join(r["text"] or "" for r in kept.collect())
    # a null id sorts first, so its line is the one that stays
    assert text.count("second line of it") == 1 and "a row without id\nsecond line of it" in text
    assert lines.dedupe(empty).count() == 0 and lines.report(empty).count() == 0


def test_lines_run_no_python(spark):
    df = spark.createDataFrame(_near_lines(), "doc_id long, text string")
    plan = lines.report(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# shards

def test_min_cost_flow_moves_the_least():
    rng = np.random.default_rng(1)
    for _ in range(20):
        old = [int(x) for x in rng.integers(0, 100, 5)]
        cut = np.sort(rng.integers(0, sum(old) + 1, 3))
        new = [int(x) for x in np.diff([0, *cut, sum(old)])]
        flow = reshard.min_cost_flow(old, new, lambda i, j: int(i != j))
        assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(5)] == old
        assert [sum(f for (_, j), f in flow.items() if j == k) for k in range(4)] == new
        assert sum(f for (i, j), f in flow.items() if i != j) == sum(max(0, o - n) for o, n in itertools.zip_longest(old, new, fillvalue=0))
    with pytest.raises(ValueError):
        reshard.min_cost_flow([5], [4], lambda i, j: 0)


def test_shards_follow_the_bytes_law(spark, odd):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        rows = df.select("doc_id", "text").collect()
        got = reshard.report(df).collect()
        size = lambda t: len((t or "").encode()) + 1
        assert sorted((g["doc_id"] or -1, g["size"], g["text_crc32"]) for g in got) == sorted(
            (r["doc_id"] or -1, size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in rows)
        slots = defaultdict(list)
        held = [0] * 16
        for g in got:
            slots[g["shard"]].append(g["slot"])
            held[g["shard"]] += g["size"]
            assert g["law"] == "bytes" and g["grown_shard"] is None
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(held) - min(held) <= max(size(r["text"]) for r in rows)


def test_resharding_moves_little_and_keeps_the_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    layout = reshard.lay_out(docs, F.pmod(F.col("doc_id"), F.lit(4)), reshard.size_of(F.col("text")), 4)
    after, placed, stats = reshard.reshard(spark, layout, 6)
    old = {r[0]: r[1] for r in layout.read(spark).groupBy("__shard").agg(F.sum("__size")).collect()}
    least = sum(max(0, n - stats["total"] // 6) for n in old.values())
    assert stats["moved"] <= 1.05 * least + 50_000
    assert after.read(spark).select("doc_id", "text").exceptAll(docs).count() == 0 and after.read(spark).count() == docs.count()
    # equal capacities as they are: nothing moves, nothing is rewritten
    same, _, stats = reshard.reshard(spark, after, 6, [r[1] for r in after.read(spark).groupBy("__shard").agg(F.sum("__size")).orderBy("__shard").collect()])
    assert stats["moved"] == 0 and len(same.folders) == len(after.folders)


def test_shards_of_nothing(empty):
    assert reshard.report(empty).count() == 0


# archives

def _pages(spark):
    big, other = "<p>" + "x" * 1200, "<p>" + "yé" * 800
    rows = [(1, "http://a/1", big, 0), (5, "http://a/5", big, 0), (3, None, big, 0), (7, "u v", "small", 0), (8, "w", "small", 0), (9, "n", None, 0),
            (10, "z", other, 0), (None, "q", other, 0), (11, "e", "", 0), (12, "r", big + "z" * 200_000, 0), (12, "r", big + "z" * 200_000, 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


def test_archives_round_trip(spark):
    pages = _pages(spark)
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    first = {}
    for r in pages.collect():
        if r["html"] and len(r["html"].encode()) >= 1000 and r["page_id"] is not None:
            first[r["html"]] = max(first.get(r["html"], 0), r["page_id"])
    want = []
    for r in pages.collect():
        f = first.get(r["html"])
        revisit = f is not None and f != r["page_id"]
        want.append((r["page_id"], len((r["html"] or "").encode()), sha(r["html"]), "revisit" if revisit else "response", f if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_archive_files(spark, tmp_path):
    import zstandard

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    archives = warc.write(pages, folder=str(tmp_path / "w"), archive_bytes=40_000)
    names = [r["archive"] for r in archives.collect()]
    assert len(names) > 3 and sum(r["records"] for r in archives.collect()) == pages.count()
    raw = open(names[0], "rb").read()
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_MAGIC
    n = int.from_bytes(raw[4:8], "little")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8:8 + n])).decompressobj()
    assert d.decompress(raw[8 + n:]).endswith(b"\r\n\r\n")  # the first record alone
    back = {r["page_id"]: (r["url"], bytes(r["payload"]).decode()) for r in warc.read(archives, pages.schema["page_id"].dataType, payloads=True).collect()}
    assert back == {r["page_id"]: (r["url"], r["html"]) for r in pages.collect()}


# quality

def test_quality_on_held_out_rows(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(got) == docs.count()
    assert all(g["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and g["predicted"] == int(g["score"] >= 0.5) and 0 <= g["score"] <= 1 for i, g in got.items())
    out = [i for i in truth if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == truth[i] for i in out]) >= 0.97
    kept = quality.reject(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, g in got.items() if g["predicted"]}
    # held-out labels are never learnt from
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in quality.classify(docs, flipped).collect()} == {i: g["score"] for i, g in got.items()}
    scored = quality.classify(odd, labels).collect()
    assert len(scored) == odd.count() and len({r["score"] for r in scored if r["doc_id"] in (2, 3)}) == 1
    assert quality.reject(odd, labels).columns == odd.columns
    assert quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(odd, labels.where("false")).collect()} == {0.5}


def test_quality_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    with_pairs, without = quality.fit(x, y, 20, 2, 30), quality.fit(x, y, 20, 0, 0)
    right = lambda m: ((m.score(x) >= 0.5) == y).mean()
    assert (0, 1) in with_pairs.pairs and right(with_pairs) > 0.95 > right(without)


# search

def test_search_recall_and_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = defaultdict(list)
    for r in search.search(vectors, every=10, block_rows=100).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    asked = [i for i in ids if i % 10 == 0]
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert [k for k, _, _ in got[q]] == list(range(1, 11)) and q not in [v for _, v, _ in got[q]]
        assert all(s == d[ids == v][0] for _, v, s in got[q]) and [s for _, _, s in got[q]] == sorted(s for _, _, s in got[q])
        hits += len({ids[i] for i in best} & {v for _, v, _ in got[q]})
    assert hits / (10 * len(asked)) >= 0.9


def test_search_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (200, None, 1), (300, [0.0, 0.0], 1), (400, [nan, 1.0], 1), (500, [inf, 1.0], 1), (1, [1.0, None], 1),
            (2, [1.0], 1), (3, [1.0, 0.0], 1), (4, [0.0, 2.0], 1), (4, [0.0, 2.0], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int")
    got = [tuple(r) for r in search.search(df).orderBy("query_id", "rank").collect()]
    far = 5 ** 0.5
    assert got == [(0, 1, 3, 0.0), (0, 2, 100, 0.0), (0, 3, 4, far), (0, 4, 4, far), (100, 1, 0, 0.0), (100, 2, 3, 0.0), (100, 3, 4, far), (100, 4, 4, far)]
    assert search.search(df.where("false")).count() == 0
