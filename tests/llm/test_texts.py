"""Operators that map texts: BPE, extraction, decontamination, license scan."""

import hashlib
import random
import re
from html.parser import HTMLParser

import pytest

pytest.importorskip("tiktoken")

import public_tokenizers
import tiktoken

from migrata.llm import bpe, decontaminate, html, licenses

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _rows(df, key):
    return {r[key]: r for r in df.collect()}


# byte-level BPE

def test_bpe_is_the_library_and_a_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    enc = bpe.codec(RANKS, public_tokenizers.PATTERN).encoding
    got = _rows(bpe.digests(docs, RANKS, public_tokenizers.PATTERN, ids=True), "doc_id")
    for r in docs.select("doc_id", "text").collect():
        g = got[r["doc_id"]]
        ids = enc.encode_ordinary(r["text"])
        assert bpe.unpacked(g["ids"]) == ids and g["n_tokens"] == len(ids)
        assert g["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_bpe_cuts_long_texts_where_tokens_end():
    c = bpe.codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    alphabet = ["a", "Z", "9", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "文", " ", "\x1c", "!", "🎉", " "]
    for n in (1, 7, 40, 3000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        for size in (1, 5, 64):
            parts = list(bpe.pieces(text, size))
            assert "".join(parts) == text
            assert [i for p in parts for i in c.encoding.encode_ordinary(p)] == c.encoding.encode_ordinary(text)


def test_bpe_odd_rows(odd, empty):
    got = bpe.digests(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == odd.count()
    none = [g for g in got if g["doc_id"] in (2, 3)]
    assert all(g["n_tokens"] == 0 and g["ids_sha256"] == g["decoded_sha256"] == hashlib.sha256(b"").hexdigest() for g in none)
    assert bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# extraction

class _Plain(HTMLParser):
    """Text of the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.on += tag == "article"
        if tag != "b":
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.on -= tag == "article"
        if tag != "b":
            self.out.append(" ")

    def handle_data(self, data):
        if self.on:
            self.out.append(data)


def test_extraction_against_a_plain_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = _rows(html.main_text(pages), "page_id")
    for r in pages.collect():
        p = _Plain()
        p.feed(r["html"])
        p.close()
        want = " ".join("".join(p.out).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain words alone", "plain words alone"),
    ("<article><h1>T</h1><p>A &amp; B\n  c</p></article>", "T A & B c"),
    ("<main><p>one<p>two<br>three</main><footer>no</footer>", "one two three"),
    ("<article><p>x<i>y</i>z</p><aside>no</aside><div class='ad box'>no</div><p>w</article>", "xyz w"),
    ("<article>a<section id=comments><article class=comment>no</article></section>b</article>", "a b"),
    ("<article>a<script>var t='</p>'</script><style>p{}</style><!-- c --><form>no</form>b", "a b"),
    ("<nav>no</nav><article>1 < 2 and <b>bold", "1 < 2 and bold"),
    ("<article><p>ab<", "ab<"),
    ("<ul><li><a href=x>menu</a></ul><div>" + "real text here. " * 10 + "</div><p>tail</p><footer>no</footer>",
     ("real text here. " * 10).strip() + " tail"),
    ("<div>short</div>", "short"),
    ("<div id=content><p>Short main text.</p></div>", "Short main text."),
])
def test_extraction_cases(page, want):
    assert html.extract(page) == want


LONG = "a sentence of the main text that is long enough to be one. " * 3


@pytest.mark.parametrize("page, want", [
    # the article of a page does not switch off the text outside it
    (f"<article class=teaser><p>teaser</p></article><div id=content><p>{LONG}</p><p>short</p><p>{LONG}</p></div>",
     f"teaser {LONG}short {LONG}".strip()),
    # class names count whole, and never on what holds an article
    (f"<div class='layout has-sidebar'><article><p>{LONG}</p></article></div>", LONG.strip()),
    (f"<div class='sidebar'><article><p>{LONG}</p></article></div>", LONG.strip()),
    (f"<div class='sidebar'><p>{LONG}</p></div><article>a</article>", "a"),
    (f"<div class='post-share'><p>{LONG}</p></div>", LONG.strip()),
    # short lines and links between surge and dive stay
    (f"<p>{LONG}</p><p><a href=x>linked heading</a></p><p>{LONG}</p><ul><li><a href=x>menu</a></ul>", f"{LONG}linked heading {LONG}".strip()),
])
def test_extraction_by_the_distribution(page, want):
    assert html.extract(page) == want


@pytest.mark.parametrize("page, want", [
    # pages without article tags: names whole and in parts, menus, short pages
    (f"<div class='site-masthead'><p>Site</p></div><div class='post'><p>{LONG}</p><p>end</p></div><div class='site-sidebar'><p>{LONG}</p></div>" + f"<p>{LONG}</p>" * 3,
     f"{LONG}end " + " ".join([LONG.strip()] * 3)),
    (f"<ul class=top-menu><li><a href=a>one</a><li><a href=b>two</a></ul><h1>Title</h1><p>{LONG}<p>{LONG}<div id='ad-slot_3'>buy</div><p>{LONG}", f"Title {LONG}{LONG}{LONG}".strip()),
    (f"<article><p>{LONG}</p><div class='cookie-banner'>we use them</div><p>tail</p></article><div class=user-comments><p>{LONG}</p></div><p>{LONG}</p>" + f"<article><p>{LONG}</p></article>" * 2,
     f"{LONG}tail {LONG}{LONG}{LONG}".strip()),
    # a wrapper that holds most of the text is no sidebar, whatever a part of its name says
    (f"<div class='with-sidebar'><p>{LONG}</p></div><p>tail</p>", f"{LONG}tail"),
    ("<p>First words.</p><div class=ads>buy</div><p>Last words.</p>", "First words. Last words."),
    ("<p>A few words of text.</p><aside>no</aside><p>x</p>", "A few words of text."),
    ("<nav>a b c</nav><ul><li><a href=x>menu</a></ul>", ""),
])
def test_extraction_without_article_tags(page, want):
    assert html.extract(page) == want


def test_outline_counts_what_elements_hold():
    page = "<div a><p>one two</p><section>three<script>no</script></section><article>x</article></div>tail <b>t"
    o = html._Outline(page)
    at = {k: page.index(k) for k in ("<div", "<section", "<article")}
    assert (o.size[at["<div"]], o.size[at["<section"]], o.total) == (12, 5, 17) and o.holders == {at["<div"]}


def test_block_sums():
    assert html.block_sums([1, 0, 0, 0, 5, 2], 3) == [1, 0, 5, 7, 7, 2]


def test_extraction_long_and_odd_pages(spark):
    page = "<article>" + "<p>some words</p>" * 50_000 + "</article>"
    df = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 1), (2, None, None, 2), (None, "v", "<p", 3)], "page_id int, url string, html string, n_chars int")
    got = sorted(html.main_text(df).collect(), key=lambda r: (r["page_id"] or 0, r["n_chars"]))
    assert [(r["page_id"], r["n_chars"]) for r in got] == [(None, 0), (1, 50_000 * 11 - 1), (1, 50_000 * 11 - 1), (2, 0)]
    assert html.main_text(df.where("false")).count() == 0


# decontamination

def _naive(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for text in docs:
        w = low(text)
        hit, found = set(), set()
        for key, item in items:
            x = low(item)
            n = min(window, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b:b + n] == x[a:a + n]:
                        hit.update(range(b, b + n))
                        found.add(key)
        out.append((len(w), len(hit), found - {None}))
    return out


def test_decontamination_against_all_windows():
    rng = random.Random(5)
    for trial in range(60):
        letters = "abc"[: 1 + trial % 3]
        items = [(f"i{k}", " ".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 5, 9])))) for k in range(5)] + [(None, "a b c a")]
        docs = [" ".join(rng.choice(letters + "d") for _ in range(rng.randrange(30))) for _ in range(6)]
        a = decontaminate.SuffixAutomaton([(k, decontaminate.words_of(t)) for k, t in items], 4)
        for text, (n, hits, found) in zip(docs, _naive(docs, items, 4)):
            spans, got = a.scan(decontaminate.words_of(text))
            assert (sum(e - s for s, e in spans), got) == (hits, found), (items, text)


@pytest.mark.parametrize("chunk_words", [100_000, 150])
def test_decontamination_of_the_documents(spark, chunk_words):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = docs.where("n_chars < 3000").select("doc_id", "text").orderBy("doc_id").collect()[:80]
    known = [(r["item_id"], r["text"]) for r in items.collect()]
    got = _rows(decontaminate.report(docs, items, chunk_words=chunk_words), "doc_id")
    for r, (n, hits, found) in zip(rows, _naive([r["text"] for r in rows], [(str(k), t) for k, t in known])):
        g = got[r["doc_id"]]
        want = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) == (n, hits, len(found), want, hits > 0)
    assert any(g["contaminated"] for g in got.values())


def test_decontamination_removal(spark, odd, empty):
    items = spark.createDataFrame([("p", "one two three four five six seven eight nine ten"), ("q", None), ("r", ""), (None, "X"), ("p", "x")],
                                  "item_id string, text string")
    docs = spark.createDataFrame([(1, "Intro: ONE two, three four five six seven eight nine ten! Rest of the text stays here, and here, and here as well."),
                                  (2, "one two three four five six seven eight nine ten"), (3, None), (4, "clean"), (5, "x")], "doc_id int, text string")
    kept = {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, items).collect()}
    assert kept == {1: "Intro: ! Rest of the text stays here, and here, and here as well.", 3: None, 4: "clean"}
    assert not any(r["contaminated"] for r in decontaminate.report(decontaminate.remove(docs, items, max_coverage=1.0), items).collect())
    seen = {r["doc_id"]: r for r in decontaminate.report(docs, items).collect()}
    assert seen[5]["n_items"] == 1 and seen[5]["n_hit"] == 1 and seen[2]["n_items"] == 1
    assert decontaminate.remove(odd, items).columns == odd.columns
    assert decontaminate.report(odd, items).count() == odd.count()
    assert decontaminate.report(empty, items).count() == 0 and decontaminate.remove(empty, items).count() == 0
    none = items.where("false")
    assert decontaminate.remove(odd, none).count() == odd.count() and not any(r["n_hit"] for r in decontaminate.report(odd, none).collect())


def test_decontamination_removal_by_any_number_of_automata(spark):
    w = [f"w{i}" for i in range(400)]
    items = spark.createDataFrame([(f"i{k}", " ".join(w[20 * k:20 * k + 30])) for k in range(12)], "item_id string, text string")
    rest = lambda n, tag: [f"{tag}{i}" for i in range(n)]
    docs = spark.createDataFrame([
        (1, " ".join(w[0:30] + rest(45, "x") + w[100:125])),             # 55 of 100 words, by two items
        (2, " ".join(rest(60, "y") + w[10:45] + rest(60, "z"))),         # windows of two items overlap
        (3, " ".join(rest(30, "a") + w[200:205] + w[300:312] + w[205:210] + rest(30, "b"))),
        (4, "clean"), (5, None), (6, "")], "doc_id int, text string")
    got = [{r["doc_id"]: r["text"] for r in decontaminate.remove(docs, items, chunk_words=n).collect()} for n in (100_000, 40)]
    assert got[0] == got[1] and 1 not in got[0] and set(got[0]) == {2, 3, 4, 5, 6}
    assert not any(f" w{i} " in f" {t} " for t in (got[0][2],) for i in range(400))


# license scan

def test_license_bands_are_enough():
    for c in range(8):
        least, window = (1 << c) // 2 + 1, 2 << c
        held = 0.8 * least
        assert (1 - held / (window + least - held)) ** licenses.bands_for(least, window) <= 1 - licenses.RECALL


def test_license_scan_against_every_window(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.randrange(200))]
        name, text = rng.choice(sorted(licenses.TEMPLATES.items()))
        part = text.split()
        for _ in range(rng.choice([0, 0, 1, len(part) // 8])):
            part[rng.randrange(len(part))] = "changed"
        at = rng.randrange(len(body) + 1)
        texts.append((i, " ".join(body[:at] + part * (i % 4 > 0) + body[at:])))
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    got = _rows(licenses.scan(docs), "doc_id")
    scanner = licenses.Scanner(licenses.TEMPLATES)
    wrong = 0
    for i, text in texts:
        w = decontaminate.words_of(text)
        found = scanner.candidates(w)
        assert [(m["template"], m["start"], m["end"]) for m in got[i]["matches"]] == [m[:3] for m in licenses.settled(found)]
        for name, template in licenses.TEMPLATES.items():
            t = decontaminate.words_of(template)
            own = set(licenses.shingles_of(t, 5))
            n, span = min(5, len(t)), 2 << (len(licenses.shingles_of(t, 5)) - 1).bit_length()
            step = span // 2
            s = [tuple(w[a:a + n]) for a in range(len(w) - n + 1)]
            there = any(len(own & set(s[a:a + span])) >= 0.8 * len(own) for a in range(0, max(len(s), 1), step))
            wrong += there != any(m.template == name for m in found)
    assert wrong == 0


def test_license_families_are_told_apart():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        n = len(decontaminate.words_of(text))
        assert scanner.scan(f"before {text} after")[1] == [(name, 1, n + 1, 1.0)], name
        if n >= 60:  # a changed word takes five shingles and no license
            words = text.split()
            words[len(words) // 2] = "changed"
            assert [m[0] for m in scanner.scan(" ".join(words))[1]] == [name]
    lesser = licenses.TEMPLATES["GPL-3.0-or-later"].replace("General", "Obscure General")
    assert [m[0] for m in scanner.scan(lesser)[1]] == ["GPL-3.0-or-later"]  # nothing nearer is known


def test_license_every_occurrence(spark):
    rng = random.Random(5)
    names = sorted(licenses.TEMPLATES)
    texts, truth = [], {}
    for i in range(40):
        parts, at, here = [], 0, []
        for _ in range(rng.randrange(12)):
            gap = [f"w{rng.randrange(1000)}" for _ in range(rng.choice([0, 0, 1, 30]))]
            # back to back only with itself: two different notices in a row may share words at the seam
            name = rng.choice(names) if gap or not here else here[-1][0]
            n = len(decontaminate.words_of(licenses.TEMPLATES[name]))
            here.append((name, at + len(gap), at + len(gap) + n))
            parts += [*gap, licenses.TEMPLATES[name]]
            at += len(gap) + n
        truth[i] = here
        texts.append((i, " ".join(parts)))
    got = _rows(licenses.scan(spark.createDataFrame(texts, "doc_id int, text string")), "doc_id")
    for i, here in truth.items():
        assert [(m["template"], m["start"], m["end"]) for m in got[i]["matches"]] == here
        assert all(m["containment"] == 1.0 for m in got[i]["matches"])
    out = _rows(licenses.report(spark.createDataFrame(texts, "doc_id int, text string")), "doc_id")
    for i, here in truth.items():
        ids = sorted({name.split(":")[0] for name, _, _ in here})
        assert (out[i]["licenses"], out[i]["n_licenses"], out[i]["n_matches"]) == (",".join(ids), len(ids), len(here))


def test_license_equal_templates_and_ties():
    scanner = licenses.Scanner({"a": "one two three four five six", "b": "One two three four five six", "none": " . "})
    text = "one two three four five six one two three four five six"
    assert scanner.scan(text)[1] == [(name, at, at + 6, 1.0) for at in (0, 6) for name in ("a", "b")]
    assert scanner.scan(None) == (0, []) and scanner.scan("") == (0, [])


def test_license_lines_and_odd_rows(spark, odd, empty):
    docs = spark.createDataFrame([(1, "text\nReleased under the MIT License.\nmore"), (2, None), (3, "MIT License"), (4, "")], "doc_id int, text string")
    got = _rows(licenses.report(docs), "doc_id")
    assert got[1]["licenses"] == "MIT-line" and got[1]["containment"] == 1.0
    assert all(got[i]["n_licenses"] == 0 and got[i]["licenses"] == "" for i in (2, 3, 4))
    assert licenses.report(odd).count() == odd.count() and licenses.report(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.Scanner({"big": "w " * (licenses.MAX_TEMPLATE_WORDS + 1)})


def test_lines_alone_in_their_buckets_are_dealt_once(spark):
    from pyspark.sql import functions as F

    from migrata.llm import lines
    rows = [(1, [10, 20], 0, 0), (2, [10, 21], 0, 0), (3, [10, 22], 0, 5), (4, [11, 23], 0, 0), (5, [12, 20], -1 >> 4, 0), (6, [13, 24], 0, 0)]
    signatures = spark.createDataFrame(rows, "node long, keys array<long>, s1 long, s2 long")
    shared = lines._shared(signatures)
    assert {(r.key, r.node, r.centre) for r in shared.collect()} == {(10, 1, 3), (10, 2, 3), (10, 3, 3), (20, 1, 1), (20, 5, 1)}
    # lines 1 and 5 differ in all their sketched fields
    assert {(r.a, r.b) for r in lines._stars(shared).collect()} == {(1, 3), (2, 3)}
    sliced = [lines._shared(signatures, k, 2) for k in range(2)]
    assert sliced[0].unionAll(sliced[1]).exceptAll(shared).isEmpty() and sliced[0].count() + sliced[1].count() == 5
    # a line of another component: 2 contests 1 and 3, which are one component
    rooted = shared.withColumn("root", F.when(F.col("node") == 3, 1).otherwise(F.col("node")))
    assert {(r.key, r.node) for r in lines._contested(rooted).collect()} == {(10, 1), (10, 2), (10, 3)}
