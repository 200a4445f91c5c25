"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are the runs of digits, a-z and non-ASCII characters of the text with A-Z lower-cased.  All
items go into one generalised suffix automaton over words; the words of a document are streamed
through it, and at each word the automaton knows the length of the longest match ending there.  A
match of ``window`` words or more hits its last ``window`` words; an item shorter than the window
counts as one window of its own length.

``scan`` reports hits, ``remove`` cuts the hit spans out and drops documents of which more than a
share is hit.

Scale: documents are mapped in place, without a shuffle.  Each automaton holds at most about
``CHUNK_WORDS`` item words (one item longer than that is cut into parts that overlap by a window
less one word), so what a task holds does not grow with the benchmark; a larger benchmark gives
several automata, and for each the documents are read and the finds alone kept, by the hash of their text; the finds
of all automata meet in one aggregate.  The item words of the chunks are the only thing that travels from the driver to the
tasks.

Defined results: a null or empty text has no words and no hits; null or wordless items never match;
items with equal texts all count; repeated item rows count once (``items`` are distinct ids); an item
without id hits but is not listed; documents of any length are streamed whole; empty tables give
empty results; only the id (``scan``) or all columns (``remove``) are returned.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migrata.llm.common import col, fresh, map_texts, stored

WINDOW = 10
CHUNK_WORDS = 100_000
MAX_COVERAGE = 0.5
# lower-casing and matching run on UTF-8 bytes: bytes.lower() changes A-Z alone
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType(), False))]


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class SuffixAutomaton:
    """All factors of several word sequences, with the items that hold each window."""

    def __init__(self, items: Sequence[tuple[str | None, Sequence[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for key, words in items if words]
        for _, seq in coded:
            last = 0
            for symbol in seq:
                last = self._append(last, symbol)
        # class of the suffix of a given length -> items; shorter items apart
        self.holders: dict[int, set[str]] = {}
        own: dict[int, dict[int, set[str]]] = {}
        for key, seq in coded:
            state = 0
            named = {key} - {None}
            for i, symbol in enumerate(seq):
                state = self.next[state][symbol]
                if i + 1 >= window:
                    self.holders.setdefault(self._of_length(state, window), set()).update(named)
            if len(seq) < window:
                own.setdefault(self._of_length(state, len(seq)), {}).setdefault(len(seq), set()).update(named)
        self.least = min([window, *(n for by in own.values() for n in by)])
        # short items that end at a state: those of the state and of its suffix links
        self.short: list[list[tuple[int, set[str]]]] = [[] for _ in self.link]
        if own:
            for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                above = self.short[self.link[state]]
                mine = list(own.get(state, {}).items())
                self.short[state] = above + mine if mine else above

    def _append(self, last: int, symbol: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        there = nxt[last].get(symbol)
        if there is not None and length[there] == length[last] + 1:
            return there
        if there is not None:
            return self._split(last, there, symbol)
        new = self._state({}, 0, length[last] + 1)
        p = last
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, symbol)
        return new

    def _split(self, p: int, q: int, symbol: int) -> int:
        """A state for the factors of ``q`` up to the length that ``p`` extends to."""
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _state(self, out: dict[int, int], link: int, length: int) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _of_length(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def scan(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (first word, past the last word; merged, ascending) and the items found."""
        nxt, link, length, short, window, least = self.next, self.link, self.length, self.short, self.window, self.least
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        classes: set[int] = set()
        state = matched = 0

        def hit(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))

        for i, symbol in enumerate(map(self.vocabulary.get, words)):
            if symbol is None:
                state = matched = 0
                continue
            to = nxt[state].get(symbol)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(symbol)
            state = to or 0
            if not state:
                matched = 0
                continue
            matched += 1
            if matched < least:
                continue
            if matched >= window:
                hit(i + 1 - window, i + 1)
                classes.add(self._of_length(state, window))
            for n, keys in short[state]:
                if n <= matched:
                    hit(i + 1 - n, i + 1)
                    found |= keys
        for c in classes:
            found |= self.holders.get(c, set())
        return spans, found


def _chunks(items: DataFrame, id_col: str, text_col: str, window: int, chunk_words: int):
    """The items in lists of (id, words) of about ``chunk_words`` words each, one list on the driver at a time."""
    rows = items.select(col(id_col).cast("string").alias("k"), col(text_col).alias("t")).where(F.col("t").isNotNull())
    # a word needs a byte and a separator, so bytes / 2 + 1 bounds the words without a Python pass
    bound = F.expr("octet_length(t) div 2 + 1")
    total = rows.agg(F.sum(bound)).first()[0] or 0
    n = max(1, -(-2 * total // chunk_words)) if total > chunk_words else 1
    rows = rows.distinct()
    for i in range(n):
        part = rows if n == 1 else rows.where(F.expr(f"pmod(xxhash64(k, t), {n}) = {i}"))
        chunk: list[tuple[str | None, list[bytes]]] = []
        held = 0
        for row in part.toLocalIterator():
            words = words_of(row["t"])
            step = max(chunk_words - window + 1, 1)
            for start in range(0, max(len(words) - window + 1, 1), step):
                piece = words[start:start + step + window - 1]
                if chunk and held + len(piece) > chunk_words:
                    yield chunk
                    chunk, held = [], 0
                chunk.append((row["k"], piece))
                held += len(piece)
        if chunk:
            yield chunk


_built: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, chunk, window: int) -> SuffixAutomaton:
    """The automaton of a chunk, built once per Python worker; one is kept."""
    if key not in _built:
        _built.clear()
        _built[key] = SuffixAutomaton(chunk.value, window)
    return _built[key]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _passes(items: DataFrame, item_id: str, item_text: str, window: int, chunk_words: int):
    """(key, broadcast chunk) of every automaton."""
    sc = items.sparkSession.sparkContext
    out = []
    for chunk in _chunks(items, item_id, item_text, window, chunk_words):
        b = sc.broadcast(chunk)
        out.append((f"{sc.applicationId}-{id(b)}-{len(out)}-{window}-{b._jbroadcast.id() if b._jbroadcast else 0}", b))
    return out


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Per document: the id, ``n_words``, ``spans`` (hit word ranges) and ``items`` (ids of items with an occurring window)."""
    passes = _passes(items, item_id, item_text, window, chunk_words)
    keep = [col(id_col)]
    if len(passes) <= 1:
        def make():
            a = _automaton(passes[0][0], passes[0][1], window) if passes else None

            def work(texts):
                words = [words_of(t) for t in texts]
                got = [a.scan(w) if a else ([], set()) for w in words]
                return [len(w) for w in words], [_as_rows(s) for s, _ in got], [sorted(k) for _, k in got]
            return work

        return map_texts(docs, keep, [col(text_col)], FOUND, make)
    # beyond one automaton the finds come back by the hash of the text; what is shuffled is as narrow as they are
    def counted():
        return lambda texts: ([len(words_of(t)) for t in texts],)

    names = [fresh(docs, f"__{x}") for x in ("a", "b")]
    rows = map_texts(docs, [*keep, *(h.alias(n) for h, n in zip(_hashes(text_col), names))], [col(text_col)], FOUND[:1], counted)
    found = _found(docs, text_col, passes, window)
    joined = rows.join(found, (col(names[0]) == F.col("h1")) & (col(names[1]) == F.col("h2")), "left")
    return joined.select(*keep, "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _hashes(text_col: str) -> list:
    return [F.xxhash64(col(text_col)), F.hash(col(text_col), F.lit(1))]


def _found(docs: DataFrame, text_col: str, passes, window: int) -> DataFrame:
    """(h1, h2, spans, items): the finds of all automata per text that has any, by two hashes of the text."""
    h1, h2 = _hashes(text_col)
    parts = None
    for key, chunk in passes:
        def make(key=key, chunk=chunk):
            a = _automaton(key, chunk, window)

            def work(texts):
                got = [a.scan(words_of(t)) for t in texts]
                return [_as_rows(s) for s, _ in got], [sorted(k) for _, k in got]
            return work

        one = map_texts(docs, [h1.alias("h1"), h2.alias("h2")], [col(text_col)], FOUND[1:], make).where(F.size("spans") > 0)
        parts = one if parts is None else parts.unionByName(one)
    # equal texts have equal finds, which collapse map-side
    each = parts.groupBy("h1", "h2").agg(F.flatten(F.collect_set("spans")).alias("all"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))

    def joined():
        return lambda spans, items: ([_as_rows(_merged([(x["start"], x["end"]) for x in s])) for s in spans], [sorted(i) for i in items])

    return stored(map_texts(each, [F.col("h1"), F.col("h2")], [F.col("all"), F.col("items")], FOUND[1:], joined), "found")


def _as_rows(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in spans]


def cut(text: str, spans: Sequence[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.lower())]
    out, start = [], 0
    for a, b in spans:
        out.append(raw[start:at[a][0]])
        start = at[b - 1][1]
    out.append(raw[start:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
           window: int = WINDOW, max_coverage: float = MAX_COVERAGE, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``docs`` with every hit span cut out of the text, and without the documents of which more than
    ``max_coverage`` of the words is hit.  Cutting goes on until no window is left, also where it joins words.

    Every round finds the hits of all automata before anything is cut, so the result is the same however many
    there are; the coverage is that of the words as given (first round)."""
    passes = _passes(items, item_id, item_text, window, chunk_words)
    if not passes:
        return docs
    plain = [col(c) for c in docs.columns]
    text, mark = fresh(docs, "__text"), fresh(docs, "__mark")

    def over(spans, words) -> bool:
        return sum(b - a for a, b in spans) > max_coverage * len(words)

    def replaced(done: DataFrame) -> DataFrame:
        return done.select(*[col(text).alias(c) if c == text_col else col(c) for c in docs.columns])

    others = [c for c in docs.columns if c != text_col]
    fields = [T.StructField(text, T.StringType()), T.StructField(mark, T.BooleanType())]
    if len(passes) == 1:
        def make_all(key=passes[0][0], chunk=passes[0][1]):
            a = _automaton(key, chunk, window)

            def clean(t):
                words = words_of(t)
                spans, _ = a.scan(words)
                if over(spans, words):
                    return t, False
                while spans:
                    t = cut(t, spans)
                    spans, _ = a.scan(words_of(t))
                return t, True

            def work(texts):
                got = [clean(t) for t in texts]
                return [t for t, _ in got], [k for _, k in got]
            return work

        return replaced(map_texts(docs, [col(c) for c in others], [col(text_col)], fields, make_all).where(col(mark)))

    now, clean_rows, first = docs, [], True
    while True:
        names = [fresh(now, f"__{x}") for x in ("a", "b", "spans")]
        finds = _found(now, text_col, passes, window).select("h1", "h2", "spans").toDF(*names)
        here = _hashes(text_col)
        found = now.join(finds, (here[0] == col(names[0])) & (here[1] == col(names[1])), "left").select(
            *plain, F.coalesce(col(names[2]), F.array().cast(SPANS)).alias(mark))
        found = stored(found, "hits")
        clean_rows.append(found.where(F.size(col(mark)) == 0).select(*plain))
        hit = found.where(F.size(col(mark)) > 0)
        if hit.isEmpty():
            break

        def make_cut(first=first):
            def work(texts, spans):
                at = [[(x["start"], x["end"]) for x in s] for s in spans]
                return [cut(t, s) for t, s in zip(texts, at)], [not (first and over(s, words_of(t))) for t, s in zip(texts, at)]
            return work

        now = replaced(stored(map_texts(hit, [col(c) for c in others], [col(text_col), col(mark)], fields, make_cut).where(col(mark)), "cut"))
        first = False
    out = clean_rows[0]
    for rows in clean_rows[1:]:
        out = out.union(rows)
    return out


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The digest of ``scan``: word, hit and item counts, a digest of the item ids, and the verdict."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return scan(docs, items, id_col, **kw).select(
        col(id_col), "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
