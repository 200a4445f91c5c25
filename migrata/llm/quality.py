"""Quality classifier: a generalised additive model with pairwise interactions.

Every text is reduced to ``FEATURES`` (lengths, character classes, repetition), each feature is cut
into at most ``MAX_BINS`` quantile bins, and the log-odds of label 1 are a sum of lookup tables: one
table per feature and one per chosen feature pair.  The tables are learnt by cyclic gradient boosting:
rounds over the features, each adding one shallow tree on that feature alone, then rounds over the
pairs with the strongest remaining interaction, each adding a two-level tree on the pair.  Scoring adds
up table entries, vectorised over rows.

Scale: one pass over the texts writes the narrow feature table to shared storage; labels join that
table; at most about ``MAX_TRAIN_ROWS`` labelled rows (a hash sample of all of them, so the bound is
documented and the sample is not a prefix) reach the driver, where the tables are learnt; the model (some
kilobytes) travels to the tasks that score the feature table.  Neither labels nor language, source or id
are features.

Defined results: a null text has the features of the empty text; ids without label, labels without
document and null labels teach nothing; several labels of one id count by their mean, a tie is left out;
without two classes the score is the share of label 1 (0.5 without labels); equal texts get equal
scores; an empty table gives an empty table; only the id and the score columns are returned.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migrata.llm.common import col, fresh, map_texts, stored

FEATURES = (
    "log_chars", "log_words", "word_length", "upper_share", "digit_share", "space_share", "symbol_share", "odd_symbol_share",
    "exclamation_share", "non_ascii_share", "distinct_share", "repeat_share", "top_share", "bare_share", "closed_share",
    "caps_word_share", "log_lines", "line_length", "line_repeat_share", "stop_share",
)
MAX_TRAIN_ROWS = 40_000
MAX_BINS = 32
ROUNDS = 150
PAIRS = 8
PAIR_ROUNDS = 40
RATE = 0.15
LEAF_ROWS = 5
RIDGE = 1.0

_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a"):ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0"):ord("9") + 1] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'\"-?()"]] = True
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL, _SYMBOL & ~_PLAIN, _HIGH]).astype(np.float64)


def features(text: str | None) -> list[float]:
    """The features of one whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(raw), 1)
    histogram = np.bincount(raw, minlength=256)
    upper, lower, digit, space, symbol, odd, high = _CLASSES @ histogram
    words = text.split()
    k = max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    n_lines = max(len(lines), 1)
    top = max(counts.values()) if counts else 0
    return [
        math.log1p(len(text)), math.log1p(len(words)), sum(map(len, words)) / k,
        upper / max(upper + lower, 1), digit / n, space / n, symbol / n, odd / n, float(histogram[33]) / n, high / n,
        len(counts) / k, sum(map(eq, words, words[1:])) / k, top / k,
        sum(c for w, c in counts.items() if not any(map(str.isalnum, w))) / k,
        sum(c for w, c in counts.items() if w[-1] in ".!?") / k,
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / k,
        math.log1p(len(lines)), math.log1p(len(text) / n_lines), 1 - len(set(lines)) / n_lines,
        sum(c for w, c in counts.items() if len(w) <= 3) / k,
    ]


@dataclass(frozen=True)
class Model:
    """Lookup tables: ``cuts`` per feature, one value per bin, and one value per bin pair of a pair."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row of features: table entries added up."""
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            z += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            z += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[int, float]:
    """Best cut of a row of bins into two: (bins on the left, gain); (0, 0) if none helps."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gt, ht, nt = g.sum(), h.sum(), n.sum()
    gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
    gain = np.where((nl >= LEAF_ROWS) & (nt - nl >= LEAF_ROWS), gain, 0)
    if not len(gain) or gain.max() <= 1e-9:
        return 0, 0.0
    at = int(gain.argmax())
    return at + 1, float(gain[at])


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + RIDGE))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves on one feature, as a value per bin."""
    out = np.zeros(len(g))
    at, _ = _split(g, h, n)
    if not at:
        return out
    sides = [slice(0, at), slice(at, len(g))]
    more = [_split(g[s], h[s], n[s]) for s in sides]
    best = max((0, 1), key=lambda i: more[i][1])
    if more[best][0]:
        s = sides.pop(best)
        sides += [slice(s.start, s.start + more[best][0]), slice(s.start + more[best][0], s.stop)]
    for s in sides:
        out[s] = _leaf(g[s], h[s])
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Two levels on a pair of features (first one, then the other on either side), as a value per cell, and its gain."""
    best, gain = np.zeros_like(g), 0.0
    for flip in (False, True):
        G, H, N = (x.T if flip else x for x in (g, h, n))
        at, first = _split(G.sum(1), H.sum(1), N.sum(1))
        cuts = [(slice(0, at), slice(at, len(G)))] if at else [(slice(0, len(G)),)]
        value, total = np.zeros_like(G), first
        for s in cuts[0]:
            k, second = _split(G[s].sum(0), H[s].sum(0), N[s].sum(0))
            total += second
            for t in ((slice(0, k), slice(k, G.shape[1])) if k else (slice(0, G.shape[1]),)):
                value[s, t] = _leaf(G[s, t], H[s, t])
        if total > gain:
            best, gain = (value.T if flip else value), total
    return best, gain


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, n_pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS,
        max_bins: int = MAX_BINS, rate: float = RATE) -> Model:
    """Cyclic boosting of ``x`` (rows by features) against 0/1 labels ``y``."""
    n_features = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        return Model(math.log(p / (1 - p)), [np.empty(0)] * n_features, [np.zeros(1)] * n_features, [], [])
    cuts = []
    for j in range(n_features):
        distinct = np.unique(x[:, j])
        marks = np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1], method="lower"))
        # a cut lies halfway to the next larger value seen, so equal values never straddle it
        nxt = np.searchsorted(distinct, marks, side="right")
        cuts.append(np.unique([(m + distinct[k]) / 2 for m, k in zip(marks, nxt) if k < len(distinct)]))
    base = math.log(y.mean() / (1 - y.mean()))
    model = Model(base, cuts, [np.zeros(len(c) + 1) for c in cuts], [], [])
    b = model.bins(x)
    z = np.full(len(y), base)

    def grads():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    sizes = [np.bincount(b[:, j], minlength=len(cuts[j]) + 1) for j in range(n_features)]
    for _ in range(rounds):
        for j in range(n_features):
            m = len(cuts[j]) + 1
            if m < 2:
                continue
            g, h = grads()
            step = rate * _tree(np.bincount(b[:, j], g, m), np.bincount(b[:, j], h, m), sizes[j])
            model.tables[j][:] += step
            z += step[b[:, j]]
    # pairs by the gain of one tree on what the features alone leave over
    g, h = grads()
    cells = {}
    ranked = []
    for i in range(n_features):
        for j in range(i + 1, n_features):
            shape = (len(cuts[i]) + 1, len(cuts[j]) + 1)
            if min(shape) < 2:
                continue
            at = b[:, i] * shape[1] + b[:, j]
            parts = [np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (g, h, np.ones(len(y)))]
            ranked.append((-_pair_tree(*parts)[1], i, j))
    for _, i, j in sorted(ranked)[:n_pairs]:
        shape = (len(cuts[i]) + 1, len(cuts[j]) + 1)
        at = b[:, i] * shape[1] + b[:, j]
        cells[i, j] = (shape, at, np.bincount(at, minlength=shape[0] * shape[1]).reshape(shape).astype(float))
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros(shape))
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            shape, at, n = cells[i, j]
            g, h = grads()
            step, _ = _pair_tree(np.bincount(at, g, n.size).reshape(shape), np.bincount(at, h, n.size).reshape(shape), n)
            model.pair_tables[k][:] += rate * step
            z += rate * step.ravel()[at]
    return model


def held_out(id_column: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 1 when divided by 3 (a null id is not held out)."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def featurize(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and ``features``, an array in the order of ``FEATURES``."""
    def make():
        return lambda texts: ([features(t) for t in texts],)

    return map_texts(docs, keep, [col(text_col)], [T.StructField("features", T.ArrayType(T.DoubleType(), False))], make)


def train(featured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
          max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """The model of the labelled rows that are not held out (at most about ``max_rows`` of them)."""
    truth = (labels.select(col(id_col).alias("__id"), col(label_col).cast("double").alias("__y"))
             .where(F.col("__id").isNotNull() & F.col("__y").isNotNull())
             .groupBy("__id").agg(F.avg("__y").alias("__y")).where("__y <> 0.5"))
    rows = (featured.select(col(id_col).alias("__id"), F.col("features")).where(~held_out(F.col("__id")))
            .join(truth, "__id").select("__id", "features", (F.col("__y") > 0.5).cast("int").alias("__y")))
    n = truth.where(~held_out(F.col("__id"))).count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    got = rows.select("features", "__y").toPandas()
    x = np.array(got["features"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES))
    return fit(x, got["__y"].to_numpy(dtype=np.float64))


def score(featured: DataFrame, model: Model, keep: list[Column]) -> DataFrame:
    """The ``keep`` columns and ``score``, the probability of label 1."""
    def make():
        def work(rows):
            x = np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))
            return (model.score(x).tolist(),)
        return work

    return map_texts(featured, keep, [F.col("features")], [T.StructField("score", T.DoubleType())], make)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Every document's id, ``held_out``, ``score`` and ``predicted`` (1 from a score of 0.5)."""
    featured = stored(featurize(docs, [col(id_col)], text_col), "features")
    model = train(featured, labels, id_col, label_col, max_rows)
    return score(featured, model, [col(id_col)]).select(
        col(id_col), held_out(col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
           max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """``docs`` without the documents that score below 0.5; texts are read twice, never shuffled."""
    featured = stored(featurize(docs.where(~held_out(col(id_col))), [col(id_col)], text_col), "features")
    model = train(featured, labels, id_col, label_col, max_rows)

    def make():
        def work(texts):
            x = np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))
            return ((model.score(x) >= 0.5).tolist(),)
        return work

    flag = fresh(docs, "__keep")
    out = map_texts(docs, [col(c) for c in docs.columns], [col(text_col)], [T.StructField(flag, T.BooleanType())], make)
    return out.where(col(flag)).drop(flag)
