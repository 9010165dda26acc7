"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into a bin; each feature has a lookup table of bin scores, and so
have a few pairs of features. The tables are learned by boosting shallow trees on one feature
after another in turns (log loss), then on the pairs that reduce the residual most. A score is
the logistic of the intercept plus one addition for each table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, hash_unit, relax, ship, small_batches, table

#: Labelled rows learned from at most (in expectation), bins of a feature, bins of a feature in a
#: pair, turns, step, pairs, and leaves of a tree.
SAMPLE, BINS, PAIR_BINS, TURNS, STEP, PAIRS, LEAVES = 20_000, 32, 8, 150, 0.2, 6, 4
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "upper", "lower", "digit", "line_feed", "sentence_mark", "symbol", "non_ascii", "word_length",
    "distinct_words", "top_word", "repeated_word", "bar_words", "marked_words", "shouted_words", "line_words",
    "distinct_lines", "distinct_triples",
)


def _byte_classes() -> np.ndarray:
    table = np.full(256, 6, np.uint8)  # symbols
    table[ord("A") : ord("Z") + 1] = 0
    table[ord("a") : ord("z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[10] = 3
    table[[9, 11, 12, 13, 32]] = 4
    table[[ord(c) for c in ".,;:'\"?!()-"]] = 5
    table[128:] = 7
    return table


_CLASSES = _byte_classes()


def features(text: str | None) -> list[float]:
    """The features of a whole text; a null text is an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=8) / n
    words = raw.split()
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2) if len(words) > 2 else 1.0
    marked = sum(v for w, v in counts.items() if len(w) > 1 and w[-1] == w[-2] and _CLASSES[w[-1]] >= 5 and w[-1] < 128)
    shouted = sum(v for w, v in counts.items() if len(w) > 1 and w.isupper())
    return [
        math.log1p(n), c[0], c[1], c[2], c[3], c[5], c[6], c[7], sum(map(len, words)) / m, len(counts) / m,
        max(counts.values(), default=0) / m, repeated / m, counts.get(b"|", 0) / m, marked / m, shouted / m,
        math.log1p(m / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), triples,
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree(grad: np.ndarray, weight: np.ndarray, leaves: int = LEAVES, ridge: float = 1.0) -> np.ndarray:
    """Best tree of few leaves on the ordered bins of a feature: greedy splits, a step for each bin."""
    cuts = [0, len(grad)]
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    while len(cuts) <= leaves:
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                at = np.arange(a + 1, b)
                value = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(np.argmax(value))
                best = max(best, (float(value[k]), int(at[k])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(grad))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges: quantiles of the distinct values and of all values."""
    both = np.concatenate([np.quantile(x, np.linspace(0, 1, bins // 2 + 1)[1:-1]), np.quantile(np.unique(x), np.linspace(0, 1, bins // 2 + 1)[1:-1])])
    return np.unique(both)


class Additive:
    """intercept, edges and tables of the features, and pairs (i, j, edges, edges, table)."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.intercept = math.log(rate / (1 - rate))
        self.edges, self.tables, self.pairs = [], [], []
        if not len(y):
            return
        f = np.full(len(y), self.intercept)
        self.edges = [_edges(c, BINS) for c in x.T]
        binned = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        for _ in range(TURNS):
            for t, b in zip(self.tables, binned, strict=True):
                p = _sigmoid(f)
                step = STEP * _tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)))
                t += step
                f += step[b]
        coarse = [_edges(c, PAIR_BINS) for c in x.T]
        small = [np.searchsorted(e, c, side="right") for e, c in zip(coarse, x.T, strict=True)]
        p = _sigmoid(f)
        gains = []
        for i, j in combinations(range(len(small)), 2):
            k, size = small[i] * (len(coarse[j]) + 1) + small[j], (len(coarse[i]) + 1) * (len(coarse[j]) + 1)
            g, h = np.bincount(k, y - p, size), np.bincount(k, p * (1 - p), size)
            gains.append((float((g**2 / (h + 1)).sum()), i, j))
        for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
            self.pairs.append((i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))))
        for _ in range(TURNS // 3):
            for i, j, _, _, t in self.pairs:
                p = _sigmoid(f)
                k = small[i] * t.shape[1] + small[j]
                g, h = np.bincount(k, y - p, t.size).reshape(t.shape), np.bincount(k, p * (1 - p), t.size).reshape(t.shape)
                # two levels: a split of the first feature, then the second in each part
                rows = np.cumsum(g.sum(1))[:-1] ** 2 / (np.cumsum(h.sum(1))[:-1] + 1)
                at = int(np.argmax(rows)) + 1 if len(rows) else t.shape[0]
                step = np.zeros(t.shape)
                for part in (slice(0, at), slice(at, t.shape[0])):
                    step[part] = STEP * _tree(g[part].sum(0), h[part].sum(0))
                t += step
                f += step.ravel()[k]

    def scores(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.intercept)
        for e, t, c in zip(self.edges, self.tables, x.T, strict=True) if self.tables else ():
            f += t[np.searchsorted(e, c, side="right")]
        for i, j, a, b, t in self.pairs:
            f += t[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return _sigmoid(f)


def learn(docs: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE) -> Additive:
    """Learn from a bounded sample: about `sample` labelled rows by a hash of doc_id, whole texts.

    labels: doc_id, quality. Null labels, and rows where held_out isn't false, teach nothing; a
    label of a missing document neither. A document teaches once, however many rows and labels it
    has: by its largest label and the least of its rows' features, so the sample bounds what is
    sent. The driver gets features of the sample, not texts.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    usable = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where(~held_out & F.col("y").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    total = usable.count()
    chosen = usable.where(hash_unit("doc_id") < min(1.0, sample / max(1, total)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows of 16 bytes

    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t) for t in texts])
        relax()

    got = rows.select("doc_id", measured("text").alias("x"), "y").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y")).toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    # the order of rows differs from run to run, sums must not
    order = np.lexsort([*x.T, got["y"].to_numpy(np.float64)])
    return Additive(x[order], got["y"].to_numpy(np.float64)[order])


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """Add score (0 to 1) from the whole text alone; a null text scores as an empty one, repeated rows
    score alike. A column named score is replaced."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    @F.pandas_udf("double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
            yield pd.Series(held.value.scores(x))
        relax()

    return docs.withColumn("score", judged(F.col("text")))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Score every document; a fifth of them, by crc32 of the id, teaches nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod("doc_id", 5) == 0
    model = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), held)
    out = score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
