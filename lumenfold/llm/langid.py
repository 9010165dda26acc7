"""Language ID by rank-order profiles.

A profile is a language's most frequent letter n-grams (orders 1 to 3, words padded by a
boundary) in order of frequency. A document is given the language whose profile has the smallest
out-of-place distance: the sum over the document's own most frequent n-grams of the difference of
ranks, or the profile's length where the profile lacks the n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_mod, hash_unit, relax, ship, small_batches, table

#: Profile length, documents sampled for each language at most (in expectation), and the distance by
#: which confidence falls by a factor of e.
PROFILE, SAMPLE, TEMPERATURE = 400, 600, 0.02
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _LETTER.append(table)
    return _LETTER[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, ascending, and their counts. An n-gram is up to three code
    points of 21 bits; 1 stands for a word's boundary."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    sym = np.ones(len(cp) + 2, np.int64)
    sym[1:-1] = np.where(_letters()[cp], cp, 1)
    gap = sym == 1
    keep = np.ones(len(sym), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    s = sym[keep]
    if len(s) < 2:
        return s[:0], s[:0]
    two = (s[:-1] << 21) | s[1:]
    three = (two[:-1] << 21) | s[2:]
    return np.unique(np.concatenate([s[s > 1], two, three[s[1:-1] > 1]]), return_counts=True)


def _top(keys: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent, ties to the smaller key; keys are ascending."""
    if len(keys) > 2 * k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        held = counts >= least
        keys, counts = keys[held], counts[held]
    return keys[np.argsort(-counts, kind="stable")[:k]]


class Profiles:
    """Ranks of n-grams by language: ranks[i, j] is the rank of keys[j] in language i."""

    def __init__(self, ranked: dict[str, list[int]], length: int = PROFILE) -> None:
        self.length, self.languages = length, sorted(ranked)
        self.keys = np.array(sorted({k for ks in ranked.values() for k in ks}), np.int64)
        self.ranks = np.full((len(self.languages), len(self.keys)), -1, np.int32)
        for i, lang in enumerate(self.languages):
            ks = ranked[lang][:length]
            self.ranks[i, np.searchsorted(self.keys, ks)] = np.arange(len(ks))

    def distances(self, text: str) -> np.ndarray | None:
        """Out-of-place distance to each language, over its largest value; None without letters."""
        top = _top(*ngrams(text), self.length)
        if not len(top) or not len(self.languages):
            return None
        at = np.minimum(np.searchsorted(self.keys, top), len(self.keys) - 1)
        rank = np.where(self.keys[at] == top, self.ranks[:, at], -1)
        out = np.where(rank >= 0, np.abs(rank - np.arange(len(top))), self.length)
        return out.sum(1) / (len(top) * self.length)

    def predict(self, text: str | None) -> tuple[str, float]:
        d = None if text is None else self.distances(text)
        if d is None:
            return UNKNOWN, 0.0
        best = int(np.argmin(d))
        return self.languages[best], float(1 / np.exp((d[best] - d) / TEMPERATURE).sum())


def learn(docs: DataFrame, held_out: Column, length: int = PROFILE, sample: int = SAMPLE) -> Profiles:
    """Profiles from the whole texts of a bounded sample: about `sample` labelled documents of each
    language, by a hash of doc_id; every language that a row names is learned. Rows with null text
    or lang, or where held_out isn't false, teach nothing; a repeated row teaches as often as it
    occurs. What reaches the driver is one list of `length` n-grams for each language."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share"))
    chosen = rows.select("doc_id", "lang", "text").join(F.broadcast(sizes), "lang")  # a number for each language
    chosen = chosen.where(hash_unit("doc_id") < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                held.setdefault(lang, []).append(ngrams(text))
        for lang, parts in held.items():
            keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)
            yield pd.DataFrame({"lang": lang, "key": keys, "n": n})

    counts = chosen.mapInPandas(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
    ranked: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "key", "rank").collect(), key=lambda r: r["rank"]):
        ranked.setdefault(r["lang"], []).append(r["key"])
    return Profiles(ranked, length)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Add lang_pred and score (0 to 1); columns of these names are replaced.

    Repeated rows are judged alike. Null text, and text without a letter: und and 0. Equal distances: the language first in order
    of name. Only text is read for the prediction; without profiles every language is und.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(profiles)  # PROFILE ranks for each language

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score"])
        relax()

    out = docs.withColumn("__judged", judge(F.col("text")))
    return out.withColumn("lang_pred", F.col("__judged.lang_pred")).withColumn("score", F.col("__judged.score")).drop("__judged")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Predict the language of every document; a third of them, by crc32 of the id, teaches nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod("doc_id", 3) == 1
    out = predict(docs.select("doc_id", "text", held.alias("held_out")), learn(docs, held))
    return out.select("doc_id", "held_out", "lang_pred", "score")
