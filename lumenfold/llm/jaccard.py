"""Near duplicates by Jaccard similarity of word shingles.

A text is the set of its five-word shingles; two texts are near duplicates if their sets have a
similarity of 4/5 or more. Texts whose SimHash fingerprints (of these shingles) are linked over blocks
are candidates; fingerprints of texts at 4/5 differ in more bits than blocks can cover, so for the
rest sets meet in lists: a set has 160 min-hashes in 40 bands of four, and
sets with an equal band are candidates. Two sets of similarity s share no band with probability
(1 - s^4)^40, which is 7e-10 at 0.8 and falls steeply above. Every link is verified on the whole
sets, shingled anew from the texts, so no table of shingles is ever written.

Within a list all sets are first held against a few centres, the same ones in most lists. Lists
that still hold several groups are put together to families, each text once, and what lies outside
a family's largest group is compared with all of it inside a task, which gives a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, relax, ship, sifted, small_batches
from .components import connected_components

WORDS, SEED = 5, 42
#: Similarity, as a fraction of whole numbers.
UP, DOWN = 4, 5
#: Bands and min-hashes of a band.
BANDS, ROWS = 40, 4
#: Centres of a list; texts that one centre meets in a task; shingles that a task keeps while it
#: verifies; shingles of a tile (in expectation).
CENTRES, MEET, KEEP, ELEMENTS = 4, 4000, 2_000_000, 2_000_000
#: Texts with a word; white space as bytes.split() sees it.
_WORD = r"[^\x20\x09-\x0D]"
_MANY = 1 << 11


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of a text's shingles, A-Z lower-cased. Fewer words: the whole
    sequence; none, or null: empty."""
    import xxhash

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.array([], np.int64)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws))) + np.arange(len(ws))
    k = min(words, len(ws))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ws) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    return np.unique(h.view(np.int64))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd[:, None], rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None]


_FACTOR, _SHIFT = _functions()


def bands(members: np.ndarray) -> np.ndarray:
    """A key for each band of a set that isn't empty: the hash of its number and its min-hashes."""
    import xxhash

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    h = members.view(np.uint64)
    for i in range(0, len(h), _MANY):
        np.minimum(least, (_FACTOR * h[None, i : i + _MANY] + _SHIFT).min(1), out=least)
    raw, size = least.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[b * size : (b + 1) * size], b) for b in range(BANDS)], np.uint64).view(np.int64)


def set_fingerprint(members: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set: a bit is 1 if set in over half of its members."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(members), _MANY):
        ones += np.unpackbits(members[i : i + _MANY].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(members)).astype(np.uint8), bitorder="little").view("<i8")[0])


def _name(text):
    return F.xxhash64(text)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with th: a number for each different text, 0 for all texts without a word. It is a hash of
    64 bits, or of both hashes where a second one of 64 bits tells texts of one hash apart."""
    some, other = F.col("text").rlike(_WORD), F.xxhash64("text", F.lit(SEED))
    rows = docs.withColumn("th", F.when(some, _name(F.col("text"))).otherwise(F.lit(0).cast("long")))
    apart = rows.where(some).select("th", other.alias("other")).groupBy("th").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    clash = materialize(apart.where("lo <> hi or th = 0").select(F.col("th").alias("__clash")), "clashes")
    if clash.isEmpty():
        return rows
    marked = rows.join(clash, some & (rows["th"] == clash["__clash"]), "left")
    return marked.withColumn("th", F.when(F.col("__clash").isNotNull(), F.xxhash64("th", other)).otherwise(F.col("th"))).drop("__clash")


def band_rows(texts: DataFrame) -> DataFrame:
    """(th, n, fp, keys) of each different text with a word: number of its shingles, their SimHash
    fingerprint and its band keys; texts: th, text."""
    ship(texts.sparkSession)
    small_batches(texts.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # saves work on copies; the texts are made distinct behind
        for b in batches:
            out = []
            for th, text in zip(b["th"].tolist(), b["text"], strict=True):
                if th in seen:
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add(th)
                s = shingles(text)
                out.append((th, len(s), set_fingerprint(s), bands(s)))
            yield pd.DataFrame(out, columns=["th", "n", "fp", "keys"])
        relax()

    rows = texts.where("th <> 0").select("th", "text").mapInPandas(of, "th long, n int, fp long, keys array<long>")
    return rows.dropDuplicates(["th"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DOWN * both >= UP * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, meet: int = MEET) -> DataFrame:
    """Pairs (a, b) whose texts are near; pairs: a, b, distinct; texts: th, text, distinct th.

    a's text is sent once for each `meet` of its partners, each partner's once a pair; a task holds
    the shingles of one a at a time.
    """
    ship(pairs.sparkSession)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / meet).cast("int").alias("parts"))
    others = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    others = others.join(texts.select(F.col("th").alias("b"), "text"), "b").select("a", "part", F.lit(1).alias("kind"), "b", "text")
    hubs = parts.join(texts.select(F.col("th").alias("a"), "text"), "a")
    hubs = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("a").alias("b"), "text")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, known, size = np.array([], np.int64), {}, 0

        def members(th: int, text: str) -> np.ndarray:
            nonlocal size
            if th not in known:
                if size > KEEP:
                    known.clear()
                    size = 0
                known[th] = shingles(text)
                size += len(known[th])
            return known[th]

        for b in batches:
            left, right = [], []
            for a, kind, th, text in zip(b["a"].tolist(), b["kind"].tolist(), b["b"].tolist(), b["text"], strict=True):
                if kind == 0:
                    hub = members(th, text)
                elif similar(hub, members(th, text)):
                    left.append(a), right.append(th)
            yield pd.DataFrame({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})
        relax()

    rows = others.unionAll(hubs).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    return rows.mapInPandas(near, "a long, b long")


def _families(labelled: DataFrame, elements: int) -> DataFrame:
    """(family, tiles, label, main, th): the texts of lists with several labels; labels that meet in a
    list are one family, main is its most frequent one, and a tile has about `elements` shingles.
    labelled: key, th, n, label."""
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", "lo")
    rows = materialize(labelled.join(mixed, "key").select("th", "n", "label", "lo").distinct(), "mixed")
    met = connected_components(rows, "label", "lo").withColumnRenamed("node", "label")
    named = rows.select("th", "n", "label").distinct().join(met, "label", "left").withColumn("family", F.coalesce("component", "label"))
    sizes = named.groupBy("family", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    sizes = sizes.groupBy("family").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.ceil(F.sum("s") / elements).cast("int").alias("tiles"))
    out = materialize(named.join(sizes, "family").select("family", "tiles", "label", "main", "th"), "families")
    for used in (rows, met):
        discard(used)
    return out


def joined(sets: list[np.ndarray], label: np.ndarray, rest: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges between near sets of different labels that join all which such pairs join, one of each
    pair being a set of `rest` (numbers). label is changed. Shared members are counted exactly, by
    an inverted index, and an edge goes to each label only once."""
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    by = owner[np.argsort(code, kind="stable")]  # sets of each member, member by member
    ends = np.cumsum(np.bincount(code))
    at = np.concatenate([[0], np.cumsum(n)])
    left, right = [], []
    for x in rest.tolist():
        c = code[at[x] : at[x + 1]]
        k = ends[c] - np.where(c, ends[c - 1], 0)
        where = np.repeat(ends[c] - np.cumsum(k), k) + np.arange(int(k.sum()))
        both = np.bincount(by[where], minlength=len(sets))
        near = np.flatnonzero((DOWN * both >= UP * (n[x] + n - both)) & (label != label[x]))
        if len(near):
            met, first = np.unique(label[near], return_index=True)
            left += [x] * len(met)
            right += near[first].tolist()
            label[np.isin(label, met)] = label[x]
    return left, right


def _edges(families: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) between near texts of different labels in a family. A task holds a tile of all its
    texts and a tile of those outside the main label."""
    ship(families.sparkSession)
    mine = F.pmod(F.xxhash64("th"), "tiles").cast("int")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    rows = families.join(texts, "th").withColumn("mine", mine)
    host = rows.select("family", F.explode(every).alias("i"), F.col("mine").alias("j"), "th", "label", "main", "text", F.lit(False).alias("guest"))
    guest = rows.where("label <> main").select("family", F.col("mine").alias("i"), F.explode(every).alias("j"), "th", "label", "main", "text", F.lit(True).alias("guest"))
    group = ["family", "i", "j"]
    runs = host.unionAll(guest.where("i <> j")).repartition(*group).sortWithinPartitions(*group)

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        run = None

        def found() -> pd.DataFrame:
            th = np.array([h[0] for h in held], np.int64)
            label, main, guests = (np.array([h[k] for h in held]) for k in (1, 2, 3))
            rest = np.flatnonzero(guests if guests.any() or run[1] != run[2] else label != main)
            l, r = joined([h[4] for h in held], label, rest)
            return pd.DataFrame({"a": th[np.array(l, int)], "b": th[np.array(r, int)]})

        for b in batches:
            names = zip(b["family"].tolist(), b["i"].tolist(), b["j"].tolist(), strict=True)
            for name, th, label, main, is_guest, text in zip(names, b["th"].tolist(), b["label"].tolist(), b["main"].tolist(), b["guest"].tolist(), b["text"], strict=True):
                if name != run and held:
                    yield found()
                    held = []
                run = name
                held.append((th, label, main, is_guest, shingles(text)))
        if held:
            yield found()
        relax()

    return runs.mapInPandas(edges, "a long, b long")


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) of texts to be verified by SimHash: of equal fingerprints each with the first, and the first
    ones of fingerprints that blocks link (a spanning forest). sets: th, n, fp, th distinct."""
    from .simhash import near_edges

    firsts = materialize(sets.groupBy("fp").agg(F.min(F.struct("th", "n")).alias("f")), "firsts")
    edges = materialize(near_edges(firsts.select(F.col("fp").alias("fingerprint"))).distinct(), "links")
    end = lambda c: firsts.select(F.col("fp").alias(c), F.col("f").alias(f"f{c}"))
    linked = edges.join(end("a"), "a").join(end("b"), "b").select(F.col("fa").alias("x"), F.col("fb").alias("y"))
    equal = sets.join(firsts, "fp").where("th <> f.th").select(F.col("f").alias("x"), F.struct("th", "n").alias("y"))
    pairs = linked.unionAll(equal).where(DOWN * F.least("x.n", "y.n") >= UP * F.greatest("x.n", "y.n"))
    out = materialize(pairs.select(F.col("x.th").alias("a"), F.col("y.th").alias("b")), "by-print")
    for used in (firsts, edges):
        discard(used)
    return out


def near_texts(texts: DataFrame, elements: int = ELEMENTS) -> DataFrame:
    """(th, component) of every text that is near another: the components of all near pairs.

    texts: th, text; repeated th count once; a th of 0 is left out.
    """
    sets = materialize(band_rows(texts), "bands")
    rows = sets.select("th", "n", F.explode("keys").alias("key"))
    lists = rows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    shared = materialize(rows.join(lists, "key"), "shared")
    heads = [F.min(F.struct(F.xxhash64("th", F.lit(i)).alias("o"), "th", "n")).alias(f"c{i}") for i in range(CENTRES)]
    centres = shared.groupBy("key").agg(*heads).select("key", F.explode(F.array_distinct(F.array(*[F.struct(f"c{i}.th", f"c{i}.n") for i in range(CENTRES)]))).alias("c"))
    meet = shared.join(centres, "key").where("th <> c.th")
    meet = meet.where(DOWN * F.least("n", "c.n") >= UP * F.greatest("n", "c.n"))
    # two centres may meet each other either way round
    printed = fingerprint_pairs(sets.select("th", "n", "fp"))
    star = meet.select(F.col("c.th").alias("a"), F.col("th").alias("b")).unionAll(printed).groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"))
    star = materialize(star.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")), "star")
    named = star.select(F.col("a").alias("th")).unionAll(star.select(F.col("b").alias("th")))
    first = materialize(verified(star, _needed(texts, named)), "stars")
    parts = connected_components(first, "a", "b")
    labelled = shared.join(parts.withColumnRenamed("node", "th"), "th", "left").withColumn("label", F.coalesce("component", "th")).drop("component")
    families = _families(labelled, elements)
    rest = materialize(_edges(families, _needed(texts, families.select("th"))), "near")
    out = materialize(connected_components(first.unionAll(rest), "a", "b").withColumnRenamed("node", "th"), "parts")
    for used in (sets, shared, printed, star, first, parts, families, rest):
        discard(used)
    return out


def _needed(texts: DataFrame, named: DataFrame) -> DataFrame:
    """(th, text), th distinct, of the texts named by th."""
    return sifted(texts.select("th", "text"), named, "th").groupBy("th").agg(F.first("text").alias("text"))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, th, root) of each row of (doc_id, text): hash of the text and that of a text that
    stands for all reachable over near pairs. Texts without words, null ones too, are one group, 0."""
    rows = keyed(docs.select("doc_id", "text"))
    parts = near_texts(rows)
    named = rows.select("doc_id", "th").join(parts, "th", "left").select("doc_id", "th", F.coalesce("component", "th").alias("root"))
    named = materialize(named, "groups")
    discard(parts)
    return named
