"""SimHash near-dedup with pigeonhole blocks.

Fingerprints of 64 bits are cut into six blocks. Two that differ in at most four bits agree on at
least two blocks, so each pair meets under one of fifteen keys of two blocks (20 bits or more).
With more fingerprints there are seven or eight blocks and keys of three or four of them (27 or 32
bits), so that a key's rows stay few; every pair meets all the same. Equal fingerprints are one
class from the start. Rows of a key are compared in one sorted run; a run of more than eight gives
the edges of a spanning forest, a smaller one its few links. Runs of more than RUN fingerprints are
split into tiles, each pair of tiles being a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, relax, ship, small_batches, table
from .components import connected_components
from .jaccard import keyed, near_groups

BITS, WORDS, SEED, DISTANCE = 64, 4, 42, 4
#: Blocks, and the number of fingerprints up to which there are no more.
BLOCKS = ((6, 1 << 28), (7, 1 << 34), (8, 1 << 64))
#: Fingerprints of one key that one task compares with one another.
RUN = 100_000
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, lower: bool = True) -> int:
    """Signed 64-bit fingerprint of a whole text: a bit is 1 if set in over half of the XXH64 (seed
    42) of its shingles, repeats included. Fewer words: the whole sequence; none, or null: 0."""
    import xxhash

    raw = (text or "").encode("utf-8", "surrogatepass")
    ws = (raw.lower() if lower else raw).split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws))) + np.arange(len(ws))
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(ws))
    a, b = starts[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(a), CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(a[i : i + CHUNK], b[i : i + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(a)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Add fingerprint (long); a column of this name is replaced. Texts of any length are taken whole; a
    null one is like an empty one (0); repeated rows stay; an empty table gives no rows."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")
        relax()

    return docs.withColumn("fingerprint", of(F.col("text")))


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= distance


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (indices) of a spanning forest: they join what links of at most `distance` join among
    distinct fingerprints, and there are fewer of them than fingerprints.

    One component is grown around the bitwise majority first: all within half the distance of any
    point are linked pairwise. After that only rows outside the largest component are compared,
    each with all, so a dense group costs about its size.
    """
    n = len(fp)
    if n == 2:
        hit = int(np.bitwise_count(fp[:1] ^ fp[1:])[0]) <= distance
        return (np.array([0]), np.array([1])) if hit else (np.array([], int), np.array([], int))
    label = np.arange(n)
    left, right = [], []
    if n > 16:
        ones = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
        centre = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")
        ball = np.flatnonzero(np.bitwise_count(fp ^ centre) <= distance // 2)
        if len(ball) > 1:
            label[ball] = ball[0]
            left.append(np.full(len(ball) - 1, ball[0])), right.append(ball[1:])
            # whoever is near one of a few members joins them
            for m in ball[:: max(1, len(ball) // 64)]:
                new = np.flatnonzero((label != ball[0]) & (np.bitwise_count(fp ^ fp[m]) <= distance))
                label[new] = ball[0]
                left.append(np.full(len(new), m)), right.append(new)
    rest = np.flatnonzero(label != np.bincount(label).argmax())
    for i in range(0, len(rest), 256):
        rows = rest[i : i + 256]
        for j in range(0, n, 16_384):
            near = _near(fp[rows], fp[j : j + 16_384], distance)
            for k in np.flatnonzero((near & (label[rows][:, None] != label[None, j : j + 16_384])).any(1)):
                # an edge to each component that this row joins to its own
                c = np.flatnonzero(near[k]) + j
                met, at = np.unique(label[c], return_index=True)
                other = met != label[rows[k]]
                left.append(np.full(int(other.sum()), rows[k])), right.append(c[at[other]])
                label[np.isin(label, met[other])] = label[rows[k]]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.array([], int), np.array([], int))


def cut_points(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of so many blocks, the first ones wider by a bit where they can't be equal."""
    widths = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def near_edges(classes: DataFrame, distance: int = DISTANCE, run: int = RUN, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) over distinct fingerprints that connect all at most `distance` (4 or less) apart.

    classes: one column fingerprint, distinct, not null; an empty table has none. The number of
    blocks follows from the number of fingerprints, unless it is given. A distance that leaves less
    than two blocks for a key is refused.
    """
    if blocks is None:
        n = classes.count()
        blocks = next(b for b, most in BLOCKS if n <= most)
    if distance > blocks - 2:
        raise ValueError(f"pairs of {blocks} blocks cover {blocks - 2} bits at most, not {distance}")
    ship(classes.sparkSession)
    places = cut_points(blocks)

    def key(chosen: tuple[int, ...]):
        out = F.lit(0).cast("long")
        for shift, width in (places[i] for i in chosen):
            out = out * F.lit(1 << width) + F.shiftrightunsigned("fingerprint", shift).bitwiseAND(F.lit((1 << width) - 1))
        return out

    keys = [F.struct(F.lit(n).cast("int").alias("pair"), key(c).alias("key")) for n, c in enumerate(combinations(range(blocks), min(4, blocks - distance)))]
    rows = classes.select("fingerprint", F.explode(F.array(*keys)).alias("k")).select("fingerprint", "k.pair", "k.key")
    large = rows.groupBy("pair", "key").agg(F.count("*").alias("n")).where(F.col("n") > run)
    large = large.select("pair", "key", F.ceil(F.col("n") / run).cast("int").alias("tiles"))
    tiles = F.coalesce("tiles", F.lit(1))
    mine = F.pmod(F.xxhash64("fingerprint"), tiles)
    split = (
        rows.join(large, ["pair", "key"], "left")
        .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .withColumn("tiles2", F.struct(F.least(mine, F.col("other")).alias("lo"), F.greatest(mine, F.col("other")).alias("hi")))
        .select("pair", "key", F.col("tiles2.lo").alias("lo"), F.col("tiles2.hi").alias("hi"), "fingerprint")
    )
    group = ["pair", "key", "lo", "hi"]
    sorted_runs = split.repartition(*group).sortWithinPartitions(*group, "fingerprint")

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def found(ids: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            out_a, out_b = [], []
            cut = np.flatnonzero(np.diff(ids)) + 1
            starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(ids)]])
            size = stops - starts
            for k in range(1, 8):  # runs of up to 8 rows: all at once, row i against row i + k
                at = np.flatnonzero((size > k) & (size <= 8))
                if not len(at):
                    break
                for i in range(0, 8 - k):
                    s = starts[at[size[at] > i + k]] + i
                    hit = s[np.bitwise_count(fp[s] ^ fp[s + k]) <= distance]
                    out_a.append(fp[hit]), out_b.append(fp[hit + k])
            for s, e in zip(starts[size > 8], stops[size > 8], strict=True):
                l, r = forest(fp[s:e], distance)
                out_a.append(fp[s:e][l]), out_b.append(fp[s:e][r])
            a = np.concatenate(out_a) if out_a else np.array([], "<u8")
            b = np.concatenate(out_b) if out_b else np.array([], "<u8")
            return pd.DataFrame({"a": a.view("<i8"), "b": b.view("<i8")})

        for b in batches:
            if not len(b):
                continue
            ids = _run_ids(b)
            held.append((ids, b["fingerprint"].to_numpy("int64").view("<u8")))
            # keep the last run back: it may go on in the next batch
            ids, fp = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            whole = np.flatnonzero(ids != ids[-1])
            end = int(whole[-1]) + 1 if len(whole) else 0
            if end:
                yield found(ids[:end], fp[:end])
            held = [(ids[end:], fp[end:])]
        if held:
            yield found(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    return sorted_runs.mapInPandas(edges, "a long, b long")


def _run_ids(b: pd.DataFrame) -> np.ndarray:
    """A hash of the run that each row belongs to."""
    h = np.zeros(len(b), np.uint64)
    for c in ("pair", "key", "lo", "hi"):
        h = (h ^ b[c].to_numpy("int64").view("<u8")) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def near_duplicates(prints: DataFrame, doc_id: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """Add component_id, the smallest doc_id reachable over links of at most `distance` bits, and
    component_root, a fingerprint that stands for the component.

    prints: doc_id and fingerprint (not null) of each document, written, as it is read twice.
    Repeated rows share their component; a null doc_id is never the smallest, and a component of
    null ids alone has a null component_id. Columns of these names are replaced. An empty table gives
    no rows.
    """
    classes = materialize(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("least")), "classes")
    joined = materialize(near_edges(classes.select("fingerprint"), distance).distinct(), "near")
    parts = connected_components(joined, "a", "b").withColumnRenamed("node", "fingerprint")
    rooted = classes.join(parts, "fingerprint", "left").withColumn("root", F.coalesce("component", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.select("fingerprint", "root").join(least, "root").select("fingerprint", "component_id", F.col("root").alias("component_root")), "named")
    for used in (classes, joined):
        discard(used)
    return prints.drop("component_id", "component_root").join(named, "fingerprint")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: the smallest doc_id (nulls last),
    then the smallest hash of the text, then the smallest row. Columns must be orderable. Near are
    texts whose five-word shingles have a Jaccard similarity of 0.8 or more; four words and four
    bits are op8's alone. Texts without words, null ones too, are one group."""
    rows = near_groups(docs.select("doc_id", "text")).groupBy("root", "doc_id", "th").agg(F.count("*").alias("c"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th", "c")).alias("f"))
    first = materialize(first.select(F.col("f.doc_id").alias("__id"), F.col("f.th").alias("__th"), F.col("f.c").alias("__c")), "first")
    keys = keyed(docs.select(F.struct("*").alias("__doc"), "doc_id", "text")).drop("text")
    held = keys.join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))
    # only repeated rows have to meet
    again = held.where("__c > 1").groupBy("doc_id", "th").agg(F.min("__doc").alias("__doc"))
    return held.where("__c = 1").select("__doc.*").unionAll(again.select("__doc.*"))


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = materialize(fingerprints(docs).select("doc_id", "fingerprint"), "prints")
    out = near_duplicates(prints)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
