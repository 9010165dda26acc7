"""Mixing many sources: keyed shuffles, shards, weighted draws, sampling with caps.

Every random choice is a hash of a seed and the row's key, so it repeats on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .numbering import dense_ids, number_within


def digest(seed: str | int, *key: Column | str) -> Column:
    parts = [F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def uniform(seed: str | int, *key: Column | str) -> Column:
    """In [0, 1), from the first 8 hex digits of the digest."""
    return F.conv(F.substring(digest(seed, *key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def shuffled(df: DataFrame, seed: str | int, *key: str) -> DataFrame:
    return df.orderBy(digest(seed, *key), *key)


def coin(seed: str | int, *key: Column | str) -> Column:
    return F.substring(digest(seed, *key), 1, 1) < "8"


def choose(options: Column, seed: str | int, *key: Column | str) -> Column:
    """One element of a list."""
    return F.get(options, F.floor(uniform(seed, *key) * F.size(options)).cast("int"))


def weighted(seed: str | int, weights: Sequence[tuple[str, float]], *key: Column | str) -> Column:
    """A name drawn by weight, against the running sums in the order given."""
    total, upto, out = sum(w for _, w in weights), 0.0, F.lit(weights[-1][0])
    bounds = []
    for name, w in weights:
        upto += w
        bounds.append((name, upto / total))
    u = uniform(seed, *key)
    for name, b in reversed(bounds[:-1]):
        out = F.when(u < b, F.lit(name)).otherwise(out)
    return out


def interleaved(df: DataFrame, group: str, weights: dict[str, float], seed: str | int, *key: str) -> DataFrame:
    """Add turn: the place on a clock on which a group of weight w advances by 1 / w a row; ordering by
    (turn, group) merges the groups in proportion to their weights. Groups without weight go."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(group)]
    return number_within(df.where(w > 0), [group], [digest(seed, *key), *key], "turn").withColumn("turn", F.col("turn") / w)


def quotas(df: DataFrame, group: str, weights: dict[str, float], total: int, seed: str | int, *key: str) -> DataFrame:
    """About `total` rows, each group's share by weight, repeating a group's rows where it has too few."""
    whole = sum(weights.values())
    want = F.create_map(*[F.lit(x) for g, w in weights.items() for x in (g, int(total * w / whole))])
    n = df.groupBy(group).agg(F.count("*").alias("__n"))
    rows = number_within(df.join(n, group), [group], [digest(seed, *key), *key], "__at").withColumn("__at", F.col("__at") - 1)
    rows = rows.withColumn("__want", F.coalesce(want[F.col(group)], F.lit(0)))
    times = F.floor((F.col("__want") - F.col("__at") - 1) / F.col("__n")) + 1
    return rows.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times.cast("int") - 1))).drop("__n", "__want", "__at")


def ceil_shard(rank: Column, n: Column, k: int) -> Column:
    """Of contiguous shards of ceil(n / k) rows."""
    return F.floor(rank / F.ceil(n / k)).cast("int")


def floor_shard(rank: Column, n: Column, k: int) -> Column:
    """Of contiguous shards of floor(n / k) rows, the last taking the rest."""
    return F.least(F.floor(rank / F.greatest(F.floor(n / k), F.lit(1))), F.lit(k - 1)).cast("int")


def even_shard(rank: Column, n: Column, k: int) -> Column:
    """Of contiguous shards whose sizes differ by one at most, the larger first."""
    small, extra = F.floor(n / k), n % k
    head = extra * (small + 1)
    return F.when(rank < head, F.floor(rank / (small + 1))).otherwise(extra + F.floor(F.try_divide(rank - head, small))).cast("int")


def repeated_to(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The list over and over until it has n rows, with its number `copy`."""
    total = df.count()
    if not total:
        return df.withColumn("copy", F.lit(0))
    rows = dense_ids(df, list(order), name="__at").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(-(-n // total) - 1))))
    return rows.where(F.col("copy") * total + F.col("__at") < n).drop("__at")


def capped(df: DataFrame, bucket: str, cap: int, seed: str | int, *key: str) -> DataFrame:
    """At most `cap` rows of each bucket, by hash."""
    order = Window.partitionBy(bucket).orderBy(digest(seed, *key), *key)
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= cap).drop("__r")


def first_of_each(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def last_of_each(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The row of the largest order value, nulls smallest."""
    return first_of_each(df, by, [F.desc_nulls_last(order)])


def frame_numbers(n: Column, k: int) -> Column:
    """k frames spread evenly over 0..n-1, ends included; fewer frames: the last one repeated."""
    at = F.sequence(F.lit(0), F.lit(k - 1))
    spread = F.transform(at, lambda i: F.floor(i * (n - 1) / max(k - 1, 1) + 0.5).cast("int"))
    short = F.transform(at, lambda i: F.least(i, n - 1).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n < k, short).otherwise(spread)


def interval_frames(n: Column, k: int, seed: str | int | None = None, *key: str) -> Column:
    """k frames of 0..n-1, one from each of k equal intervals: its middle, or, with a seed, one by hash of the
    key. Fewer frames: each once, the last one repeated up to k; none: empty."""
    parts = F.least(F.lit(k), n)
    edge = lambda i: F.floor(i * n / parts)

    def pick(i: Column) -> Column:
        lo, hi = edge(i), edge(i + 1) - 1
        return F.floor((lo + hi) / 2) if seed is None else lo + F.floor(uniform(seed, *key, i) * F.greatest(hi - lo + 1, F.lit(1)))

    got = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: pick(F.least(i, parts - 1)).cast("int"))
    return F.when(n > 0, got).otherwise(F.array().cast("array<int>"))


def rate_frames(n: Column, fps: Column, wanted: float, most: int | None = None) -> Column:
    """Frames of a video of n frames at fps, so that `wanted` are taken a second, each from the middle of its
    stretch (halves to the even number), at most `most` of them."""
    gap = 1.0 / wanted
    count = F.ceil(n / fps / gap).cast("int")
    at = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.rint((gap / 2 + i * gap) * fps).cast("int"))
    kept = F.filter(F.when(count > 0, at).otherwise(F.array().cast("array<int>")), lambda f: f < n)
    return kept if most is None else F.slice(kept, 1, most)


def nearby(frames: DataFrame, radius: int, k: int, seed: str | int) -> DataFrame:
    """For each frame up to k others of its sequence within the radius, by hash: (seq, frame, near)."""
    a = frames.select("seq", "frame")
    shift = F.explode(F.array(*[F.lit(d) for d in range(-radius, radius + 1) if d]))
    cand = a.withColumn("__d", shift).select("seq", "frame", (F.col("frame") + F.col("__d")).alias("near")).join(a.select("seq", F.col("frame").alias("near")).distinct(), ["seq", "near"])
    pick = F.slice(F.array_sort(F.collect_list(F.struct(digest(seed, "seq", "frame", "near").alias("h"), "near"))), 1, k)
    return cand.groupBy("seq", "frame").agg(F.transform(pick, lambda p: p["near"]).alias("near"))


def local_names(rows: DataFrame, by: Sequence[str], name: str, order: Sequence[str]) -> DataFrame:
    """Add local: name-0, name-1, ... in order within the group."""
    w = Window.partitionBy(*by, name).orderBy(*order)
    return rows.withColumn("local", F.concat_ws("-", name, (F.row_number().over(w) - 1).cast("string")))


def task_prompt(c: Column, mode: str, templates: list[str], seed: str | int, *key: str) -> Column:
    """A prompt as it is (raw), without its task mark (plain), or in half of the cases with one of the templates
    in the mark's place (natural), by hash of the key; {categories} becomes the prompt's tagged names."""
    if mode == "raw":
        return c
    if mode == "plain":
        return text.strip_task(c)
    if mode != "natural":
        raise ValueError(f"no mode {mode}")
    names = F.array_join(text.phrases(c), ", ")
    template = choose(F.array(*[F.lit(t) for t in templates]), f"{seed}-template", *key)
    filled = F.replace(template, F.lit("{categories}"), F.when(names == "", "all relevant objects").otherwise(names))
    marked = c.rlike(r"^\s*<task:[^>]*>")
    return F.when(coin(f"{seed}-coin", *key) & marked, F.concat(filled, F.lit(" "), text.strip_task(c))).otherwise(text.strip_task(c))
