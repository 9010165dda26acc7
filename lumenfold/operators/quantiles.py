"""Exact order statistics of groups of any size, and the normalisers that stand on them.

A wanted rank lies between two known values of its group. A scan counts the group's values in equal
bins between them, each bin with its smallest and largest value; the bin that holds the rank gives
the next bounds. Bins are counted before anything is shuffled, so a group that holds most rows is
counted by all tasks and never sorted in one. Where few values are left, these are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import dropped, staged

#: Bins of a scan; values of a group that are gathered at most; wanted ranks that are broadcast at most.
BINS, FEW, KNOWN = 1024, 1000, 100_000


def _same(a: DataFrame, b: DataFrame, by: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out &= a[c].eqNullSafe(b[f"__{c}"])
    return out


def _near(rows: DataFrame, targets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the targets of their group whose bounds hold them."""
    named = targets.select(*[F.col(c).alias(f"__{c}") for c in by], *[c for c in targets.columns if c not in by])
    held = F.broadcast(named) if targets.limit(KNOWN + 1).count() <= KNOWN else named
    return rows.join(held, _same(rows, held, by) & F.col("v").between(F.col("lo"), F.col("hi")))


def order_statistics(rows: DataFrame, by: Sequence[str], value: str, ranks: Column) -> DataFrame:
    """(by..., rank, v): the values of the given ranks, from 0, of each group.

    ranks: an array of longs, by the group's number n of values; ranks outside 0 to n - 1 have no
    row. Null and NaN values are left out; a null in `by` is a group like any other.
    """
    rows = rows.select(*by, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = stats.select(*by, "n", "lo", "hi", F.explode(F.array_distinct(ranks)).alias("rank")).where("rank >= 0 and rank < n")
    targets = staged(wanted.select(*by, F.col("rank").cast("long").alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("size")), "targets")
    found, used = [], [targets]
    while True:
        found.append(targets.where("lo = hi").select(*by, "rank", F.col("lo").alias("v")))
        small = _near(rows, targets.where(f"lo < hi and size <= {FEW}"), by)
        lists = small.groupBy(*by, "rank", "below").agg(F.sort_array(F.collect_list("v")).alias("l"))
        found.append(lists.select(*by, "rank", F.get("l", (F.col("rank") - F.col("below")).cast("int")).alias("v")))
        wide = targets.where(f"lo < hi and size > {FEW}")
        if wide.isEmpty():
            break
        # halves, so that a difference of large values doesn't overflow; the order of bins is that of values
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bins = _near(rows, wide, by).groupBy(*by, "rank", "below", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = Window.partitionBy(*by, "rank").orderBy("bin")  # BINS rows at most
        bins = bins.withColumn("upto", F.col("below") + F.sum("size").over(upto))
        hit = bins.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("size") <= F.col("rank")))
        targets = staged(hit.select(*by, "rank", "lo", "hi", (F.col("upto") - F.col("size")).alias("below"), "size"), "targets")
        used.append(targets)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = staged(out, "statistics")
    for t in used:
        dropped(t)
    return out


def quantiles(rows: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """(by..., n, q: one value for each fraction) of each group with a value, by linear interpolation
    between the neighbouring ranks."""
    valid = rows.select(*by, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    place = lambda f: (F.col("n") - 1) * F.lit(float(f))
    ranks = F.flatten(F.array(*[F.array(F.floor(place(f)), F.ceil(place(f))) for f in fractions]))
    got = order_statistics(valid, by, "v", ranks).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    n = valid.groupBy(*by).agg(F.count("*").alias("n"))
    n = n.select(*[F.col(c).alias(f"__{c}") for c in by], "n")
    rows_ = got.join(n, _same(got, n, by))

    def q(f: float) -> Column:
        p = place(f)
        lo, hi = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        return lo + (hi - lo) * (p - F.floor(p))

    return rows_.select(*by, "n", F.array(*[q(f) for f in fractions]).alias("q"))


def normalized_depth(pixels: DataFrame, by: Sequence[str], edge: float = 0.02, low: float = -1.0, high: float = 1.0, clip: bool = True) -> DataFrame:
    """Adds normal: depth scaled so that the image's quantiles `edge` and 1 - edge of valid positive
    depths become low and high. pixels: by..., depth, valid. Null in images without valid pixels and
    where both quantiles are equal."""
    q = quantiles(pixels.where("valid and depth > 0"), by, "depth", (edge, 1 - edge))
    named = q.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("q")[0].alias("__a"), F.col("q")[1].alias("__b"))
    rows = pixels.join(named, _same(pixels, named, by), "left")
    v = F.try_divide(F.col("depth") - F.col("__a"), F.col("__b") - F.col("__a")) * (high - low) + low
    v = F.least(F.greatest(v, F.lit(low)), F.lit(high)) if clip else v
    return rows.select(*pixels.columns, F.when(F.col("__b") > F.col("__a"), v).alias("normal"))


def skybox(p: Sequence[Column], camera: Sequence[Column]) -> list[Column]:
    """Where the ray from the camera through a point leaves the cube from -1 to 1, clipped to it; the
    camera itself if the ray doesn't."""
    d = [a - c for a, c in zip(p, camera, strict=True)]
    roots = [F.try_divide(F.signum(a) - c, a) for a, c in zip(d, camera, strict=True)]
    nearest = F.array_min(F.filter(F.array(*roots), lambda r: r > 0))
    scale = F.coalesce(nearest, F.lit(0.0))
    return [F.least(F.greatest(scale * a + c, F.lit(-1.0)), F.lit(1.0)) for a, c in zip(d, camera, strict=True)]


def normalized_sequences(points: DataFrame, cameras: DataFrame, share: float = 0.005, eps: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Points and cameras of sequences shifted to the mean of their frames' mean points, and scaled by
    a large distance from the first camera.

    points: seq, frame, x, y, z, valid and any others; cameras: seq, frame, x, y, z. Invalid points
    count in neither and are moved to the cube's walls along the ray from their shifted camera. The
    scale is the k-th largest distance of valid points, k being the share of their number, rounded,
    one at least. Sequences without valid points are left out.
    """
    xyz = ("x", "y", "z")
    valid = points.where("valid")
    means = valid.groupBy("seq", "frame").agg(*[F.avg(c).alias(c) for c in xyz]).groupBy("seq").agg(*[F.avg(c).alias(f"m{c}") for c in xyz])
    shift = lambda t: t.join(means, "seq").withColumns({c: F.col(c) - F.col(f"m{c}") for c in xyz}).drop(*[f"m{c}" for c in xyz])
    moved, eyes = shift(points), staged(shift(cameras), "cameras")
    first = eyes.groupBy("seq").agg(F.min_by(F.struct(*xyz), "frame").alias("c0"))
    far = moved.where("valid").join(first, "seq")
    far = far.select("seq", F.sqrt(sum(((F.col(c) - F.col(f"c0.{c}")) ** 2 for c in xyz), F.lit(0.0))).alias("d"))
    k = F.greatest(F.floor(F.col("n") * share + 0.5), F.lit(1))
    scale = order_statistics(far, ["seq"], "d", F.array(F.col("n") - k)).select("seq", (F.col("v") + eps).alias("scale"))
    eye = eyes.select("seq", "frame", *[F.col(c).alias(f"e{c}") for c in xyz])
    rows = moved.join(scale, "seq").join(eye, ["seq", "frame"], "left")
    scaled = [F.col(c) / F.col("scale") for c in xyz]
    wall = skybox(scaled, [F.col(f"e{c}") for c in xyz])
    out = rows.withColumns({c: F.when(F.col("valid"), s).otherwise(w) for c, s, w in zip(xyz, scaled, wall, strict=True)}).select(points.columns)
    return out, eyes.join(scale, "seq").withColumns({c: F.col(c) / F.col("scale") for c in xyz}).select(cameras.columns)


def unit_mean(rows: DataFrame, by: Sequence[str], value: Column, least: float = 1e-8) -> DataFrame:
    """(by..., factor): the mean of the values above 0, `least` at least, by which depths, translations or
    distances of points are divided."""
    some = F.when(value > 0, value)
    return rows.groupBy(*by).agg(F.greatest(F.coalesce(F.sum(some), F.lit(0.0)) / (F.count(some) + 1e-8), F.lit(least)).alias("factor"))
