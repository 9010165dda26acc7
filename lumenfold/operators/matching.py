"""One-to-one matching of predictions with ground truth, sample by sample.

A sample is one row with arrays of gt and pred, so a fold over arrays is all in one row and no
pair leaves it. Overlaps are computed once for all thresholds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.binding import let

#: 0.50 to 0.95 by 0.05.
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


def score_matrix(gt: Column, pred: Column, score: Callable[[Column, Column], Column]) -> Column:
    """A row for each gt, a score for each pred."""
    return F.transform(gt, lambda g: F.transform(pred, lambda p: score(g, p)))


def _taken(acc: Column, best: Column) -> Column:
    """The state of a fold after a match with `best` (-1: none)."""
    used = F.when(best >= 0, F.array_append(acc["used"], best)).otherwise(acc["used"])
    return F.named_struct(F.lit("used"), used, F.lit("out"), F.array_append(acc["out"], best))


def greedy(matrix: Column, threshold: Column) -> Column:
    """Pred matched to each gt in turn (-1: none): the best unused one of at least the threshold and
    above 0; the first of equals."""
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        open_ = F.transform(
            row, lambda v, i: F.when((v > 0) & (v >= threshold) & ~F.array_contains(acc["used"], i), F.struct(v.alias("v"), (-i).alias("i")))
        )
        return let(F.coalesce(-F.array_max(open_)["i"], F.lit(-1)), lambda best: _taken(acc, best))

    return F.aggregate(matrix, start, step, lambda acc: acc["out"])


def candidates(matrix: Column, least: float) -> Column:
    """The cells of a score matrix that a threshold of `least` or more can take, in the order in which
    greedy() takes them: (g, k, i) with k the score's negative, -inf for NaN, which counts as largest."""
    cell = lambda g: lambda v, i: F.named_struct(F.lit("g"), g, F.lit("k"), F.when(F.isnan(v), float("-inf")).otherwise(-v), F.lit("i"), i)
    cells = F.flatten(F.transform(matrix, lambda row, g: F.transform(row, cell(g))))
    return F.array_sort(F.filter(cells, lambda c: (c["k"] < 0) & (c["k"] <= -least)))


def n_taken(cells: Column, threshold: Column) -> Column:
    """n_matched() from a matrix's candidates, for a threshold not below theirs: only cells that reach it
    are walked, so many thresholds cost little more than one."""
    start = F.struct(F.lit(-1).alias("g"), F.array().cast("array<int>").alias("used"))
    take = lambda a, c: F.when(
        (a["g"] != c["g"]) & ~F.array_contains(a["used"], c["i"]), F.named_struct(F.lit("g"), c["g"], F.lit("used"), F.array_append(a["used"], c["i"]))
    ).otherwise(a)
    walk = lambda h: F.when(F.size(h) <= 1, F.size(h)).otherwise(F.aggregate(h, start, take, lambda a: F.size(a["used"])))
    return let(F.filter(cells, lambda c: c["k"] <= -threshold), walk)


def n_matched(matrix: Column, threshold: Column) -> Column:
    return F.size(F.filter(greedy(matrix, threshold), lambda i: i >= 0))


def box_score(mode: str, gt: Column) -> Callable[[Column, Column], Column]:
    """Overlap of two entries (cat, box) by mode. pooled: preds of a category that the sample's gt
    lacks are no candidates; by_category: only equal categories; referring: categories don't count."""

    def score(g: Column, p: Column) -> Column:
        value = F.when(p["box"].isNotNull() & g["box"].isNotNull(), boxes.iou(g["box"], p["box"])).otherwise(F.lit(0.0))
        if mode == "by_category":
            return F.when(g["cat"] == p["cat"], value).otherwise(F.lit(0.0))
        if mode == "pooled":
            return F.when(F.exists(gt, lambda x: x["cat"] == p["cat"]), value).otherwise(F.lit(0.0))
        return value

    return score


def detection_counts(
    samples: DataFrame, thresholds: Sequence[float] = THRESHOLDS, mode: str = "pooled", keep: Sequence[str] = ("sample_id",),
    score: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Rows (keep..., iou, matches, n_gt, n_pred, recall, precision) for each sample and threshold.

    samples: gt and pred, arrays of (cat, box). score takes the place of the mode's. A pred with a null box is no prediction. Without any
    gt: recall and precision are 1 if there is no pred either, else 0 (by_category: 0 always);
    without pred: 0.
    """
    gt = F.coalesce(F.col("gt"), F.array().cast(samples.schema["gt"].dataType))
    pred = F.filter(F.coalesce(F.col("pred"), F.array().cast(samples.schema["pred"].dataType)), lambda p: p["box"].isNotNull())
    rows = samples.withColumn("gt", gt).withColumn("pred", pred)
    m = score_matrix(F.col("gt"), F.col("pred"), score or box_score(mode, F.col("gt")))
    rows = rows.withColumn("__m", candidates(m, min(thresholds)))
    # the explode ends the projection, so that the matrix is computed once for all thresholds
    grid = F.array(*[F.lit(t) for t in thresholds])
    rows = rows.select(*keep, F.size("gt").alias("n_gt"), F.size("pred").alias("n_pred"), "__m", F.explode(grid).alias("iou"))
    none = F.lit(0.0) if mode == "by_category" else F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)
    ratio = lambda n: F.when(F.col("n_gt") == 0, none).when(F.col("n_pred") == 0, 0.0).otherwise(F.col("matches") / F.col(n))
    rows = rows.select(*keep, "iou", n_taken(F.col("__m"), F.col("iou")).alias("matches"), "n_gt", "n_pred")
    return rows.withColumn("recall", ratio("n_gt")).withColumn("precision", ratio("n_pred"))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def macro(counts: DataFrame, *by: str) -> DataFrame:
    """Means of recall and precision over samples, F1 of the means, rounded to 6 places."""
    out = counts.groupBy(*by).agg(F.avg("recall").alias("r"), F.avg("precision").alias("p"), F.count("*").alias("samples"))
    return out.select(*by, F.round("r", 6).alias("recall"), F.round("p", 6).alias("precision"), F.round(f1(F.col("p"), F.col("r")), 6).alias("f1"), "samples")


def duplicate_ratio(pred: Column, above: float = 0.9) -> Column:
    """Pairs of preds with an overlap above `above`, over the number of preds."""
    n = F.size(pred)
    pairs = F.aggregate(
        F.transform(pred, lambda p, i: F.size(F.filter(F.slice(pred, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda q: boxes.iou(p["box"], q["box"]) > above))),
        F.lit(0), lambda s, v: s + v,
    )
    return F.when(n > 0, pairs / n).otherwise(F.lit(0.0))


def gui_hit(points: Column, found: Column, truth: Column) -> Column:
    """1 if any point lies in the true box; where there are no points, any found box's centre."""
    by_point = F.exists(points, lambda p: boxes.point_in_box(p, truth))
    by_box = F.exists(found, lambda b: boxes.point_in_box(boxes.centre(b), truth))
    return F.when(F.size(points) > 0, by_point).otherwise(by_box).cast("double")


def refused_wrongly(pred: Column) -> Column:
    """1 if any element is null or says none."""
    return F.coalesce(F.exists(pred, lambda p: p.isNull() | (F.lower(p) == "none")), F.lit(False)).cast("int")


def followed(asked: Column, answered: Column) -> Column:
    """Share of the asked categories that were answered; null if none was asked."""
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, answered)) / F.size(F.array_distinct(asked)))


def oks(gt: Column, pred: Column, size: Column, sigma: float = 0.025) -> Column:
    """Keypoint similarity: mean over the gt's keypoints that pred has too of exp(-d2 / (2 sigma^2
    area)); 0 if there are none. gt and pred: arrays of (name, x, y)."""

    near = lambda g: lambda p: _closeness(g, p, size, sigma)
    return _mean_known(F.transform(gt, lambda g: F.get(F.transform(F.filter(pred, lambda p: p["name"] == g["name"]), near(g)), F.lit(0))))


def aligned(keypoints: Column, names: Sequence[str]) -> Column:
    """Keypoints (name, x, y) in the order of names, null where one is missing: done once for each instance,
    it saves the search by name in every pair."""
    return F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.get(F.filter(keypoints, lambda k: k["name"] == n), F.lit(0)))


def oks_aligned(gt: Column, pred: Column, size: Column, sigma: float = 0.025) -> Column:
    """oks() of keypoints in the same order."""
    return _mean_known(F.zip_with(gt, pred, lambda g, p: _closeness(g, p, size, sigma)))


def _closeness(g: Column, p: Column, size: Column, sigma: float) -> Column:
    dx, dy = g["x"] - p["x"], g["y"] - p["y"]
    return F.exp(F.try_divide(-(dx * dx + dy * dy), F.lit(2 * sigma * sigma) * size))


def _mean_known(values: Column) -> Column:
    """Mean of the values that aren't null; 0 if there are none."""
    # one fold, as an expression used twice would be computed twice
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    return F.aggregate(
        values, start,
        lambda a, v: F.struct((a["s"] + F.coalesce(v, F.lit(0.0))).alias("s"), (a["n"] + v.isNotNull().cast("int")).alias("n")),
        lambda a: F.coalesce(F.try_divide(a["s"], a["n"]), F.lit(0.0)),
    )


def best_pairs(matrix: Column) -> Column:
    """Repeatedly the largest score (ties: first gt, then first pred), its row and column removed;
    the scores taken."""
    cells = F.flatten(F.transform(matrix, lambda row, i: F.transform(row, lambda v, j: F.named_struct(F.lit("v"), -v, F.lit("i"), i, F.lit("j"), j))))
    start = F.struct(*[F.array().cast(k).alias(n) for n, k in (("gi", "array<int>"), ("pj", "array<int>"), ("out", "array<double>"))])

    def step(acc: Column, c: Column) -> Column:
        free = ~F.array_contains(acc["gi"], c["i"]) & ~F.array_contains(acc["pj"], c["j"])
        taken = F.named_struct(F.lit("gi"), F.array_append(acc["gi"], c["i"]), F.lit("pj"), F.array_append(acc["pj"], c["j"]), F.lit("out"), F.array_append(acc["out"], -c["v"]))
        return F.when(free, taken).otherwise(acc)

    return F.aggregate(F.array_sort(cells), start, step, lambda acc: acc["out"])
