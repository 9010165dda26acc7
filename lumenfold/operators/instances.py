"""Pointing, keypoint summaries, instance scores and masks given as pixels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import boxes
from ..functions.binding import let
from .matching import detection_counts, f1, n_matched

Inside = Callable[[Column, Column], Column]


def in_box(g: Column, p: Column) -> Column:
    """Whether a point [x, y, ...] lies in the box of an entry."""
    return boxes.point_in_box(p["box"], g["box"])


def in_runs(g: Column, p: Column) -> Column:
    """Whether a point lies in a mask of column-wise runs: g has spans (start, end) and height; the point
    is cut to whole pixels."""
    at = p["box"][0].cast("long") * g["height"] + p["box"][1].cast("long")
    return F.exists(g["spans"], lambda s: (s["start"] <= at) & (at < s["end"]))


def pointing_counts(samples: DataFrame, referring: bool = False, inside: Inside = in_box, keep: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Each gt in turn takes the first unused point of its category that lies inside it.

    samples: gt and pred, arrays of entries with cat; a pred's box begins with x and y. referring:
    only the preds of the first pred's category count, and they count as the first gt's.
    """
    rows = samples
    if referring:
        first = F.get("gt", F.lit(0))["cat"]
        own = F.filter("pred", lambda p: p["cat"] == F.get("pred", F.lit(0))["cat"])
        rows = rows.withColumn("pred", F.transform(own, lambda p: p.withField("cat", F.coalesce(first, p["cat"]))))
    score = lambda g, p: F.when((g["cat"] == p["cat"]) & inside(g, p), 1.0).otherwise(0.0)
    return detection_counts(rows, (0.5,), keep=keep, score=score)


def keypoint_summary(matrix: Column, n_gt: Column, recalls: Sequence[float] = (0.5, 0.75, 0.9, 0.95), above: float = 0.5) -> list[Column]:
    """Of a sample's score matrix: recall at thresholds (ap50, ...), and the mean of each gt's best
    score above `above` (avg_oks, 0 if none) with their number (pairs)."""
    best = let(F.transform(matrix, F.array_max), lambda b: F.filter(b, lambda v: v > above))
    mean = let(best, lambda b: F.when(F.size(b) > 0, F.aggregate(b, F.lit(0.0), lambda s, v: s + v) / F.size(b)).otherwise(0.0))
    aps = [F.when(n_gt > 0, n_matched(matrix, F.lit(t)) / n_gt).otherwise(0.0).alias(f"ap{round(t * 100)}") for t in recalls]
    return [*aps, mean.alias("avg_oks"), F.size(best).alias("pairs")]


def instance_f1(samples: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(matches, gt_count, pred_count, precision, recall, f1) over all samples: in order of gt, the best
    unused pred of its category; a crowd's overlap is taken over the pred's area. gt: cat, box, crowd."""
    score = lambda g, p: F.when(g["cat"] == p["cat"], boxes.crowd_iou(p["box"], g["box"], g["crowd"])).otherwise(0.0)
    c = detection_counts(samples, (threshold,), score=score).agg(*[F.coalesce(F.sum(F.col(a).cast("long")), F.lit(0)).alias(b) for a, b in (("matches", "matches"), ("n_gt", "gt_count"), ("n_pred", "pred_count"))])
    share = lambda n, other: F.when(F.col(n) > 0, F.col("matches") / F.col(n)).when(F.col(other) == 0, 1.0).otherwise(0.0)
    c = c.withColumn("precision", share("pred_count", "gt_count")).withColumn("recall", share("gt_count", "pred_count"))
    return c.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def panoptic_to_instances(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    """(image, id, cat, score, area, spans) of the segments that have pixels; spans are the runs (start,
    end) of their places in order, score 1 where the segment has none.

    pixels: image, pos, id; segments: image, id, cat, score.
    """
    at = Window.partitionBy("image", "id").orderBy("pos")
    new = F.when(F.col("pos") - F.lag("pos").over(at) == 1, 0).otherwise(1)
    runs = pixels.select("image", "id", "pos").distinct().withColumn("n", new).withColumn("run", F.sum("n").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("image", "id", "run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    masks = runs.groupBy("image", "id").agg(F.sum(F.col("end") - F.col("start")).alias("area"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return segments.join(masks, ["image", "id"]).select("image", "id", "cat", F.coalesce("score", F.lit(1.0)).alias("score"), "area", "spans")


def mask_union(pixels: DataFrame, *by: str) -> DataFrame:
    """Pixels (by..., pos) that any mask of the group covers."""
    return pixels.select(*by, "pos").distinct()


def with_area_ratio(masks: DataFrame, low: float = 0.01, high: float = 1.0) -> DataFrame:
    """Masks (area, width, height) whose share of the image lies in [low, high]; empty ones never do."""
    return masks.where((F.col("area") > 0) & (F.col("area") / (F.col("width") * F.col("height"))).between(low, high))


def nearest_source(i: Column, size: int | Column, source: int | Column) -> Column:
    """Place in the source that place i of a resized axis is taken from."""
    return F.least(F.floor(i * source / size), F.lit(source) - 1 if isinstance(source, int) else source - 1)


def resized_mask(pixels: DataFrame, width: int, height: int, new_width: int, new_height: int, *by: str) -> DataFrame:
    """Pixels (by..., x, y) of a mask resized by nearest neighbour: every source pixel gives the places that
    are taken from it."""
    span = lambda c, n, m: F.sequence(F.ceil(F.col(c) * m / n), F.ceil((F.col(c) + 1) * m / n) - 1)
    filled = lambda c, n, m: F.explode(F.when(F.ceil((F.col(c) + 1) * m / n) > F.ceil(F.col(c) * m / n), span(c, n, m)))
    rows = pixels.withColumn("__x", filled("x", width, new_width)).withColumn("__y", filled("y", height, new_height))
    return rows.select(*by, F.col("__x").alias("x"), F.col("__y").alias("y"))
