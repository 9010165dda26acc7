"""Panoptic, semantic and binary segmentation metrics over counted pixels.

Pixels come as (image, gt, pred, n), aggregated at ingest; no image is exploded at rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = 0


def panoptic_counts(cells: DataFrame, gt_segments: DataFrame, pred_segments: DataFrame) -> DataFrame:
    """(cat, iou, tp, fp, fn) over all images that have predictions.

    cells: image, gt, pred, n. gt_segments: image, id, cat, crowd; pred_segments: image, id, cat.
    A pair matches at an overlap above one half, which no two pairs of a segment can both reach.
    Void doesn't count against a prediction; predictions mostly on void or on a crowd of their
    category are let off. Images without predictions aren't scored.
    """
    images = pred_segments.select("image").distinct()
    gts = gt_segments.join(images, "image", "left_semi")
    pa = cells.groupBy("image", "pred").agg(F.sum("n").alias("pa"))
    ga = cells.groupBy("image", "gt").agg(F.sum("n").alias("ga"))
    p = pred_segments.select("image", F.col("id").alias("pred"), F.col("cat").alias("pcat")).join(pa, ["image", "pred"])
    g = gts.select("image", F.col("id").alias("gt"), F.col("cat").alias("gcat"), "crowd").join(ga, ["image", "gt"])
    void = cells.where(F.col("gt") == VOID).select("image", "pred", F.col("n").alias("nvoid"))
    p = p.join(void, ["image", "pred"], "left").withColumn("nvoid", F.coalesce("nvoid", F.lit(0)))
    pairs = cells.join(g, ["image", "gt"]).join(p, ["image", "pred"])
    hit = pairs.where(~F.col("crowd") & (F.col("gcat") == F.col("pcat"))).withColumn("iou", F.col("n") / (F.col("pa") + F.col("ga") - F.col("n") - F.col("nvoid"))).where("iou > 0.5")
    hit = hit.select("image", "gt", "pred", F.col("gcat").alias("cat"), "iou")
    zero = F.lit(0)
    tp = hit.select("cat", "iou", F.lit(1).alias("tp"), zero.alias("fp"), zero.alias("fn"))
    fn = g.where(~F.col("crowd")).join(hit, ["image", "gt"], "left_anti")
    fn = fn.select(F.col("gcat").alias("cat"), F.lit(0.0).alias("iou"), zero.alias("tp"), zero.alias("fp"), F.lit(1).alias("fn"))
    on_crowd = pairs.where(F.col("crowd") & (F.col("gcat") == F.col("pcat"))).groupBy("image", "pred").agg(F.max_by("n", "gt").alias("ncrowd"))
    fp = p.join(hit, ["image", "pred"], "left_anti").join(on_crowd, ["image", "pred"], "left")
    fp = fp.where((F.col("nvoid") + F.coalesce("ncrowd", zero)) / F.col("pa") <= 0.5)
    fp = fp.select(F.col("pcat").alias("cat"), F.lit(0.0).alias("iou"), zero.alias("tp"), F.lit(1).alias("fp"), zero.alias("fn"))
    rows = tp.unionAll(fp).unionAll(fn)
    return rows.groupBy("cat").agg(*[F.sum(c).alias(c) for c in ("iou", "tp", "fp", "fn")])


def panoptic_quality(counts: DataFrame) -> DataFrame:
    """Add pq, sq, rq of each category."""
    rq = F.col("tp") / (F.col("tp") + F.col("fp") / 2 + F.col("fn") / 2)
    sq = F.when(F.col("tp") > 0, F.col("iou") / F.col("tp")).otherwise(0.0)
    return counts.withColumn("sq", sq).withColumn("rq", rq).withColumn("pq", sq * rq)


def confusion(cells: DataFrame) -> DataFrame:
    """(gt, pred, n) over all images."""
    return cells.groupBy("gt", "pred").agg(F.sum("n").cast("long").alias("n"))


def distinct_labels(cells: DataFrame, label: str) -> DataFrame:
    """(image, label, n): each image's labels and their pixels."""
    return cells.groupBy("image", label).agg(F.sum("n").cast("long").alias("n"))


def annotations(segments: DataFrame, names: DataFrame) -> DataFrame:
    """One record for each image, as panoptic annotation files have them: image_id, file_name,
    segments_info (id, category_id, area) in order of place, phrases and caption.

    segments: image, place, phrase, category_id, id, n; names: image, file_name, caption. Images
    without segments have empty lists.
    """
    s = segments.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("place", "id", "category_id", F.col("n").alias("area"), "phrase"))).alias("s"))
    rows = names.join(s, "image", "left").withColumn("s", F.coalesce("s", F.array().cast(s.schema["s"].dataType)))
    info = F.transform("s", lambda e: F.struct(e["id"].alias("id"), e["category_id"].alias("category_id"), e["area"].alias("area")))
    return rows.select(F.col("image").alias("image_id"), "file_name", info.alias("segments_info"), F.transform("s", lambda e: e["phrase"]).alias("gcg_phrases"), F.col("caption").alias("gcg_caption"))


def class_report(matrix: DataFrame, names: DataFrame) -> DataFrame:
    """(class, IoU, ACC) of each named class with a figure, and of all: their mean overlap and the share
    of pixels that are right. matrix: gt, pred, n; names: cls, name."""
    s = class_scores(matrix)
    rows = s.join(names, "cls").where("iou is not null or acc is not null").select(F.col("name").alias("class"), F.col("iou").alias("IoU"), F.col("acc").alias("ACC"))
    whole = s.agg(F.avg("iou").alias("IoU")).crossJoin(matrix.agg(F.try_divide(F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("ACC")))  # one row each
    return rows.unionByName(whole.select(F.lit("overall").alias("class"), "IoU", "ACC"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """(cls, iou, acc) from a confusion table; null where undefined."""
    g = matrix.groupBy(F.col("gt").alias("cls")).agg(F.sum("n").alias("pos_gt"))
    p = matrix.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("pos_pred"))
    t = matrix.where("gt = pred").select(F.col("gt").alias("cls"), F.col("n").alias("tp"))
    rows = g.join(p, "cls", "full").join(t, "cls", "left").fillna(0, ["pos_gt", "pos_pred", "tp"])
    return rows.select("cls", F.try_divide("tp", F.col("pos_gt") + F.col("pos_pred") - F.col("tp")).alias("iou"), F.try_divide("tp", "pos_gt").alias("acc"))


def binary_scores(masks: DataFrame) -> DataFrame:
    """One row: giou (mean over samples with a union), ciou (sums), pacc. masks: inter, union,
    background hits and pixels of each sample."""
    return masks.agg(
        F.avg(F.when(F.col("uni") > 0, F.col("inter") / F.col("uni"))).alias("giou"),
        F.try_divide(F.sum("inter"), F.sum("uni")).alias("ciou"),
        F.try_divide(F.sum(F.col("inter") + F.col("bg")), F.sum("px")).alias("pacc"),
    )


def contour(cells: DataFrame) -> DataFrame:
    """Boundary pixels of a mask (image, x, y): those with one of four neighbours outside it."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    near = cells.select("image", "x", "y", step.alias("s")).select("image", (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    lost = near.join(cells, ["image", "x", "y"], "left_anti")
    return lost.select("image", F.col("ox").alias("x"), F.col("oy").alias("y")).distinct()
