"""One scan for the samples of all tasks: rows built from answers, scored by their task's family.

A mixed table is scored in one pass: a sample's score matrix is that of its task, thresholds share
it, and one aggregate by task and data set gives every family's figures. There is one shuffle,
of partial aggregates, whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..functions.binding import let
from . import curves, matching, runs

#: Tasks that have a rule of their own. All others are detection by category.
REFERRING, POINTING, POINTING_REFERRING = "referring_object_detection", "pointing", "pointing_referring"
KEYPOINT, HALLUCINATION, GUI = "keypoint", "hallucination", "gui"
VISUAL = ("visual_prompt_detection", "visual_prompting")
LETTERS = ("common_object_detection", "long_tailed_object_detection")


def entry_of(cat: Column, box: Column) -> Column:
    return F.struct(cat.alias("cat"), box.cast("array<double>").alias("box"))


def _flat(groups: Column) -> Column:
    """(cat, box) of parsed (label, items)."""
    return F.flatten(F.transform(groups, lambda g: F.transform(g["items"], lambda b: entry_of(g["label"], b))))


def answer_rows(answers: DataFrame, case_kept: Sequence[str] = ()) -> DataFrame:
    """gt and pred, arrays of (cat, box) in pixels, in place of truth and answer.

    answers: task, category, width, height, truth, answer, the last two texts with tagged boxes (for
    pointing tasks the answer has points, whose box is [x, y]); other columns are kept. Visual
    prompts: all boxes of both sides belong to the sample's category. gui: the truth is the first
    box of the last label. Labels are normalised but for the tasks of case_kept. Null texts, and
    texts without tags, have no entries; two decimals are kept of a pixel.
    """
    task, name = F.col("task"), text.normalize_category(F.coalesce(F.col("category"), F.lit("unknown")))
    two = lambda v, size: F.round(v * size, 2)
    scaled = lambda b: F.transform(b, lambda v, i: F.when(i % 2 == 0, two(v, F.col("width"))).otherwise(two(v, F.col("height"))))
    plain = task.isin(*case_kept) if case_kept else F.lit(False)
    none = F.array().cast("array<struct<cat:string,box:array<double>>>")

    def boxed(c: str) -> Column:
        found = F.when(plain, _flat(text.parse_boxes(F.col(c), False))).otherwise(_flat(text.parse_boxes(F.col(c))))
        one = F.when(task.isin(*VISUAL), F.transform(found, lambda e: e.withField("cat", name))).otherwise(found)
        return F.coalesce(F.transform(one, lambda e: e.withField("box", scaled(e["box"]))), none)

    points = F.coalesce(F.transform(_flat(text.parse_points(F.col("answer"))), lambda e: e.withField("box", scaled(e["box"]))), none)
    pointing = task.isin(POINTING, POINTING_REFERRING)
    last = lambda es: F.slice(F.filter(es, lambda e: e["cat"] == F.element_at(es, -1)["cat"]), 1, 1)
    gt = let(boxed("truth"), lambda es: F.when((task == GUI) & (F.size(es) > 0), last(es)).otherwise(es))
    kept = [c for c in answers.columns if c not in ("truth", "answer")]
    return answers.select(*kept, gt.alias("gt"), F.when(pointing, points).otherwise(boxed("answer")).alias("pred"))


def _score(g: Column, p: Column, cats: Column) -> Column:
    task = F.col("task")
    iou = F.when(p["box"].isNotNull() & g["box"].isNotNull(), boxes.iou(g["box"], p["box"])).otherwise(0.0)
    inside = F.when((g["cat"] == p["cat"]) & boxes.point_in_box(p["box"], g["box"]), 1.0).otherwise(0.0)
    by_task = F.when(task == REFERRING, iou).when(task.isin(POINTING, POINTING_REFERRING), inside)
    if "kpts" in _fields(cats):
        by_task = by_task.when(task == KEYPOINT, F.round(matching.oks(g["kpts"], p["kpts"], boxes.area(g["box"])), 9))
    return by_task.otherwise(F.when(F.array_contains(F.col("__cats"), p["cat"]), iou).otherwise(0.0))


def _fields(kind) -> list[str]:
    return [f.name for f in kind.elementType.fields]


def sample_scores(samples: DataFrame, thresholds: Sequence[float] = matching.THRESHOLDS) -> DataFrame:
    """(task, dataset, iou, recall, precision, n_gt, n_pred, refused, follows) of each sample and threshold.

    samples: task, dataset, gt, pred: arrays of (cat, box) and, for keypoints, kpts (name, x, y); null
    arrays are empty ones. Categories are compared in lower case, as letters alone for common and
    long-tailed detection, without underscores and spaces otherwise. A pred without a box says none.
    Pointing: a pred's box begins with its point; referring, its first category counts as the first
    gt's. gui: a hit is a point, or else a box's centre, in the first gt. hallucination: right if
    nothing is predicted. keypoint: gt by falling area, by similarity of keypoints.
    """
    task = F.col("task")
    kind = samples.schema["gt"].dataType
    full = lambda c: F.coalesce(F.col(c), F.array().cast(samples.schema[c].dataType))
    lower = lambda e: e.withField("cat", F.lower(e["cat"]))
    rows = samples.select("task", "dataset", F.transform(full("gt"), lower).alias("gt"), F.transform(full("pred"), lower).alias("answered"))
    # each explode ends a projection, so that what stands before it is computed once
    once = F.explode(F.array(F.lit(0))).alias("__once")
    named = lambda c: F.when(task.isin(*LETTERS), text.letters_only(c)).otherwise(text.without_separators(c))
    cleaned = lambda c: F.when(task.isin(REFERRING, POINTING, POINTING_REFERRING, KEYPOINT, HALLUCINATION, GUI), F.col(c)).otherwise(F.transform(c, lambda e: e.withField("cat", named(e["cat"]))))
    first = lambda c: F.get(c, F.lit(0))["cat"]
    own = F.transform(F.filter("answered", lambda p: p["cat"] == first("answered")), lambda p: p.withField("cat", F.coalesce(first("gt"), p["cat"])))
    found = F.when(task == POINTING_REFERRING, own).otherwise(cleaned("answered"))
    by_area = F.transform(F.array_sort(F.transform("gt", lambda e, i: F.named_struct(F.lit("a"), -boxes.area(e["box"]), F.lit("i"), i, F.lit("e"), e))), lambda x: x["e"])
    truth = F.when(task == KEYPOINT, by_area).otherwise(cleaned("gt"))
    cats = lambda c: F.array_distinct(F.transform(c, lambda e: e["cat"]))
    asked = F.when(task.isin(*LETTERS), cats("truth")).otherwise(cats("gt"))
    given = F.when(task.isin(*LETTERS), cats("found")).otherwise(cats("answered"))
    rows = rows.select("task", "dataset", "gt", "answered", truth.alias("truth"), found.alias("found"), once)
    follows = F.when(F.size("gt") == 0, F.when(F.size("answered") == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(asked, given)) / F.size(cats("gt")))
    said_none = F.exists("answered", lambda p: p["box"].isNull())
    boxed = F.filter("found", lambda p: p["box"].isNotNull())
    rows = rows.select("task", "dataset", "truth", boxed.alias("found"), follows.alias("follows"), said_none.alias("refused"), cats("truth").alias("__cats"), once)
    target = F.get("truth", F.lit(0))["box"]
    hit = F.exists("found", lambda p: boxes.point_in_box(F.when(F.size(p["box"]) == 2, p["box"]).otherwise(boxes.centre(p["box"])), target))
    n_gt = F.when(task == HALLUCINATION, 0).when(task == GUI, 1).otherwise(F.size("truth"))
    matrix = F.when(task.isin(HALLUCINATION, GUI), F.array().cast("array<array<double>>")).otherwise(matching.score_matrix(F.col("truth"), F.col("found"), lambda g, p: _score(g, p, kind)))
    rows = rows.select("task", "dataset", "follows", "refused", n_gt.alias("n_gt"), F.size("found").alias("n_pred"), F.coalesce(hit, F.lit(False)).alias("hit"), matching.candidates(matrix, min(0.5, *thresholds)).alias("m"))
    # in a step of its own: what stands beside an explode is computed for each of its rows
    rows = rows.select(*rows.columns, F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("iou"))
    rows = rows.withColumn("n", matching.n_taken(F.col("m"), F.when(task.isin(POINTING, POINTING_REFERRING), 0.5).otherwise(F.col("iou"))))
    whole = F.when(task == HALLUCINATION, (F.col("n_pred") == 0).cast("double")).when(task == GUI, F.col("hit").cast("double"))
    ratio = lambda n: whole.when(F.col("n_gt") == 0, F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)).when(F.col("n_pred") == 0, 0.0).otherwise(F.col("n") / F.col(n))
    return rows.select("task", "dataset", "iou", ratio("n_gt").alias("recall"), ratio("n_pred").alias("precision"), "n_gt", "n_pred", "refused", "follows")


def routed_scores(samples: DataFrame, thresholds: Sequence[float] = matching.THRESHOLDS) -> DataFrame:
    """Every family's figures by task, data set and threshold: means of recall and precision and the F1
    of the means, accuracy (hallucination, gui), wrong_rejection (not for hallucination), count_mae
    (visual prompts), follows, boxes on both sides and samples; null where a figure isn't the task's."""
    task = F.col("task")
    out = sample_scores(samples, thresholds).groupBy("task", "dataset", "iou").agg(
        F.avg("recall").alias("r"), F.avg("precision").alias("p"), F.avg(F.col("refused").cast("double")).alias("w"),
        F.avg(F.abs(F.col("n_pred") - F.col("n_gt"))).alias("mae"), F.avg("follows").alias("follows"),
        F.sum("n_gt").alias("n_gt"), F.sum("n_pred").alias("n_pred"), F.count("*").alias("samples"),
    )
    six = lambda c: F.round(c, 6)
    return out.select(
        "task", "dataset", "iou", six(F.col("r")).alias("recall"), six(F.col("p")).alias("precision"), six(matching.f1(F.col("p"), F.col("r"))).alias("f1"),
        six(F.when(task.isin(HALLUCINATION, GUI), F.col("r"))).alias("accuracy"), six(F.when(task != HALLUCINATION, F.col("w"))).alias("wrong_rejection"),
        six(F.when(task.isin(*VISUAL), F.col("mae"))).alias("count_mae"), six(F.col("follows")).alias("follows"), "n_gt", "n_pred", "samples",
    )


def evaluate(
    truths: DataFrame, detections: DataFrame, kind: str = "boxes", agnostic: bool = False, negatives: DataFrame | None = None, partial: DataFrame | None = None,
    top: int | None = 100,
) -> DataFrame:
    """The twelve summary figures of scored detections, one row.

    kind: boxes or masks, what `box` holds (runs.overlap_boxes). agnostic: categories don't count.
    negatives, partial: (image, cat), for tables that aren't labelled exhaustively; then detections
    of other categories are left out and all of an image's are matched. truths, detections: as for
    curves.match_codes.
    """
    overlap, size = (runs.mask_iou, runs.mask_area) if kind == "masks" else (boxes.crowd_iou, boxes.area)
    if negatives is not None:
        none = truths.limit(0).select("image", "cat")
        detections, top = curves.federated(detections, truths, negatives, partial if partial is not None else none), None
    if agnostic:
        truths, detections = (t.withColumn("cat", F.lit("")) for t in (truths, detections))
    areas = tuple(curves.AREAS)
    m = curves.match_codes(truths, detections, curves.THRESHOLDS, areas, top, overlap, size)
    return curves.summary(m, curves.positives(truths, areas, size))
