"""The router's plan and its rules for odd samples."""

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import router

KIND = "task string, dataset string, gt array<struct<cat:string,box:array<double>>>, pred array<struct<cat:string,box:array<double>>>"
BOX = [0.0, 0.0, 10.0, 10.0]


def test_all_tasks_are_one_shuffle(spark, tmp_path):
    rows = [(t, "d", [("a", BOX)], [("a", BOX)]) for t in ("hallucination", "gui", "pointing", "other", "referring_object_detection")]
    spark.createDataFrame(rows, KIND).write.parquet(str(tmp_path / "s"))
    out = router.routed_scores(spark.read.parquet(str(tmp_path / "s")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") == 1 and plan.count("FileScan") == 1
    got = {r["task"]: r for r in out.where("iou = 0.5").collect()}
    assert got["hallucination"]["accuracy"] == 0 and got["gui"]["accuracy"] == 1 and got["other"]["recall"] == 1
    assert got["hallucination"]["wrong_rejection"] is None and got["pointing"]["count_mae"] is None


def test_odd_samples(spark):
    rows = [
        ("hallucination", "a", [], []), ("hallucination", "b", None, [("x", None)]), ("x", "none", None, None), ("x", "none2", [], [("a", BOX)]),
        ("x", "null", [("a", BOX)], [("A", None)]), ("common_object_detection", "letters", [("A-b 1", BOX)], [("ab", BOX)]), ("x", "under", [("a_b", BOX)], [("A B", BOX)]),
        ("pointing_referring", "p", [("a", BOX)], [("zzz", [5.0, 5.0]), ("a", [5.0, 5.0])]), ("gui", "g", [("a", BOX)], [("q", [3.0, 3.0])]), ("gui", "empty", [], [("q", [3.0, 3.0])]),
    ]
    got = {(r["task"], r["dataset"]): r for r in router.routed_scores(spark.createDataFrame(rows, KIND), (0.5,)).collect()}
    f = lambda k, *c: [got[k][x] for x in c]
    assert f(("hallucination", "a"), "accuracy") == [1] and f(("hallucination", "b"), "accuracy", "n_pred") == [1, 0]
    assert f(("x", "none"), "recall", "precision", "follows") == [1, 1, 1] and f(("x", "none2"), "recall", "precision", "follows") == [0, 0, 0]
    assert f(("x", "null"), "recall", "wrong_rejection", "follows") == [0, 1, 1]
    assert f(("common_object_detection", "letters"), "recall", "follows") == [1, 1] and f(("x", "under"), "recall", "follows") == [1, 0]
    assert f(("pointing_referring", "p"), "recall", "precision") == [1, 1]
    assert f(("gui", "g"), "accuracy") == [1] and f(("gui", "empty"), "accuracy") == [0]


def test_answers_without_entries(spark):
    kind = "task string, category string, width int, height int, truth string, answer string, note string"
    rows = [("x", None, 10, 10, None, "no tags", "k"), ("gui", None, 100, 100, "", None, "k"), ("visual_prompting", None, 100, 50, "<p>o1</p><bbox>[0.1,0.1,0.2,0.2]</bbox><p>o2</p><bbox>[0.3,0.3,0.4,0.4]</bbox>", "", "k")]
    got = [r.asDict(recursive=True) for r in router.answer_rows(spark.createDataFrame(rows, kind)).orderBy(F.length("task")).collect()]
    assert [(r["gt"], r["pred"], r["note"]) for r in got[:2]] == [([], [], "k")] * 2
    assert [e["cat"] for e in got[2]["gt"]] == ["unknown", "unknown"] and got[2]["gt"][1]["box"] == [30.0, 15.0, 40.0, 20.0]


def test_masks_by_the_one_entry_point(spark):
    from lumenfold.operators import runs

    kind = "image int, id long, start long, end long"
    t = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 200, 260), (2, 0, 0, 50)], kind)
    d = spark.createDataFrame([(1, 0, 0, 90), (1, 0, 95, 100), (1, 1, 400, 450), (2, 0, 0, 50)], kind)
    tb, fb = runs.overlap_boxes(t, d)
    truths = tb.select("image", F.lit("x").alias("cat"), F.col("id").alias("pos"), "box", F.lit(False).alias("crowd"), F.lit(False).alias("ignore"))
    found = fb.select("image", F.when(F.col("image") == 2, "y").otherwise("x").alias("cat"), F.col("id").alias("pos"), "box", (F.lit(0.9) - F.col("id") / 10).alias("score"), F.lit(False).alias("skip"))
    # of three truths one is found in its category, at an overlap of 0.95, and the second by another name
    one = router.evaluate(truths, found, "masks").first()
    every = router.evaluate(truths, found, "masks", agnostic=True).first()
    assert round(one["ar100"], 6) == round(1 / 3, 6) and round(every["ar100"], 6) == round(2 / 3, 6) and every["ar1"] == every["ar100"]
    assert round(every["ap50"], 4) == round(67 / 101, 4)
    known = spark.createDataFrame([(1, "x")], "image int, cat string")
    assert router.evaluate(truths, found, "masks", negatives=known).first()["ar100"] == one["ar100"]


@pytest.mark.parametrize("name", ["oks_prf1", "routed_tasks"])
def test_scores_are_computed_once_for_all_thresholds(spark, tmp_path, name):
    """Keypoint similarities stand below the step that makes a row for each threshold."""
    from lumenfold.plans import catalogue

    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string"
    spark.createDataFrame([(1, 1, 5, 6, 7.0, 0.1, "A")], kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first = lambda mark: min(i for i, line in enumerate(plan) if mark in line)
    assert first("explode([0.5,") < first("EXP(")


def test_candidates_match_as_the_whole_matrix_does(spark):
    import random

    from lumenfold.operators import matching

    rnd = random.Random(5)
    value = lambda: rnd.choice([0.0, 0.3, 0.5, 0.5, 0.7, 0.7, 0.9, float("nan"), None])
    rows = [([[value() for _ in range(p)] for _ in range(g)],) for g in range(5) for p in range(5) for _ in range(8)]
    d = spark.createDataFrame(rows, "m array<array<double>>")
    for t in (0.5, 0.7, 0.95):
        assert d.where(matching.n_matched(F.col("m"), F.lit(t)) != matching.n_taken(matching.candidates(F.col("m"), 0.5), F.lit(t))).count() == 0


def test_answers_are_parsed_in_one_pass(spark, tmp_path):
    """Neither side has a scan of its own, and no test of sizes parses the texts before."""
    from lumenfold.plans import routing

    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string"
    spark.createDataFrame([(1, 1, 5, 6, 7.0, 0.1, "A")], kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = routing.detection_rows(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    assert not [line for line in plan.split("\n") if "Filter" in line and "split(" in line]
