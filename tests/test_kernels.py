"""Hand-computed cases of the metric kernels and parsers."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import boxes, text
from lumenfold.operators import clouds, curves, dense, matching, mixture, packing, reports, segments


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def lit(s):
    return F.lit(s)


def test_repeated_label_replaces(spark):
    t = "<p>a</p><bbox>[0.1,0.1,0.2,0.2]</bbox><p>a</p><bbox>[0.3,0.3,0.4,0.4]</bbox>"
    assert [(r["label"], r["items"]) for r in one(spark, text.parse_boxes(lit(t)))] == [("a", [[0.3, 0.3, 0.4, 0.4]])]


def test_parser_clips_and_skips(spark):
    t = "<p>A-other</p><bbox>[-0.1, 0.5, 1.2, 0.999]</bbox><bbox>[1,2]</bbox><p>b<bbox>[0,0,1,1]</bbox>"
    assert [(r["label"], r["items"]) for r in one(spark, text.parse_boxes(lit(t)))] == [("a", [[0.0, 0.5, 0.999, 0.999]])]
    assert one(spark, text.parse_boxes(lit(""))) == []
    assert one(spark, text.parse_points(lit("<p>x</p><point>[0.5, 0.25]</point>")))[0]["items"] == [[0.5, 0.25]]


def test_keypoints_add_up(spark):
    t = "<p>man</p>left eye<kpt>[0.1,0.2]</kpt>nose<kpt>unvisible</kpt><p>man</p>nose<kpt>[0.3,2]</kpt>"
    got = [tuple(r) for r in one(spark, text.parse_keypoints(lit(t)))]
    assert got == [("man", "left eye", 0.1, 0.2), ("man", "nose", -1.0, -1.0), ("man", "nose", 0.3, 0.999)]


def test_touching_boxes_and_buckets(spark):
    assert one(spark, boxes.iou(arr(0, 0, 1, 1), arr(1, 0, 2, 1))) == 0.0
    assert one(spark, boxes.iou(arr(0, 0, 2, 2), arr(1, 0, 3, 2))) == pytest.approx(1 / 3)
    assert one(spark, boxes.size_bucket(F.lit(1023.9))) == "small" and one(spark, boxes.size_bucket(F.lit(1024.0))) == "medium"
    assert one(spark, boxes.polygon_area(arr(0, 0, 4, 0, 4, 3))) == 6.0
    assert one(spark, boxes.polygon_box(arr(0, 1, 4, 0, 4, 3))) == [0, 0, 4, 3]
    assert one(spark, boxes.auto_scaled(arr(0.1, 0.2, 0.5, 1.2), F.lit(100.0), F.lit(50.0))) == [10, 10, 50, 50]


def test_greedy_takes_the_best_and_may_steal(spark):
    m = F.array(arr(0.9, 0.8), arr(0.95, 0.1))
    assert one(spark, matching.greedy(m, F.lit(0.5))) == [0, -1]
    assert one(spark, matching.greedy(F.array(arr(0.7, 0.7)), F.lit(0.5))) == [0]
    assert one(spark, matching.best_pairs(F.array(arr(0.5, 0.9), arr(0.4, 0.8)))) == [0.9, 0.4]


def test_keypoint_similarity_by_name_and_by_place(spark):
    import math

    k = lambda *ps: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for n, x, y in ps])
    g, p = k(("a", 0, 0), ("b", 1, 1), ("c", 5, 5)), k(("c", 5, 6), ("a", 0, 0.5))
    want = (math.exp(-0.25 / (0.00125 * 900)) + math.exp(-1 / (0.00125 * 900))) / 2
    assert one(spark, matching.oks(g, p, F.lit(900.0))) == pytest.approx(want)
    at = lambda x: matching.aligned(x, ["a", "b", "c"])
    assert one(spark, matching.oks_aligned(at(g), at(p), F.lit(900.0))) == pytest.approx(want)
    assert one(spark, matching.oks(g, k(("z", 0, 0)), F.lit(900.0))) == 0.0


SAMPLE = "sample_id int, gt array<struct<cat:string,box:array<double>>>, pred array<struct<cat:string,box:array<double>>>"
BOX = [0.0, 0.0, 2.0, 2.0]


@pytest.mark.parametrize(
    ("gt", "pred", "mode", "recall", "precision"),
    [
        ([("a", BOX)], [("a", BOX), ("b", BOX)], "pooled", 1.0, 0.5), ([], [], "pooled", 1.0, 1.0), ([], [("a", BOX)], "pooled", 0.0, 0.0), ([], [], "by_category", 0.0, 0.0),
        ([("a", BOX)], [("b", BOX)], "pooled", 0.0, 0.0), ([("a", BOX)], [("b", BOX)], "referring", 1.0, 1.0), ([("a", BOX)], [("a", None)], "pooled", 0.0, 0.0), (None, None, "pooled", 1.0, 1.0),
    ],
)
def test_detection_edge_cases(spark, gt, pred, mode, recall, precision):
    r = matching.detection_counts(spark.createDataFrame([(1, gt, pred)], SAMPLE), (0.5,), mode).first()
    assert (r["recall"], r["precision"]) == (recall, precision)


def test_average_precision_reads_strictly_greater_recall(spark):
    t = spark.createDataFrame([(1, "a", i, [i * 10.0, 0.0, i * 10.0 + 5, 5.0], False, False) for i in range(2)], "image int, cat string, pos int, box array<double>, crowd boolean, ignore boolean")
    d = spark.createDataFrame([(1, "a", 0, [0.0, 0.0, 5.0, 5.0], 0.9, False), (1, "a", 1, [50.0, 50.0, 55.0, 55.0], 0.8, False), (1, "a", 2, [10.0, 0.0, 15.0, 5.0], 0.7, False)], "image int, cat string, pos int, box array<double>, score double, skip boolean")
    ap = curves.average_precision(curves.match_detections(t, d, (0.5,)), curves.positives(t), (0.5,)).first()
    assert ap["recall"] == 1.0
    assert ap["ap"] == pytest.approx((50 * 1.0 + 50 * 2 / 3) / 101)  # recalls 0 to 0.49 see precision 1, 0.50 to 0.99 see 2/3, 1.00 nothing


def test_federated_ap_has_no_cap_on_detections(spark, monkeypatch):
    from lumenfold.plans import scoring

    box = lambda i: [i * 10.0, 0.0, i * 10.0 + 5, 5.0]
    t = spark.createDataFrame([(1, "A", i, box(i), False, False) for i in range(130)], "image int, cat string, pos int, box array<double>, crowd boolean, ignore boolean")
    d = spark.createDataFrame([(1, "A", i, box(i), 1 - i / 1000, False) for i in range(130)], "image int, cat string, pos int, box array<double>, score double, skip boolean")
    monkeypatch.setattr(scoring, "_truths", lambda *_: t)
    monkeypatch.setattr(scoring, "_detections", lambda *_: d)
    assert {r["ap"] for r in scoring.lvis_federated_ap(spark, "").collect()} == {round(100 / 101, 6)}
    capped = curves.average_precision(curves.match_detections(t, d, (0.5,)), curves.positives(t), (0.5,)).first()
    assert capped["recall"] == pytest.approx(100 / 130)  # the COCO rule


def brute_ap(tp, npos):
    c, rows = 0, []
    for n, hit in enumerate(tp, 1):
        c += hit
        rows.append((c / npos, c / n))
    return sum(max((p for r, p in rows if r > k / 100 + 1e-12), default=0.0) for k in range(101)) / 101


def test_average_precision_matches_brute_force(spark):
    tp = [1, 0, 1, 1, 0, 0, 1, 0, 1, 1, 1, 0]
    m = spark.createDataFrame([("c", "all", 0.5, i, 1, 1.0 - i / 20, h, 1 - h) for i, h in enumerate(tp)], "cat string, area string, iou double, image int, rank int, score double, tp int, fp int")
    n = spark.createDataFrame([("c", "all", 11), ("none", "all", 3)], "cat string, area string, npos long")
    got = {r["cat"]: r["ap"] for r in curves.average_precision(m, n, (0.5,)).collect()}
    assert got["c"] == pytest.approx(brute_ap(tp, 11)) and got["none"] == 0.0


def test_curves_sort_each_detection_once_and_spread(spark, monkeypatch):
    """A row a detection, whatever the thresholds and areas; ranges of a few rows give the same figures."""
    rng = random.Random(3)
    box = lambda i, d=0.0: [i * 100.0 + d, d, i * 100.0 + d + (20 if i % 2 else 60), d + 30.0]
    t = spark.createDataFrame([(k, "A", i, box(i), False, i == 3) for k in range(20) for i in range(4)], "image int, cat string, pos int, box array<double>, crowd boolean, ignore boolean")
    found = [(k, "A", i, box(i, float(rng.randrange(12))), rng.randrange(9) / 9, False) for k in range(20) for i in range(5)]
    d = spark.createDataFrame(found, "image int, cat string, pos int, box array<double>, score double, skip boolean")
    grid, areas = (0.5, 0.75, 0.9), tuple(curves.AREAS)
    codes = curves.match_codes(t, d, grid, areas)
    rows = codes.collect()
    assert len(rows) == len(found) and {len(r["codes"]) for r in rows} == {12}
    npos = curves.positives(t, areas)
    monkeypatch.setattr(curves, "RANGE", 7)
    got = {(r["area"], r["iou"]): (r["ap"], r["recall"]) for r in curves.average_precisions(codes, npos, grid, areas).collect()}
    long = curves.average_precision(curves.match_detections(t, d, grid, areas), npos, grid).collect()
    rows.sort(key=lambda r: (-r["score"], r["image"], r["rank"]))
    for n in npos.collect():
        for i, v in enumerate(grid):
            c = areas.index(n["area"]) * len(grid) + i
            tp = [r["codes"][c] - 2 for r in rows if r["codes"][c]]
            want = (pytest.approx(brute_ap(tp, n["npos"])), pytest.approx(sum(tp) / n["npos"]))
            assert got[n["area"], v] == want and {(r["ap"], r["recall"]) == want for r in long if (r["area"], r["iou"]) == (n["area"], v)} == {True}


@pytest.mark.parametrize(("shared", "rest", "tp"), [(8, 2, 1), (2, 1, 0)])
def test_panoptic_quality(spark, shared, rest, tp):
    cells = spark.createDataFrame([(1, 1, 1, shared), (1, 1, 2, rest), (1, 2, 1, rest)], "image int, gt int, pred int, n int")
    gt = spark.createDataFrame([(1, 1, 0, False)], "image int, id int, cat int, crowd boolean")
    pr = spark.createDataFrame([(1, 1, 0)], "image int, id int, cat int")
    q = segments.panoptic_quality(segments.panoptic_counts(cells, gt, pr)).first()
    assert q["tp"] == tp and (q["pq"] == pytest.approx(8 / 12) if tp else (q["fp"], q["fn"]) == (1, 1))


def test_depth_alignment_and_silog(spark):
    d = spark.createDataFrame([(1, float(g), (g - 1) / 2, True) for g in range(2, 9)], "sample int, gt double, pred double, valid boolean")
    e = dense.depth_errors(dense.align_depth(d)).first()
    assert e["abs_rel"] == pytest.approx(0, abs=1e-9) and e["delta1"] == 1.0
    twice = dense.depth_errors(d.withColumn("pred", F.col("gt") * 2)).first()
    assert twice["silog"] == pytest.approx(0, abs=1e-6) and twice["abs_rel"] == pytest.approx(1.0)


def test_pose_auc(spark):
    from lumenfold.plans.scoring import pose_scores

    e = spark.createDataFrame([(x, 0.0) for x in (0.5, 4.2, 5.0, 7.0)], "r_err double, t_err double")
    assert pose_scores(e).first()["auc_5"] == pytest.approx(35.0)


def test_poses_and_clouds_take_every_row(spark, tmp_path):
    from lumenfold.plans import scoring

    lines = [(o, n, o * 3 + n, o + 2 * n) for o in range(1, 10) for n in range(1, o % 4 + 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    points = [(i, [float(i % 7), float(i * i % 5), float(i % 3)], i % 4) for i in range(80)]
    spark.createDataFrame(points, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    frames = [o % 4 + 2 for o in range(1, 10)]
    assert scoring.pose_pairs_auc(spark, str(tmp_path)).first()["pairs"] == sum(n * (n - 1) // 2 for n in frames)
    found = {r["seq"]: r["scale"] for r in scoring.umeyama_align(spark, str(tmp_path)).collect()}
    assert found == pytest.approx({k: 2.0 for k in range(4)})
    assert {r["seq"]: r["points"] for r in scoring.icp_refinement(spark, str(tmp_path)).collect()} == {k: 20 for k in range(4)}


def test_runs(spark):
    a, b = F.array(*[F.lit(x) for x in (2, 3, 1, 4)]), F.array(*[F.lit(x) for x in (3, 4, 10)])
    assert one(spark, text.run_area(a)) == 7
    assert one(spark, text.run_overlap(a, b)) == 3  # 2..5 and 6..10 against 3..7


def test_fact_key_and_scores(spark):
    assert one(spark, reports.fact_key(lit("m 1"), lit("Seg"), lit("a/b"), lit("mIoU"))) == "m_1__Seg__a-b__mIoU"
    assert one(spark, reports.shown_score(F.lit(0.5))) == "50" and one(spark, reports.shown_score(F.lit(12.345))) in ("12.35", "12.34")
    assert [one(spark, reports.to_number(lit(x))) for x in ("1.5", "nan", " None ", "x")] == [1.5, None, None, None]


def test_shards(spark):
    n = [r["s"] for r in spark.range(10).select(mixture.ceil_shard(F.col("id"), F.lit(10), 4).alias("s")).collect()]
    assert n == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert [r["s"] for r in spark.range(10).select(mixture.floor_shard(F.col("id"), F.lit(10), 4).alias("s")).collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 3, 3]


def test_three_places_like_printf(spark):
    for v in (0.0625, 0.1875, 0.3, 0.9995, 1.0, 0.0005):
        assert one(spark, text.three_places(F.lit(v))) == "%.3f" % v


def test_packer_keeps_every_sample():
    limits = packing.Limits(soft=100, hard=120, sample=90, prefer_buffer=40, buffer=3)
    rows = [(i, (i * 37) % 95 + 1, "m" if i % 7 == 0 else "g") for i in range(200)]
    p = packing.Packer(limits, ("m",))
    packs = [*p.feed(rows), *p.rest()]
    assert sorted(s[0] for q in packs for s in q) == sorted(s[0] for s in rows if s[1] <= 90)
    assert all(sum(s[1] for s in q) <= 120 for q in packs)


def test_nearest_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(60, 3)), rng.normal(size=(40, 3)) * 3
    frame = lambda p: spark.createDataFrame([(1, *map(float, r)) for r in p], "seq int, x double, y double, z double")
    got = sorted(r["distance"] for r in clouds.nearest(frame(a), frame(b), 0.3).collect())
    assert got == pytest.approx(sorted(np.sqrt(((a[:, None] - b) ** 2).sum(2)).min(1)))


def test_umeyama_finds_the_motion(spark):
    p = spark.createDataFrame([(1, float(i), float(i * i % 5), float(i % 3)) for i in range(9)], "seq int, x double, y double, z double")
    m = clouds.umeyama(p.select("*", (-2 * F.col("y") + 1).alias("nx"), (2 * F.col("x") - 1).alias("ny"), (2 * F.col("z") + 0.5).alias("nz"))).first()
    assert m["scale"] == pytest.approx(2) and m["shift"] == pytest.approx([1, -1, 0.5]) and m["rotation"] == pytest.approx([0, -1, 0, 1, 0, 0, 0, 0, 1], abs=1e-9)


def test_numbers_and_curves_spread_over_ranges(spark):
    """A group that holds most rows lies in several ranges; numbers and precision don't show it."""
    from lumenfold.operators import numbering

    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    old = {k: spark.conf.get(k) for k in keys}
    rows = [("hot" if i % 10 else None if i % 20 else "cold", (i * 37) % 400 // 4, i) for i in range(400)]
    rng = random.Random(5)
    hits = [("A" if i % 9 else "B", "all", 0.5, i, 1, round(rng.random(), 1), int(rng.random() < 0.6)) for i in range(500)]
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, "g string, x int, i int")
        ranged = numbering.in_ranges(df, ["g"], ["x", "i"])
        assert ranged.where("g = 'hot'").select("__p").distinct().count() > 1
        got = {(r.g, r.i): r.at for r in numbering.number_within(df, ["g"], ["x", "i"], "at").collect()}
        matches = spark.createDataFrame([(*h, 1 - h[-1]) for h in hits], "cat string, area string, iou double, image int, rank int, score double, tp int, fp int")
        npos = spark.createDataFrame([("A", "all", 400), ("B", "all", 60), ("C", "all", 1)], "cat string, area string, npos long")
        ap = {r.cat: (r.ap, r.recall) for r in curves.average_precision(matches, npos, (0.5,)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {}
    for g in ("hot", "cold", None):
        for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            want[g, i] = n
    assert got == want
    for cat, positives in (("A", 400), ("B", 60)):
        tps = [h[-1] for h in sorted((h for h in hits if h[0] == cat), key=lambda h: (-h[5], h[3], h[4]))]
        upto = [sum(tps[: k + 1]) for k in range(len(tps))]
        precision = [t / (k + 1) for k, t in enumerate(upto)]
        seen = [max((p for p, t in zip(precision, upto, strict=True) if 100 * t > q * positives), default=0.0) for q in range(101)]
        assert ap[cat][0] == pytest.approx(sum(seen) / 101) and ap[cat][1] == pytest.approx(upto[-1] / positives)
    assert ap["C"] == (0.0, 0.0)


def test_shards_grow_with_the_samples(spark):
    assert packing.shards_for(spark.range(0)) == packing.shards_for(spark.range(8 * packing.SHARD_ROWS)) == 8
    assert packing.shards_for(spark.range(8 * packing.SHARD_ROWS + 1)) == 9


def test_visible_counts_are_those_of_the_rule(spark):
    from lumenfold.operators import selection

    rng, rows = random.Random(2), []
    for doc in range(30):
        at = rng.randrange(5)
        for block in range(rng.randrange(1, 6)):
            kind = rng.randrange(4)
            for _ in range(rng.randrange(1, 5)):
                rows.append((doc, at, block if kind in (1, 3) else -1, block if kind in (2, 3) else -1))
                at += 1
    d = spark.createDataFrame(rows, "doc int, at int, full int, noise int")
    see = lambda q, k: q[0] == k[0] and (k[1] <= q[1] or (q[2] == k[2] and q[2] >= 0)) and not (k[3] >= 0 and k[3] != q[3])
    got = {(r["doc"], r["at"]): r["sees"] for r in selection.visible_counts(d).collect()}
    assert got == {q[:2]: sum(see(q, k) for k in rows) for q in rows}
    of = lambda p: {c: F.col(f"{p}{c}") for c in ("doc", "at", "full", "noise")}
    pairs = d.select(*[F.col(c).alias(f"q{c}") for c in d.columns]).join(d.select(*[F.col(c).alias(f"k{c}") for c in d.columns]), F.col("qdoc") == F.col("kdoc"))
    assert pairs.where(selection.attends(of("q"), of("k"))).count() == sum(got.values())


def test_dense_cells_make_the_grid_finer(spark, monkeypatch):
    import numpy as np

    from lumenfold.operators import clouds

    rng = np.random.default_rng(6)
    cloud = lambda n: [(1, *map(float, v)) for v in np.concatenate([rng.normal(0, 0.01, (n, 3)), rng.normal(0, 3, (n // 5, 3))])]
    a, b = cloud(60), cloud(80) + [(1, 0.5, 0.5, 0.5)] * 30
    monkeypatch.setattr(clouds, "CELL", 5)
    d = lambda rows: spark.createDataFrame(rows, "seq int, x double, y double, z double")
    assert clouds.fine_side(d(b), 4.0) < 0.1  # thirty equal points never part
    got = {(r["x"], r["y"], r["z"]): r["distance"] for r in clouds.nearest(d(a), d(b), 4.0).collect()}
    want = {p[1:]: min(sum((u - v) ** 2 for u, v in zip(p[1:], q[1:], strict=True)) ** 0.5 for q in b) for p in a}
    assert got == pytest.approx(want)


def test_nearest_takes_as_many_steps_for_far_clouds(spark, monkeypatch):
    """Leaves, groups, copies and ties against brute force; far clouds need no more jobs than near ones."""
    import numpy as np

    from lumenfold.operators import clouds

    monkeypatch.setattr(clouds, "CELL", 6)
    monkeypatch.setattr(clouds, "GROUP", 4, raising=False)
    rng = np.random.default_rng(3)
    whole = lambda n, s, at: [(s, *(float(v) for v in r)) for r in rng.integers(0, 6, (n, 3)) + at]  # noqa: E731  # many ties
    d = lambda rows: spark.createDataFrame(rows, "seq string, x double, y double, z double")
    jobs = {}
    for at in (0, 5000):
        a = whole(90, "a", at) + whole(3, "b", 0) + whole(2, "c", 0) + [("a", None, 1.0, 1.0)]
        b = whole(120, "a", 0) + whole(4, "b", 0) + [("a", None, None, 1.0)]
        spark.sparkContext.setJobGroup(f"clouds{at}", "")
        got = sorted(tuple(r) for r in clouds.nearest(d(a), d(b), 0.5).collect())
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs[at] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"clouds{at}"))
        want = []
        for p in a:
            near = [(sum((u - v) ** 2 for u, v in zip(p[1:], q[1:], strict=True)), *q[1:]) for q in b if q[0] == p[0] and None not in (*p, *q)]
            want += [(*p, *min(near)[1:], min(near)[0] ** 0.5)] if near else []
        assert got == sorted(want)
    assert jobs[5000] <= jobs[0] + 3
