"""Readers of further layouts, writers, and small functions by hand-made cases."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import boxes, geometry, text
from lumenfold.operators import clouds, dense, instances, joins, reports
from lumenfold.plans.more import binned_auc
from lumenfold.sources import layouts, records


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_record_and_text_boxes(spark, tmp_path):
    rows = spark.createDataFrame([("a", 100, 50, [([0.1, 0.2, 0.5, 0.8], "x"), ([5.0, 5.0, 5.0, 9.0], "flat"), ([10.0, 5.0, 20.0, 70.0], "y"), ([1.0], "bad")])], "image string, w int, h int, bs array<struct<bbox:array<double>,phrase:string>>")
    got = [(r["pos"], r["phrase"], r["bbox"]) for r in layouts.record_boxes(rows, ["image"], "bs", "w", "h").orderBy("pos").collect()]
    assert got == [(0, "x", pytest.approx([10, 10, 50, 40])), (2, "y", [10, 5, 20, 50])]
    assert one(spark, layouts.nested_boxes(F.array(F.array(arr(1, 2), arr(3, 4))))) == [[1, 2, 3, 4]]
    (tmp_path / "a.txt").write_text("﻿1,2,5,2,5,4,1,4,hello, you\nbad,2,5,2,5,4,1,4,x\n1,2\n")
    r = layouts.text_boxes(spark, str(tmp_path / "a.txt"), "quad_comma").collect()
    assert [(x["text"], x["bbox"]) for x in r] == [("hello, you", [1, 2, 5, 4])]


def test_parquet_annotations_and_cursor(spark, tmp_path):
    at = str(tmp_path / "p")
    spark.createDataFrame([(i, [(f"c{i}", None), ("d", 2)]) for i in range(6)], "id int, anns array<struct<cat:string,n:int>>").repartition(2).write.parquet(at)
    rows = layouts.annotation_batches(spark, at, "anns", {"n": 7, "crowd": False}).collect()
    assert len(rows) == 12 and {(r["n"], r["crowd"]) for r in rows} == {(7, False), (2, False)}
    every = [(r["src"], r["row"]) for r in layouts.rows_behind(spark, at, None).orderBy("src", "row").collect()]
    behind = [(r["src"], r["row"]) for r in layouts.rows_behind(spark, at, every[1]).orderBy("src", "row").collect()]
    assert behind == every[2:]


def test_compressed_sequences_and_cameras(spark, tmp_path):
    (tmp_path / "s.jgz").write_bytes(gzip.compress(json.dumps([{"seq": "a", "n": 1}, {"seq": "b", "n": 2}]).encode()))
    assert [(r["seq"], r["n"]) for r in layouts.gzipped_json(spark, str(tmp_path / "s.jgz"), "seq:string,n:int").orderBy("pos").collect()] == [("a", 1), ("b", 2)]
    (tmp_path / "cam.txt").write_text("extrinsic\n" + "1 0 0 0.5\n0 1 0 -2e-1\n0 0 1 3\n0 0 0 1\n\nintrinsic\n500 0 320\n0 500 240\n0 0 1\n\n0.5 0.01\n")
    c = layouts.camera_files(spark, str(tmp_path / "cam.txt")).first()
    assert c["extrinsic"][3] == 0.5 and c["extrinsic"][7] == -0.2 and c["intrinsic"] == [500, 0, 320, 0, 500, 240, 0, 0, 1] and (c["depth_min"], c["depth_step"]) == (0.5, 0.01)
    (tmp_path / "images.txt").write_text("# comment\n1 1 0 0 0 0.1 0.2 0.3 4 a b.jpg\n10.5 20 -1 30 40 7 1 2 3 4 5\n")
    assert [(r["image_id"], r["t"], r["camera_id"], r["name"]) for r in layouts.colmap_images(spark, str(tmp_path / "images.txt")).collect()] == [(1, [0.1, 0.2, 0.3], 4, "a b.jpg")]
    (tmp_path / "t.txt").write_text("http://video\n7 0.5 0.6 0.5 0.5 0 0 " + " ".join(map(str, range(12))) + "\n")
    assert [(r["stamp"], r["m"][3]) for r in layouts.trajectory_lines(spark, str(tmp_path / "t.txt")).collect()] == [(7, 3.0)]


def test_points_shards_and_names(spark, tmp_path):
    p = spark.createDataFrame([("a", 1, 0.0, 1.0), ("a", 2, 2.0, 3.0), ("b", 1, 4.0, 5.0), ("a", 9, 0.0, 0.0)], "image string, id int, x double, y double")
    s, l = spark.createDataFrame([("a", "train"), ("b", "test")], "image string, split string"), spark.createDataFrame([(1, "cup"), (2, "cup")], "id int, label string")
    assert [(r["image"], r["label"], r["points"]) for r in layouts.point_annotations(p, s, l, "train").collect()] == [("a", "cup", [[0, 1], [2, 3]])]
    layouts.write_shards(spark.range(50), str(tmp_path / "o"), 3, "id")
    assert spark.read.json(str(tmp_path / "o")).count() == 50 and sorted(x.name for x in (tmp_path / "o").glob("shard=*")) == ["shard=000", "shard=001", "shard=002"]
    assert layouts.free_name(spark, str(tmp_path / "o")) == str(tmp_path / "o_v2") and layouts.free_name(spark, str(tmp_path / "q")) == str(tmp_path / "q")


def test_small_readers(spark, tmp_path):
    t = {"annotations": spark.createDataFrame([(1, 7, [1.0, 2.0, 2.0, 0.0, 0.0, 0.0]), (1, 7, [1.0, 2.0, 2.0, 0.0, 0.0, 0.0])], "id long, image_id long, keypoints array<double>")}
    assert [(r["image_id"], r["name"], r["x"]) for r in records.coco_keypoints(t, ["nose", "eye"]).collect()] == [(7, "nose", 1.0)]
    d = spark.createDataFrame([(1, [(1,), (None,)]), (2, [(3,)])], "id int, a array<struct<k:int>>")
    assert [r["id"] for r in records.all_have_keypoints(d, "a", "k").collect()] == [2]
    (tmp_path / "c.csv").write_text('n,"{""a"": 3}"\n')
    assert records.csv_with_json(spark, str(tmp_path / "c.csv"), "a int").first()["payload"]["a"] == 3
    assert [(r["bbox"], r["category"]) for r in records.parallel_lists(spark.createDataFrame([(1, [[1.0], [2.0]], ["x", "y"])], "i int, b array<array<double>>, c array<string>"), ["i"], "b", "c").collect()] == [([1.0], "x"), ([2.0], "y")]
    records.write_split(spark.range(5), F.when(F.col("id") != 2, F.col("id") % 2 == 0), str(tmp_path / "g"), str(tmp_path / "b"))
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "g")).collect()) == [0, 4] and spark.read.json(str(tmp_path / "b")).count() == 3


def test_texts(spark):
    c = F.lit("<p>a</p> (1, 2, 3) and <p>b</p> (1,2,3) <p>c</p> (4,5,6)")
    assert [tuple(r) for r in one(spark, text.colours(c))] == [("a", 1, 2, 3), ("b", 1, 2, 3), ("c", 4, 5, 6)]
    assert [(r["phrase"], r["r"]) for r in one(spark, text.colour_map(c))] == [("b", 1), ("c", 4)]
    assert one(spark, text.without_tags(F.lit("<p>x</p> (1, 2, 3)"))) == "x" and one(spark, text.strip_task(F.lit(" <task: seg>: go"))) == "go"
    assert one(spark, text.plain_caption(F.lit("'<p>A  cat</p> (1, 2,3) sits'"))) == "A cat sits"
    assert one(spark, text.safe_file_name(F.lit("a/b c.png"))).startswith("a_b_c.png_") and one(spark, text.rgb_of_id(F.lit(66051))) == [3, 2, 1]
    assert one(spark, text.parse_loose_boxes(F.lit("<BBOX>( 1, 2 ,3 4 )</bbox>"))) == [[1, 2, 3, 4]]
    assert one(spark, text.lower_keys(F.create_map(F.lit("A"), F.lit(1), F.lit("b"), F.lit(2), F.lit("a"), F.lit(3)))) == {"b": 2, "a": 3}
    names = F.array(*[F.lit(x) for x in ("coco_bbox_f1_mean", "coco_f1", "lvis_f1", "coco_bbox_f1")])
    assert one(spark, text.best_name(names, "f1", ["coco", "bbox"])) == "coco_bbox_f1" and one(spark, text.best_name(names, "zz", [])) is None
    assert [one(spark, text.dataset_kind(F.lit(x))) for x in ("gui.a", "visual.b", "coco")] == ["gui", "visual_prompting", "Detection"]
    many = "".join(f"<p>l{i % 30}</p><bbox>[0.{i}, 0, 1, 1]</bbox>" for i in range(10, 99))
    assert len(one(spark, text.parse_boxes(F.lit(many)))) == 30


def test_lower_keys_keep_the_first_place_and_the_last_value(spark):
    m = F.create_map(*[F.lit(v) for v in ("A", 1, "b", 2, "a", 3, "C", 4, "B", 5)])
    assert [tuple(e) for e in one(spark, F.map_entries(text.lower_keys(m)))] == [("a", 3), ("b", 5), ("c", 4)]
    assert one(spark, F.map_entries(text.lower_keys(F.create_map().cast("map<string,int>")))) == []
    assert one(spark, text.lower_keys(F.lit(None).cast("map<string,int>"))) is None


def test_boxes_masks_and_geometry(spark):
    assert one(spark, boxes.pixels(arr(0.1, 0.2, 0.5, 1), F.lit(10.0), F.lit(20.0))) == [1, 4, 5, 20]
    assert one(spark, boxes.keypoint_visible(F.lit(1.0), F.lit(1.0), F.lit(0))) is False and one(spark, geometry.lerp(arr(0, 2), arr(1, 4), F.lit(0.5))) == [0.5, 3]
    g = F.struct(F.lit("a").alias("cat"), F.array(F.struct(F.lit(4).alias("start"), F.lit(6).alias("end"))).alias("spans"), F.lit(4).alias("height"))
    p = lambda x, y: F.struct(F.lit("a").alias("cat"), arr(x, y).alias("box"))
    assert [one(spark, instances.in_runs(g, p(*xy))) for xy in ((1.9, 0.2), (1, 1), (1, 2), (0, 3))] == [True, True, False, False]
    assert one(spark, dense.normal_bytes(arr(-1, 0, 1))) == [0, 127, 255]
    e = spark.createDataFrame([(x,) for x in (0.0, 1.0, 4.9, 5.0, 6.0)], "e double")
    # bins of 5/6: 0, 1, 5, 5 and one beyond; cumulated over six bins
    assert e.select(binned_auc(F.col("e"), 5)).first()[0] == pytest.approx((6 + 5 + 1 + 1) / 6 / 5)


def test_names_and_tables(spark):
    f = lambda *x: spark.createDataFrame([(v,) for v in x], "path string")
    assert sorted(map(tuple, joins.paired_by_name(f("a/1.jpg", "b/Two.jpg", "c/3.jpg", "d/3.jpg"), f("a/1.jpg", "m/two.png", "m/3.png")).collect())) == [("a/1.jpg", "a/1.jpg"), ("b/Two.jpg", "m/two.png")]
    i = spark.createDataFrame([("x/1.jpg", 5)], "file string, id int")
    assert joins.by_base_name(f("q/1.jpg"), "path", i, "file").first()["id"] == 5
    with pytest.raises(Exception, match="no image for"):
        joins.by_base_name(f("q/2.jpg"), "path", i, "file").collect()
    assert sorted((r["path"], r["side"]) for r in joins.both_ways_missing(f("a", "b"), f("b", "c"), "path").collect()) == [("a", "left"), ("c", "right")]
    t = {"images": spark.createDataFrame([(1,), (2,)], "id int"), "categories": spark.createDataFrame([(5,), (6,)], "id int"), "annotations": spark.createDataFrame([(1, 2, 5), (2, 1, 6)], "id int, image_id int, category_id int")}
    got = joins.pruned(t, 1)
    assert [r["id"] for r in got["images"].collect()] == [2] and [r["id"] for r in got["categories"].collect()] == [5]
    pts = spark.createDataFrame([(1, float(k % 3), 0.0, 0.0) for k in range(30)] + [(1, 99.0, 0.0, 0.0)], "seq int, x double, y double, z double")
    assert clouds.outliers_dropped(pts).count() == 30
    assert reports.widened(spark.range(1).select("id"), spark.range(1).select("id", F.lit(1).alias("n"))).where("n is null").count() == 1
