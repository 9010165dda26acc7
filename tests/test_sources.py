"""Readers, writers and the packing stream on small files."""

import json

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import packing, reports
from lumenfold.sources import records
from lumenfold.streaming import packer


def test_lines_with_bad_ones_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "image": ["x"]}\n{bad\n{"id": 2, "image": ["y"]}\n')
    good, bad = records.quarantined(records.read_lines(spark, str(tmp_path / "a.jsonl"), records.INSTRUCTION).cache())
    assert sorted(r["id"] for r in good.collect()) == [1, 2] and bad.count() == 1


COCO = {
    "images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 10}, {"id": 2, "file_name": "b.jpg", "width": 10, "height": 10}],
    "annotations": [{"id": 7, "image_id": 1, "category_id": 3, "bbox": [1, 1, 4, 4]}, {"id": 5, "image_id": 1, "category_id": 9, "bbox": [0, 0, 2, 2]}, {"id": 8, "image_id": 2, "category_id": 3, "bbox": [1, 1, 0, 4]}],
    "categories": [{"id": 3, "name": "Tree-merged"}],
}


def test_coco_to_instructions(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(COCO))
    rows = records.ADAPTERS["coco"](spark, str(tmp_path / "c.json")).collect()
    assert len(rows) == 1 and [(b["phrase"], b["bbox"]) for b in rows[0]["boxes"]] == [("", [0, 0, 2, 2]), ("tree", [1, 1, 5, 5])]
    flat = spark.createDataFrame([("a", 10, 10, 0, "x", [1.0, 1.0, 5.0, 12.0]), ("a", 10, 10, 1, "y", [0.0, 0.0, 1.0, 1.0]), ("b", 10, 10, 0, "x", [0.0, 0.0, 1.0, 1.0])], "image string, width int, height int, pos int, phrase string, bbox array<double>")
    out = records.instructions(flat, F.lit("Find {categories}."), 4).orderBy("id").collect()
    assert [r["id"] for r in out] == [4, 5]
    assert out[0]["conversations"][0]["value"] == "Find x, y."
    assert out[0]["conversations"][1]["value"] == "<p>x</p><bbox>[0.100, 0.100, 0.500, 0.999]</bbox><p>y</p><bbox>[0.000, 0.000, 0.100, 0.100]</bbox>"


def test_yolo_and_labelme(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 0.5 0.5 0.2 0.4\n9 0 0 1 1\nbad\n")
    r = records.yolo_boxes(spark, str(tmp_path / "a.txt"), ["cat", "dog"]).first()
    assert r["phrase"] == "dog" and r["bbox"] == pytest.approx([0.4, 0.3, 0.6, 0.7])
    (tmp_path / "l.json").write_text(json.dumps({"imagePath": "p.jpg", "imageWidth": 9, "imageHeight": 9, "shapes": [{"label": "q", "points": [[3, 1], [1, 4], [2, 2]]}]}))
    assert records.labelme_boxes(spark, str(tmp_path / "l.json")).first()["bbox"] == [1, 1, 3, 4]


def test_checked_write_and_numbered_append(spark, tmp_path):
    d = spark.createDataFrame([(i,) for i in range(5)], "a int")
    with pytest.raises(ValueError):
        records.write_checked(d, str(tmp_path / "o"), 6)
    assert records.write_checked(d, str(tmp_path / "o"), 5) == 5
    for _ in range(2):
        records.append_numbered(d, str(tmp_path / "n"), "a")
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "n")).collect()) == list(range(10))


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema, source = "key long, tokens long, grp string", str(tmp_path / "in")
    seen = []
    for part in range(3):
        spark.createDataFrame([(i, i % 40 + 1, "g") for i in range(part * 200, part * 200 + 200)], schema).coalesce(1).write.mode("append").parquet(source)
        s = packer.packed_stream(spark.readStream.schema(schema).parquet(source), 2, packing.Limits(100, 120, 90, 40, 5))
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        keys = [k for r in rows for k in r["keys"]]
        assert len(keys) == len(set(keys)) > len(seen)
        assert all(r["tokens"] <= 120 for r in rows)
        seen = keys
    rest = packer.rest_packs(spark, str(tmp_path / "c"), packing.Limits(100, 120, 90, 40, 5)).collect()
    assert sorted(seen + [k for r in rest for k in r["keys"]]) == list(range(600))
    assert len({(r["shard"], r["pack"]) for r in rows + rest}) == len(rows) + len(rest)


def test_checked_write_keeps_one_output(spark, tmp_path):
    for n in (3, 7):
        records.write_checked(spark.range(n), str(tmp_path / "o"), n)
        assert spark.read.json(str(tmp_path / "o")).count() == n
    assert sorted(p.name for p in tmp_path.iterdir()) == ["o"]


def test_a_report_never_drops_rows(spark):
    with pytest.raises(ValueError, match="more than 5 rows"):
        reports.markdown(spark.range(6), 5)
    assert reports.markdown(spark.range(5), 5).count("\n") == 6


def test_images_are_judged_by_one_aggregate_and_one_join(spark, tmp_path):
    from lumenfold.plans import frames

    rows = [(1, 1, 1, 1, 5000.0, 0.1, 0.1), (2, 1, 1, 1, None, 0.1, 0.1), (3, 1, 2, 1, 1.0, 0.0, 0.0), (4, 1, None, 1, 5000.0, 0.1, 0.1)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    d = frames.sound_images(spark, str(tmp_path))
    assert sorted((r["l_orderkey"], r["depth_sound"], r["normals_sound"]) for r in d.collect()) == [(1, False, True), (2, False, True)]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
