"""Camera layouts against numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import masks, text
from lumenfold.operators import mixture, reports, selection
from lumenfold.sources import cameras, records

RNG = np.random.default_rng(8)


def rigid():
    q, _ = np.linalg.qr(RNG.normal(size=(3, 3)))
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = q * np.sign(np.linalg.det(q)), RNG.normal(size=3)
    return m


def quaternion_matrix(q):
    x, y, z, w = q / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def found(df):
    return {(r["seq"], r["frame"]): (np.array(r["pose"]).reshape(4, 4), r["image"] if "image" in r else None) for r in df.collect()}


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))


def test_matrix_and_line_files(spark, tmp_path):
    ms = [rigid() for _ in range(4)]
    for i, m in enumerate(ms):
        put(tmp_path / f"m/scene{i % 2}/pose/{i}.txt", "\n".join(" ".join(f"{v:.12f}" for v in r) for r in m))
    put(tmp_path / "m/scene0/pose/9.txt", "inf " * 16)
    put(tmp_path / "m/scene0/pose/10.txt", "1 2 3")
    got = found(cameras.matrix_files(spark, f"{tmp_path}/m/*/pose", r"/([^/]+)/pose/(\d+)\.txt$", "%s/color/%d.jpg"))
    assert set(got) == {(f"scene{i % 2}", i) for i in range(4)} and got["scene1", 3][1] == "scene1/color/3.jpg"
    assert all(np.allclose(got[f"scene{i % 2}", i][0], m) for i, m in enumerate(ms))
    lines = RNG.normal(size=(3, 7))
    put(tmp_path / "t/a/pose_left.txt", "# head\n" + "\n".join(" ".join(map(str, r)) for r in lines) + "\n1 2\n\n")
    for pose, want in (
        (cameras.cycled_pose, lambda r: (quaternion_matrix(r[[4, 5, 3, 6]]), r[[1, 2, 0]])),
        (cameras.engine_pose, lambda r: (lambda a: (a @ quaternion_matrix(r[3:7]) @ a.T, a @ r[:3] / 100))(np.array([[0, 1, 0], [0, 0, -1], [1, 0, 0]]))),
    ):
        got = found(cameras.pose_lines(spark, f"{tmp_path}/t/*", r"/([^/]+)/pose_left\.txt$", "%s/%06d_left.png", pose, 7))
        assert set(got) == {("a", i) for i in range(3)}
        for i, r in enumerate(lines):
            m, t = want(r)
            assert np.allclose(got["a", i][0][:3, :3], m) and np.allclose(got["a", i][0][:3, 3], t)
    wide = np.concatenate([np.arange(2)[:, None], np.stack([m.ravel() for m in ms[:2]])], axis=1)
    put(tmp_path / "w/b/cam_poses.txt", "\n".join(" ".join(map(str, r)) for r in wide) + "\n" + "1 " * 18)
    got = found(cameras.pose_lines(spark, f"{tmp_path}/w/*", r"/([^/]+)/cam_poses\.txt$", "%s/%05d.png", lambda n: F.slice(n, 2, 16), 17, least=False))
    assert set(got) == {("b", 0), ("b", 1)} and np.allclose(got["b", 1][0], ms[1])


def test_documents(spark, tmp_path):
    ms = [rigid() for _ in range(2)]
    flip = np.diag([1, -1, -1, 1])
    put(tmp_path / "d/s1/scaled_transforms.json", {"frames": [{"colmap_im_id": 7 + i, "transform_matrix": m.tolist()} for i, m in enumerate(ms)]})
    got = found(cameras.scaled_transforms(spark, f"{tmp_path}/d/*", r"/([^/]+)/scaled_transforms\.json$", "%s/frame_%05d.png"))
    for i, m in enumerate(ms):
        e = m.copy()
        e[2] *= -1
        e = e[[1, 0, 2, 3]]
        e[:3, 1:3] *= -1
        assert np.allclose(got["s1", 7 + i][0], e)
    put(tmp_path / "r/o/transforms.json", {"camera_angle_x": 1, "frames": [{"file_path": f"x/r_{i}", "transform_matrix": m.tolist(), "scale": 0.5} for i, m in enumerate(ms)]})
    got = found(cameras.rendered_transforms(spark, f"{tmp_path}/r/*", r"/([^/]+)/transforms\.json$", "%s/r_%d.png"))
    for i, m in enumerate(ms):
        e = m @ flip
        e[:3, 3] /= 500
        assert np.allclose(got["o", i][0], e)
    put(tmp_path / "c/k/opencv_cameras.json", {"frames": [{"w2c": m.tolist()} for m in ms]})
    got = found(cameras.world_to_camera_documents(spark, f"{tmp_path}/c/*", r"/([^/]+)/opencv_cameras\.json$", "%s/%08d.png"))
    assert all(np.allclose(got["k", i][0], np.linalg.inv(m)) for i, m in enumerate(ms))
    for i, m in enumerate(ms):
        put(tmp_path / f"e/q/poses/{i:04d}.json", {"extrinsic": m.tolist(), "f_x": 1})
    for axes in (None, cameras.GAME_AXES):
        got = found(cameras.extrinsic_documents(spark, f"{tmp_path}/e/*/poses", r"/([^/]+)/poses/(\d+)\.json$", "%s/%04d.png", axes))
        change = np.array(axes or np.eye(4).ravel()).reshape(4, 4)
        assert all(np.allclose(got["q", i][0], np.linalg.inv(m @ change.T)) for i, m in enumerate(ms)) and got["q", 1][1] == "q/0001.png"
    cam = "extrinsic\n" + "\n".join(" ".join(map(str, r)) for r in ms[0]) + "\n\nintrinsic\n500 0 320\n0 510 240\n0 0 1\n\n2.5 0.1"
    put(tmp_path / "b/z/cams/00000004_cam.txt", cam)
    put(tmp_path / "b/z/cams/00000005_cam.txt", cam + " 11 99")
    rows = sorted(cameras.depth_ranged_files(spark, f"{tmp_path}/b/*/cams", r"/([^/]+)/cams/(\d+)_cam\.txt$").collect(), key=lambda r: r["frame"])
    assert np.allclose(np.array(rows[0]["pose"]).reshape(4, 4), np.linalg.inv(ms[0])) and rows[0]["intrinsic"][4] == 510
    assert [(r["frame"], r["depth_min"], round(r["depth_max"], 6)) for r in rows] == [(4, 2.5, 21.6), (5, 2.5, 99.0)]
    put(tmp_path / "cameras.txt", "# c\n1 PINHOLE 640 480 500 510 320 240\n2 SIMPLE_RADIAL 10 20 5 6 7 0.1\n3 ODD 1 1 1 1 1 1\n")
    got = [tuple(r) for r in cameras.colmap_cameras(spark, str(tmp_path / "cameras.txt")).orderBy("camera_id").collect()]
    assert got == [(1, "PINHOLE", 640, 480, 500.0, 510.0, 320.0, 240.0), (2, "SIMPLE_RADIAL", 10, 20, 5.0, 5.0, 6.0, 7.0)]


def test_small_functions_that_queries_lack(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    for name in ("a.json", "b.jsonl"):
        assert sorted(r["x"] for r in records.read_json(spark, str(tmp_path / name), "x int").collect()) == [1, 2]
    assert set(records.ADAPTERS) == {"coco", "unified", "labelme", "yolo"} and all(callable(f) for f in records.ADAPTERS.values())
    put(tmp_path / "l.json", {"imagePath": "p.jpg", "imageWidth": 9, "imageHeight": 9, "shapes": [{"label": "q", "points": [[3, 1], [1, 4]]}]})
    assert records.ADAPTERS["labelme"](spark, str(tmp_path / "l.json")).first()["bbox"] == [1, 1, 3, 4]
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert selection.only_ones(one, "k").count() == 2
    with pytest.raises(Exception, match="several rows of 1"):
        selection.only_ones(one.unionAll(one), "k").collect()
    assert [tuple(r) for r in mixture.last_of_each(spark.createDataFrame([(1, 5), (1, 7), (2, None)], "g int, o int"), ["g"], "o").select("g", "o").orderBy("g").collect()] == [(1, 7), (2, None)]
    d = spark.createDataFrame([([1.0, 1.0, 5.0, 1.0, 5.0, 4.0, 1.0, 4.0], 6, 8)], "p array<double>, h int, w int").withColumn("r", masks.rasterized("p", "h", "w"))
    got = d.select(text.run_area(F.col("r")).alias("a"), masks.runs_box(F.col("r"), F.col("h")).alias("b"), text.fill(F.lit("find {categories}: PHRASE"), categories=F.lit("cat"), PHRASE=F.lit("it")).alias("f")).first()
    assert got["a"] == 12 and got["b"] == [1.0, 1.0, 4.0, 3.0] and got["f"] == "find cat: it"
    path = str(tmp_path / "log")
    reports.append_rows(one, path)
    reports.append_rows(one.withColumn("w", F.lit(3)), path)
    assert spark.read.option("header", True).csv(path).count() == 4 and spark.read.option("header", True).csv(path).columns == ["k", "v", "w"]


def test_looking_cameras_compute_each_axis_once(spark, tmp_path):
    from lumenfold.plans import frames

    spark.createDataFrame([(1, 1, 5, 6)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = frames.look_at_cameras(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT(") <= 12
