"""Arrays in huge JSON files: many splits, odd and damaged files."""

import json
import random

import pytest

from lumenfold.sources import arrays


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 97)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def read(spark, path, key=None):
    rows = arrays.read_array(spark, str(path), key).orderBy("src", "pos").collect()
    by = {}
    for r in rows:
        by.setdefault(r["src"].rsplit("/", 1)[1], []).append((r["pos"], r["value"], r["bad"]))
    return by


def odd(rng, depth=0):
    kinds = [lambda: rng.randrange(99), lambda: "".join(rng.choice('ab"\\{}[],:é\n ') for _ in range(rng.randrange(12))), lambda: None, lambda: True]
    if depth < 3:
        kinds += [lambda: [odd(rng, depth + 1) for _ in range(rng.randrange(4))], lambda: {f"annotations{k}" if k else "annotations": odd(rng, depth + 1) for k in range(rng.randrange(4))}] * 2
    return rng.choice(kinds)()


@pytest.mark.parametrize("seed", range(4))
def test_every_element_of_many_splits(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    docs = {}
    for name in ("a.json", "b.json"):
        wanted = [odd(rng) for _ in range(rng.randrange(60))]
        before = {f"k{k}": odd(rng) for k in range(rng.randrange(4))} | {"info": {"annotations": [1, {"annotations": [2]}]}, "text": 'x"annotations":[3]'}
        doc = before | {"annotations": wanted} | {"later": [odd(rng)], "z": {"annotations": [9]}}
        (tmp_path / name).write_text(json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n"]), encoding="utf-8")
        docs[name] = wanted
    got = read(spark, tmp_path, "annotations")
    for name, wanted in docs.items():
        rows = got.get(name, [])
        assert [json.loads(v) for _, v, _ in rows] == wanted and [p for p, _, _ in rows] == list(range(len(wanted))) and not any(b for _, _, b in rows)
    (tmp_path / "top").mkdir()
    top = [odd(rng) for _ in range(80)]
    (tmp_path / "top" / "t.json").write_text(json.dumps(top))
    assert [json.loads(v) for _, v, _ in read(spark, tmp_path / "top")["t.json"]] == top
    assert arrays.read_array(spark, str(tmp_path / "top")).select("src").where("pos = 5").count() == 1


def test_one_file_is_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "big.json").write_text(json.dumps({"annotations": [{"id": i, "box": [i, 2, 3]} for i in range(400)]}))
    text = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert text.rdd.getNumPartitions() > 20
    assert [json.loads(v)["id"] for _, v, _ in read(spark, tmp_path, "annotations")["big.json"]] == list(range(400))


@pytest.mark.parametrize("split", [True, False])
def test_damage_is_told(spark, tmp_path, split, request):
    if split:
        request.getfixturevalue("small_splits")
    files = {
        "bad.json": '{"a":[{"x":1},{"x":2},{oops},{"x":4},{"x":5}]}', "cut.json": '{"a":[{"x":1},{"x":2},{"x":3', "cut2.json": '{"a":[{"x":1},{"x":"2',
        "cut3.json": '{"a":[{"x":1},{"y":{"x":3}', "none.json": '{"b":[1,2]}', "object.json": '{"a":{"b":[1,2]}}', "nul.json": '{"a":null}', "empty.json": '{"a":[ ], "b":[1]}',
        "gap.json": '{"a":[1,,2]}', "nulls.json": '{"a":[null, 7]}', "twice.json": '{"a":[1],"a":[2]}',
    }
    for name, t in files.items():
        (tmp_path / name).write_text(t)
    got = read(spark, tmp_path, "a")
    flat = {n: [(v, b) for _, v, b in rows] for n, rows in got.items()}
    x = lambda k: (f'{{"x":{k}}}', False)
    assert flat["bad.json"] == [x(1), x(2), ("{oops}", True), x(4), x(5)]
    assert flat["cut.json"] == [x(1), x(2), ('{"x":3', True)] and flat["cut2.json"] == [x(1), ('{"x":"2', True)] and flat["cut3.json"] == [x(1), ('{"y":{"x":3}', True)]
    assert flat["nulls.json"] == [("null", False), ("7", False)] and flat["twice.json"] == [("1", False), ("2", False)]
    assert set(flat) == {"bad.json", "cut.json", "cut2.json", "cut3.json", "gap.json", "nulls.json", "twice.json"} and [v for v, _ in flat["gap.json"]] == ["1", "2"]


def test_no_files_of_content(spark, tmp_path):
    (tmp_path / "e.json").write_text("")
    assert arrays.read_array(spark, str(tmp_path), "a").count() == 0
