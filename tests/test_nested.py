"""Nested values against plain recursion."""

import json
import random

from lumenfold.operators import nested

W, H = 100, 50


def rows_of(spark, values, extra=False):
    kind = "id int, value string" + ", width int, height int" * extra
    return spark.createDataFrame([(i, None if v is None else v if isinstance(v, str) else json.dumps(v), *([W, H] if extra else [])) for i, v in enumerate(values)], kind)


def odd(rng, depth=0):
    kinds = [lambda: rng.randrange(9), lambda: rng.choice(["a", "b c", ""]), lambda: None, lambda: [1, 2.5]]
    if depth < 6:
        kinds += [lambda: [odd(rng, depth + 1) for _ in range(rng.randrange(3))], lambda: {rng.choice("kxyz"): odd(rng, depth + 1) for _ in range(rng.randrange(3))}] * 3
    return rng.choice(kinds)()


def members(v, path=()):
    items = v.items() if isinstance(v, dict) else [(str(i), x) for i, x in enumerate(v)] if isinstance(v, list) else []
    for k, x in items:
        yield (*path, k), k if isinstance(v, dict) else None, x
        yield from members(x, (*path, k))


def test_every_member_at_any_depth(spark):
    rng = random.Random(5)
    values = [odd(rng) for _ in range(40)]
    got = {(r["id"], tuple(r["path"])): (r["key"], json.loads(r["value"])) for r in nested.walk(rows_of(spark, [json.dumps(v) for v in values])).collect()}
    want = {(i, p): (k, x) for i, v in enumerate(values) for p, k, x in members(v)}
    assert got == want and max(len(p) for _, p in want) >= 4
    found = nested.find_key(rows_of(spark, [json.dumps(v) for v in values]), "k").collect()
    assert sorted((r["id"], tuple(r["path"])) for r in found) == sorted(k for k, v in want.items() if v[0] == "k")


def test_categories(spark):
    values = [[{"id": 5, "name": "a", "isthing": 0}, {"name": "b"}, {"id": 7}, "plain"], {"3": {"name": "x"}, "4": "y", "5": {"id": 9, "name": "z"}}, None, [], 7]
    got = sorted(tuple(r) for r in nested.categories(rows_of(spark, values)).collect())
    assert [r[0:1] + r[2:4] for r in got] == [(0, 5, "a"), (0, 1, "b"), (0, 7, "7"), (0, 3, "plain"), (1, 3, "x"), (1, 4, "y"), (1, 9, "z")]
    assert [r[4] for r in got] == [0, None, None, 1, None, 1, None]


def test_primitives(spark):
    values = [
        {"cat": [[0.1, 0.2, 0.5, 0.6], [10, 20]], "deep": {"er": [[[0, 0, 10, 0, 10, 10]]]}}, "<p>dog</p><bbox>[0.1,0.1,0.2,0.2]</bbox><point>[5,5]</point><p>x</p><bbox>[1,2]</bbox>",
        [{"bbox": [10, 10, 20, 20], "keypoints": {"left_eye": [0.5, 0.5], "bad": None}, "phrase": "p"}, {"keypoints": {}}, {"type": "BBox", "coords": [1, 1, 9, 9]}], {"m": {"size": [2, 2], "counts": "04"}},
        None, "no tags", [[5, 5, 5, 5]], {"bbox": None, "n": [1, 2]}, [1, None], {"cat": {"cat": {"cat": [[3, 1], [200, 200]]}}},
    ]
    got = {}
    for r in nested.primitives(rows_of(spark, values, True)).collect():
        got.setdefault(r["id"], []).append((".".join(r["path"]), r["kind"], r["label"], r["color"], r["coords"], r["keypoints"], r["rle"]))
    got = {k: sorted(v) for k, v in got.items()}
    assert got[0] == [("cat.0", "bbox", "cat", 0, [10.0, 10.0, 50.0, 30.0], None, None), ("cat.1", "point", "cat", 1, [10.0, 20.0], None, None), ("deep.er.0.0", "polygon", "er", 0, [0.0, 0.0, 10.0, 0.0, 10.0, 10.0], None, None)]
    assert [(k, l, c) for _, k, l, c, *_ in got[1]] == [("bbox", "dog", 0), ("point", "dog", 1), ("point", "x", 0)]
    assert [(k, l, b, kp) for _, k, l, _, b, kp, _ in got[2]] == [("keypoint", "p", [10.0, 10.0, 20.0, 20.0], {"left eye": [50.0, 25.0]}), ("bbox", "object", [1.0, 1.0, 9.0, 9.0], None)]
    assert got[3][0][1:3] == ("mask", "m") and json.loads(got[3][0][6]) == {"size": [2, 2], "counts": "04"}
    assert [g[4] for g in got[9]] == [[3.0, 1.0], [99.0, 49.0]] and set(got) == {0, 1, 2, 3, 9}


def test_a_round_opens_each_value_once(spark, monkeypatch):
    """The kind of a value is written with it, not found out for each step of the round."""
    plans, write = [], nested.staged
    monkeypatch.setattr(nested, "staged", lambda df, label: plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, label))
    got = nested.primitives(rows_of(spark, [{"things": [[1, 2, 9, 9], [5, 6]], "name": "a"}], True)).collect()
    assert sorted((".".join(r["path"]), r["kind"]) for r in got) == [("things.0", "bbox"), ("things.1", "point")]
    leaves = [p for label, p in plans if label == "leaves"]
    assert leaves and not any("schema_of_variant" in p.lower() or "schemaofvariant" in p.lower() for p in leaves)
    assert any("schemaofvariant" in p.lower() or "schema_of_variant" in p.lower() for label, p in plans if label == "frontier")
