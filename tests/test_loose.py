"""Loose parsers against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import loose

W, H = 640, 480


def floats(s):
    try:
        return [float(x) for x in s.split(",")]
    except ValueError:
        return None


def point(v):
    if v is None or len(v) != 2:
        return None
    if max(map(abs, v)) <= 1.5:
        v = [v[0] * W, v[1] * H]
    return [max(0.0, min(W - 1.0, v[0])), max(0.0, min(H - 1.0, v[1]))]


def plain_keypoints(segment):
    """Name by name and place by place."""
    names = sorted({*loose.PERSON, *loose.ANIMAL}, key=len, reverse=True)
    bare, out = re.sub(r"(?i)<bbox>\s*\[[^\]]+\]\s*</bbox>", " ", segment), {}
    for m in re.finditer(r"(?is)([^<>]*?)<kpt>\s*\[([^\]]+)\]\s*</kpt>", bare):
        word = " ".join(re.sub(r"(?s)<.*?>", " ", m.group(1)).replace(":", " ").replace("=", " ").split()).strip(" ,;.-").lower()
        hit = next((n for n in names if word.endswith(n)), None)
        if hit and len(floats(m.group(2)) or []) == 2:
            out[hit] = point(floats(m.group(2)))
    for n in names:
        m = re.search(rf"\b{n}\b\s*[:=]?\s*\[([^\]]+)\]", bare.lower())
        if n not in out and m and len(floats(m.group(1)) or []) == 2:
            out[n] = point(floats(m.group(1)))
    return out


def test_segments_match_a_plain_parser(spark):
    rng = random.Random(3)
    names = [*loose.PERSON[:6], *loose.ANIMAL[3:8], "tail", "the left", "Left  Wrist", "its nose"]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(6)):
            n = rng.choice(names)
            xy = rng.choice([f"{rng.random():.2f}, {rng.random():.2f}", f"{rng.randrange(900)},{rng.randrange(900)}", "1,2,3", "a,b", "-0.5,0.25"])
            parts.append(rng.choice([f"its {n.upper()}<kpt>[{xy}]</kpt>", f"{n}: [{xy}]", f", {n} = [{xy}];", f"<bbox>[{xy},{xy}]</bbox>", f"<b>{n}:</b> <KPT> [{xy}] </kpt>"]))
        texts.append(" ".join(parts))
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    pts = F.transform(loose.segment_keypoints(F.col("t")), lambda e: F.struct(e["name"].alias("name"), loose.pixel_point(e["xy"], F.lit(W), F.lit(H)).alias("xy")))
    got = d.select("t", pts.alias("k")).collect()
    for r in got:
        assert {e["name"]: e["xy"] for e in r["k"]} == plain_keypoints(r["t"]) and len(r["k"]) == len({e["name"] for e in r["k"]}), r["t"]
    assert sum(len(r["k"]) for r in got) > 80


def test_instances_boxes_and_kinds(spark):
    rows = [
        ("<p>a  dog</p><ins><bbox>[0.1,0.1,0.5,0.5]</bbox> nose<kpt>[0.2,0.2]</kpt></ins> and <ins>root of tail: [10, 20]</ins><ins>nothing</ins><p>x</p>none", None),
        ("<p>man</p> left wrist<kpt>[1,1]</kpt>", None), ("<p>man</p> nose<kpt>[1,1]</kpt>", "Some Context"), ("<p>man</p> left wrist<kpt>[1,1]</kpt>", "AP-10K"),
        ("<p>bad box</p><bbox>[1,2,3]</bbox>", "x"), ("no tags", None), (None, None), ("", None),
    ]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, c string")
    got = {r["i"]: r["p"] for r in d.select("i", loose.parse_loose_keypoints(F.col("t"), F.lit(W), F.lit(H), F.col("c")).alias("p")).collect()}
    assert [(p["label"], p["bbox"], [k["name"] for k in p["keypoints"]], p["kind"]) for p in got[0]] == [("a dog", [64.0, 48.0, 320.0, 240.0], ["nose"], ""), ("a dog", None, ["root of tail"], "animal")]
    assert [got[i][0]["kind"] for i in (1, 2, 3)] == ["human", "some context", "animal"] and all(not got[i] for i in (4, 5, 6, 7))


def test_prompts(spark):
    q = "see <BBOX> [0.5, 0.5, 1.0, 1.0] </bbox>, <point>[10,20]</point> <bbox>[1,2]</bbox> <point>[1,2]</bbox> <p>cat</p> <scribble> <p>a\nb</p><mask>"
    d = spark.createDataFrame([(q,), (None,)], "q string")
    got = d.select(loose.visual_prompts(F.col("q"), F.lit(100), F.lit(50)).alias("p"), loose.prompt_categories(F.col("q")).alias("c")).collect()
    assert [tuple(p) for p in got[0]["p"]] == [("bbox", [50.0, 25.0, 100.0, 50.0]), ("point", [10.0, 20.0])] and got[0]["c"] == ["cat", "point", "scribble", "mask"]
    assert not got[1]["p"]
    with pytest.raises(ValueError):
        loose.parse_as("mask", F.col("q"))
    same = spark.createDataFrame([("<p>a</p><bbox>[0.1,0.1,0.2,0.2]</bbox>",)], "t string").select(loose.parse_as("bbox", F.col("t")).alias("p")).first()["p"]
    assert same[0]["label"] == "a"


def test_a_name_is_cleaned_once_for_the_whole_vocabulary(spark):
    d = spark.createDataFrame([("The  left WRIST:",), ("none",), (None,)], "t string").select(loose.known_name(loose._clean(F.col("t"))).alias("n"))
    assert [r["n"] for r in d.collect()] == ["left wrist", None, None]
    plan = d._jdf.queryExecution().analyzed().toString().split("\n")[0]
    assert "lower(" in plan and "lower(" not in plan[plan.index("filter(") :]
