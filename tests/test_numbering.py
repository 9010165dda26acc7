"""Running numbers, and what numbered records cost."""

import random

from pyspark.sql import functions as F

from lumenfold.functions import text
from lumenfold.operators import numbering
from lumenfold.sources import records


def test_numbered_rows_are_computed_once(spark):
    """Sampling for the ranges computed them once more."""
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v

    rows = spark.range(200).select((F.col("id") * 37 % 200).alias("k"), F.udf(counted, "long")("id").alias("v"))
    got = numbering.dense_ids(rows, "k", 5).collect()
    assert sorted((r["k"], r["id"]) for r in got) == [(i, i + 5) for i in range(200)] and all(r["v"] * 37 % 200 == r["k"] for r in got)
    assert seen.value == 200


def test_three_places_of_any_size(spark):
    rng = random.Random(3)
    values = [0.0, -0.0004, -0.0005, -1.0005, 12345.6785, 1e9 + 0.0625, 99.9995, *(rng.uniform(-50, 50) for _ in range(200)), *(rng.randrange(-9999, 9999) / 2000 for _ in range(200)), None]
    got = [r["t"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(text.three_places(F.col("v")).alias("t")).collect()]
    assert got == [None if v is None else "%.3f" % v for v in values]


def test_instructions_group_once(spark):
    flat = spark.createDataFrame([(f"i{i}", 100, 50, p, "ab"[(p + i) % 2], [10.0 * p, 5.0, 90.0, 60.0]) for i in (2, 0, 1) for p in range(3)], "image string, width int, height int, pos int, phrase string, bbox array<double>")
    got = {r["id"]: (r["image"][0], r["conversations"][0]["value"], r["conversations"][1]["value"]) for r in records.instructions(flat, F.lit("Find {categories}")).collect()}
    box = lambda p: f"<bbox>[{p / 10:.3f}, 0.100, 0.900, 0.999]</bbox>"
    want = lambda a, b: (f"Find {a}, {b}", f"<p>{a}</p>{box(0)}{box(2)}<p>{b}</p>{box(1)}")
    assert got == {0: ("i0", *want("a", "b")), 1: ("i1", *want("b", "a")), 2: ("i2", *want("a", "b"))}
