"""Vector codes against a plain version in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import codes

KIND = "vec_id long, embedding array<double>, label int, code string"


def plain(rows, parts, entries, rounds, scale):
    """rows: (id, vector, label) of valid vectors with distinct ids and one length."""
    q = {i: [math.floor(scale * x) for x in v] for i, v, _ in rows}
    width = len(next(iter(q.values()))) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(q[i], p) for i in sorted(q)[:entries]] for p in range(parts)]

    def nearest(v, book):
        far = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for v in q.values():
                held[nearest(cut(v, p), books[p])[0]].append(cut(v, p))
            books[p] = [[sum(c) // len(h) for c in zip(*h, strict=True)] if h else e for h, e in zip(held, books[p], strict=True)]
    out, sums = {}, {}
    for i, _, label in rows:
        got = [nearest(cut(q[i], p), books[p]) for p in range(parts)]
        out[i] = "".join(f"{k:02x}" for k, _ in got), sum(d for _, d in got)
        sums[label] = sums.get(label, 0) + out[i][1]
    text = ",".join(str(x) for p in books for e in p for x in e)
    return {i: (*out[i], sums[label]) for i, _, label in rows}, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("dim,parts,entries,n", [(8, 2, 3, 60), (6, 6, 16, 40), (4, 1, 5, 3)])
def test_codes_match_the_definition(spark, dim, parts, entries, n, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 16)
    rng = np.random.default_rng(dim)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, dim)], int(i) % 3 or None) for i in rng.permutation(n)]
    rows[1] = (rows[1][0], rows[0][1], rows[1][2])  # equal vectors
    want, digest = plain(rows, parts, entries, 4, 100)
    # dropped: null, null and non-finite components; a column with the name of a result is ignored
    odd = [(1000, None, 1), (1001, [None] + [0.0] * (dim - 1), 1), (1002, [float("nan")] * dim, 1), (1003, [float("inf")] * dim, None)]
    d = spark.createDataFrame([(*r, "x") for r in rows + odd], KIND).repartition(5)
    got, books = codes.compress(d, parts, entries, 4, 100)
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got.collect()} == want
    assert codes.digest(books) == digest
    some = want[rows[0][0]]
    near = codes.decode(some[0], books)
    assert sum((math.floor(100 * x) - int(y)) ** 2 for x, y in zip(rows[0][1], near, strict=True)) == some[1]


def test_odd_rows(spark):
    rows = [(5, [1.0, 2.0], None), (5, [0.0, 9.0], None), (None, [1.0, 2.0], 1), (7, [1.0, 2.0, 3.0], None), (8, [], 2), (9, [4.0, 4.0], 1)]
    got, books = codes.compress(spark.createDataFrame([(*r, None) for r in rows], KIND), 2, 16, 0, 1)
    assert books.tolist() == [[[0], [4]], [[9], [4]]]  # id 5 by its smaller vector; the null id none
    found = sorted(map(tuple, got.collect()), key=repr)
    # a null label is a label; other lengths have no code but the sum of their label
    assert found == sorted([(5, "0001", 5, 5), (5, "0000", 0, 5), (None, "0001", 5, 5), (7, None, None, 5), (8, None, None, None), (9, "0101", 0, 5)], key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(None, [1.0, 2.0], 1)], [(1, [1.0, 2.0, 3.0], None)]])
def test_nothing_to_learn_from(spark, rows):
    got, books = codes.compress(spark.createDataFrame([(*r, None) for r in rows], KIND), 2)
    assert books.size == 0
    assert [tuple(r) for r in got.collect()] == [(r[0], None, None, None) for r in rows if r[1]]


def test_beyond_the_exact_range(spark):
    with pytest.raises(Exception, match="beyond the exact range"):
        codes.compress(spark.createDataFrame([(1, [1e30, 0.0], 1, None)], KIND), 2)


def test_many_labels_take_the_other_join(spark, monkeypatch):
    d = spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 7 / 7.0, F.lit(0.5)).cast("array<double>").alias("embedding"), F.when(F.col("id") % 5 > 0, F.col("id") % 50).alias("label"))
    one = sorted(map(tuple, codes.compress(d, 2, 4)[0].collect()))
    monkeypatch.setattr(codes, "FEW", 3)
    assert sorted(map(tuple, codes.compress(d, 2, 4)[0].collect())) == one
