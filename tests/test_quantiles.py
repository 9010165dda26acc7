"""Order statistics against sorting, over many rounds of bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import quantiles, runs

KIND = "g string, v double"


@pytest.mark.parametrize("bins,few,known", [(4, 2, 100_000), (1024, 1000, 100_000), (8, 3, 0)])
def test_ranks_match_sorting(spark, monkeypatch, bins, few, known):
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "KNOWN", known)
    rng = np.random.default_rng(bins)
    groups = {
        "hot": rng.normal(size=900).tolist(), "ties": rng.integers(0, 3, 60).astype(float).tolist(), "one": [5.0], "wide": [-1.5e308, 1.5e308, 0.0, 1e-300, -1e-300, float("inf"), 1e10] * 2,
        None: (10.0 ** rng.integers(-30, 30, 80)).tolist(), "same": [2.0] * 40,
    }
    groups["wide"] = [x for x in groups["wide"] if np.isfinite(x)]
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("hot", None), ("hot", float("nan")), ("empty", None)]
    d = spark.createDataFrame(rows, KIND).repartition(5)
    every = F.array(F.lit(0), F.floor(F.col("n") / 3), F.floor(F.col("n") / 2), F.col("n") - 1, F.col("n"), F.lit(-1))
    got = {(r["g"], r["rank"]): r["v"] for r in quantiles.order_statistics(d, ["g"], "v", every).collect()}
    want = {(g, k): sorted(xs)[k] for g, xs in groups.items() for k in {0, len(xs) // 3, len(xs) // 2, len(xs) - 1}}
    assert got == want


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(9)
    groups = {k: rng.exponential(size=n).tolist() for k, n in (("a", 1500), ("b", 7), ("c", 1))}
    d = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], KIND)
    for r in quantiles.quantiles(d, ["g"], "v", (0.0, 0.25, 0.98, 1.0)).collect():
        assert r["q"] == pytest.approx(np.quantile(groups[r["g"]], [0.0, 0.25, 0.98, 1.0]).tolist(), rel=1e-12) and r["n"] == len(groups[r["g"]])
    assert quantiles.quantiles(d.limit(0), ["g"], "v", (0.5,)).count() == 0


def test_run_lengths_survive_the_round(spark):
    m = spark.createDataFrame([("a", [0, 3, 2, 4, 91]), ("b", [5, 95]), ("c", [100])], "id string, runs array<long>")
    rows = runs.spans(m, ["id"])
    back = {r["id"]: r["runs"] for r in runs.lengths(rows, ["id"], F.lit(100)).collect()}
    assert back == {"a": [0, 3, 2, 4, 91], "b": [5, 95]}
    assert {(r["id"], r["area"]) for r in runs.areas(rows, ["id"]).collect()} == {("a", 7), ("b", 95)}


def test_masks_against_pixels(spark):
    rng = np.random.default_rng(4)
    h, w = 7, 9
    masks = [(i, rng.random((w, h)) < p) for i, p in enumerate((0.1, 0.5, 0.8, 0.95, 1.0))]

    def spans(flat):
        e = np.flatnonzero(np.diff(np.concatenate([[0], flat.astype(int), [0]])))
        return list(zip(e[::2].tolist(), e[1::2].tolist(), strict=True))

    d = spark.createDataFrame([(i, a, b, h, w) for i, m in masks for a, b in spans(m.ravel())], "id long, start long, end long, height long, width long")
    got = lambda t: {i: sorted((r["start"], r["end"]) for r in rows) for i in range(5) for rows in [[r for r in t if r["id"] == i]]}
    for radius in (1, 2):
        pad = lambda m: np.pad(m, radius)
        around = lambda m: np.stack([pad(m)[a : a + w, b : b + h] for a in range(2 * radius + 1) for b in range(2 * radius + 1)])
        assert got(runs.grown(d, ["id"], radius).collect()) == {i: spans(around(m).any(0).ravel()) for i, m in masks}
        assert got(runs.shrunk(d, ["id"], radius).collect()) == {i: spans(around(m).all(0).ravel()) for i, m in masks}
        assert got(runs.boundary(d, ["id"], radius).collect()) == {i: spans((m & ~around(m).all(0)).ravel()) for i, m in masks}
