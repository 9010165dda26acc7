"""Neighbourhoods of pixels: images cut into tiles with a rim of their neighbours' pixels.

A pixel goes to its tile and, where it lies near an edge, to the tiles beside it. A tile is then
dense arrays, neighbours are shifts of these, and only the tile's own pixels come out. So a
window of any size costs one shuffle of little more than the pixels, and no join of the table
with itself; a large image is as many tasks as it has tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

TILE = 256
#: Fixed values of the structural similarity: weights' deviation, the two constants' factors.
SIGMA, K1, K2 = 1.5, 0.01, 0.03

Arrays = dict[str, np.ndarray]


def tiled(pixels: DataFrame, by: Sequence[str], values: Sequence[str], radius: int, fn: Callable[[Arrays], Arrays], out: Sequence[str], tile: int = TILE) -> DataFrame:
    """(by..., x, y, out...): fn makes arrays `out` of arrays of the values, y by x, that reach `radius`
    pixels beyond the tile; NaN where there is no pixel or its value is null. A pixel comes out if it
    is in the table and any of its results isn't NaN. Places are not negative, and distinct."""
    ship(pixels.sparkSession)
    near = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - radius) / tile), F.floor(F.col(c) / tile), F.floor((F.col(c) + radius) / tile)))
    if radius > tile:
        raise ValueError("a window must not reach beyond the neighbouring tiles")
    rows = pixels.select(*by, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *[F.col(v).cast("double").alias(v) for v in values])
    rows = rows.withColumn("__tx", F.explode(near("x"))).withColumn("__ty", F.explode(near("y"))).where("__tx >= 0 and __ty >= 0")
    size = tile + 2 * radius
    names = list(values)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(pdf["__tx"].iloc[0]), int(pdf["__ty"].iloc[0])
        col, row = pdf["x"].to_numpy() - tx * tile + radius, pdf["y"].to_numpy() - ty * tile + radius
        arrays = {}
        for v in names:
            a = np.full((size, size), np.nan)
            a[row, col] = pdf[v].to_numpy()
            arrays[v] = a
        own = (col >= radius) & (col < tile + radius) & (row >= radius) & (row < tile + radius)
        with np.errstate(all="ignore"):
            got = fn(arrays)
        res = pdf.loc[own, [*by, "x", "y"]].copy()
        for name in out:
            res[name] = got[name][row[own], col[own]]
        return res[~res[list(out)].isna().all(axis=1)]

    kinds = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in by) + ", x long, y long, " + ", ".join(f"{o} double" for o in out)
    return rows.groupBy(*by, "__tx", "__ty").applyInPandas(run, kinds)


def shifted(a: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """What stands dx to the right and dy below; NaN beyond the array."""
    out = np.full_like(a, np.nan)
    h, w = a.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def _around(a: np.ndarray, radius: int) -> np.ndarray:
    return np.stack([shifted(a, dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)])


def normals(points: DataFrame, by: Sequence[str], steepest: float | None = None, tile: int = TILE) -> DataFrame:
    """(by..., x, y, nx, ny, nz): unit normals of a point map by the four corners of neighbours that are
    valid; without any, or where they cancel, no row or zeros. points: px, py, pz, null if invalid.
    steepest: degrees between normal and line of sight from which a corner doesn't count."""

    def fn(a: Arrays) -> Arrays:
        p = np.stack([a["px"], a["py"], a["pz"]])
        up, left, down, right = (np.stack([shifted(c, dx, dy) for c in p]) - p for dx, dy in ((0, -1), (-1, 0), (0, 1), (1, 0)))
        total, some = np.zeros_like(p), np.zeros(p.shape[1:], bool)
        for u, v in ((up, left), (left, down), (down, right), (right, up)):
            n = np.cross(u, v, axis=0)
            n = n / (np.sqrt((n * n).sum(0)) + 1e-12)
            ok = ~np.isnan(n).any(0)
            if steepest is not None:
                c = np.abs((n * p).sum(0)) / (np.sqrt((p * p).sum(0)) * np.sqrt((n * n).sum(0)))
                ok &= np.degrees(np.arccos(np.clip(c, -1, 1))) < steepest
            total += np.where(ok, n, 0)
            some |= ok
        total = total / (np.sqrt((total * total).sum(0)) + 1e-12)
        return {k: np.where(some, total[i], np.nan) for i, k in enumerate(("nx", "ny", "nz"))}

    return tiled(points, by, ("px", "py", "pz"), 1, fn, ("nx", "ny", "nz"), tile)


def depth_edges(depth: DataFrame, by: Sequence[str], absolute: float | None = None, relative: float | None = None, radius: int = 1, tile: int = TILE) -> DataFrame:
    """(by..., x, y, edge, aliased) of pixels with a depth. edge: within the window the depths differ by
    more than allowed; aliased: the pixel lies that far from both its largest and smallest neighbour.
    relative: over the pixel's own depth."""

    def fn(a: Arrays) -> Arrays:
        d = a["depth"]
        window = _around(d, radius)
        hi, lo = np.fmax.reduce(window), np.fmin.reduce(window)

        def beyond(gap: np.ndarray) -> np.ndarray:
            out = np.zeros(d.shape, bool)
            if absolute is not None:
                out |= gap > absolute
            if relative is not None:
                out |= gap / d > relative
            return np.where(np.isnan(d), np.nan, out)

        return {"edge": beyond(hi - lo), "aliased": beyond(np.minimum(hi - d, d - lo))}

    out = tiled(depth, by, ("depth",), radius, fn, ("edge", "aliased"), tile)
    return out.withColumns({c: F.col(c) > 0 for c in ("edge", "aliased")})


def structural_similarity(pairs: DataFrame, by: Sequence[str], reach: float = 1.0, radius: int = 5, tile: int = TILE) -> DataFrame:
    """(by..., ssim, windows): mean over the windows of 2 * radius + 1 that lie wholly within the image,
    Gaussian weights. pairs: by..., x, y, a, b; reach: the range of values. Images smaller than a
    window have no row."""
    w = np.exp(-((np.arange(-radius, radius + 1) / SIGMA) ** 2) / 2)
    w = w / w.sum()
    c1, c2 = (K1 * reach) ** 2, (K2 * reach) ** 2

    def blur(a: np.ndarray) -> np.ndarray:
        rows = sum(k * shifted(a, dx, 0) for k, dx in zip(w, range(-radius, radius + 1), strict=True))
        return sum(k * shifted(rows, 0, dy) for k, dy in zip(w, range(-radius, radius + 1), strict=True))

    def fn(v: Arrays) -> Arrays:
        a, b = v["a"], v["b"]
        ma, mb = blur(a), blur(b)
        va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
        return {"ssim": (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))}

    each = tiled(pairs, by, ("a", "b"), radius, fn, ("ssim",), tile)
    return each.groupBy(*by).agg(F.avg("ssim").alias("ssim"), F.count("*").alias("windows"))
