"""Run-length masks and polygons that no built-in expresses: Arrow functions over whole batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def encode_runs(runs: list[int]) -> str:
    """Text of run lengths: each is a difference to the one before the last (from the third on) in
    groups of five bits, low first, with a bit for more, offset 48."""
    out = []
    for i, r in enumerate(runs):
        x = int(r) - (int(runs[i - 2]) if i > 2 else 0)
        while True:
            c = x & 31
            x >>= 5
            more = x != -1 if c & 16 else x != 0
            out.append(chr((c | 32 if more else c) + 48))
            if not more:
                break
    return "".join(out)


def decode_runs(text: str) -> list[int]:
    """The inverse of encode_runs()."""
    out: list[int] = []
    x = shift = 0
    for ch in text:
        c = ord(ch) - 48
        x |= (c & 31) << shift
        shift += 5
        if not c & 32:
            if c & 16:
                x |= -1 << shift
            out.append(x + (out[-2] if len(out) > 2 else 0))
            x = shift = 0
    return out


def _runs_text(runs: pd.Series) -> pd.Series:
    return runs.map(lambda r: None if r is None else encode_runs(list(r)))


def _text_runs(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else decode_runs(t))


def polygon_runs(points: np.ndarray, h: int, w: int) -> list[int]:
    """Runs, column by column, of the pixels whose centres lie in the polygon."""
    y, x = np.meshgrid(np.arange(h) + 0.5, np.arange(w) + 0.5, indexing="ij")
    inside = np.zeros((h, w), bool)
    p, q = points, np.roll(points, -1, axis=0)
    for (x0, y0), (x1, y1) in zip(p, q, strict=True):
        if y0 != y1:
            inside ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    flat = inside.T.ravel()
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flat, [False]]).astype(np.int8)))
    return np.diff(np.concatenate([[0], edges, [h * w]])).tolist() if len(edges) else [h * w]


def _rasterized(polygon: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """Runs of a flat polygon [x0, y0, ...] in an image of h by w."""
    return pd.Series([None if p is None else polygon_runs(np.asarray(p, float).reshape(-1, 2), int(a), int(b)) for p, a, b in zip(polygon, h, w, strict=True)])


def _area(p: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2


def _convex(p: list[tuple[float, float]]) -> bool:
    n = len(p)
    turns = [(p[(i + 1) % n][0] - p[i][0]) * (p[(i + 2) % n][1] - p[(i + 1) % n][1]) - (p[(i + 1) % n][1] - p[i][1]) * (p[(i + 2) % n][0] - p[(i + 1) % n][0]) for i in range(n)]
    return all(t >= 0 for t in turns) or all(t <= 0 for t in turns)


def _clipped(subject: list[tuple[float, float]], a: tuple[float, float], b: tuple[float, float]) -> list[tuple[float, float]]:
    """The part of a polygon to the left of the line from a to b."""
    side = lambda q: (b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0])
    out = []
    for p, q in zip(subject, subject[1:] + subject[:1], strict=True):
        s, t = side(p), side(q)
        if s >= 0:
            out.append(p)
        if (s > 0) != (t > 0) and s != t and s * t < 0:
            r = s / (s - t)
            out.append((p[0] + (q[0] - p[0]) * r, p[1] + (q[1] - p[1]) * r))
    return out


def convex_overlap(p: list[tuple[float, float]], q: list[tuple[float, float]]) -> float:
    """Shared area of two convex polygons."""
    q = q if _area(q) > 0 else q[::-1]
    for a, b in zip(q, q[1:] + q[:1], strict=True):
        if not p:
            return 0.0
        p = _clipped(p, a, b)
    return abs(_area(p)) if len(p) > 2 else 0.0


def _triangles(p: list[tuple[float, float]]) -> list[tuple[float, list[tuple[float, float]]]]:
    """Signed triangles of a fan; their signed indicator functions add up to the polygon's."""
    out = []
    for i in range(1, len(p) - 1):
        t = [p[0], p[i], p[i + 1]]
        a = _area(t)
        if a:
            out.append((1.0 if a > 0 else -1.0, t))
    return out


def polygon_iou_of(a: list[float] | None, b: list[float] | None) -> float:
    """Overlap of two simple polygons, convex or not; 0 with fewer than three points or no area."""
    if a is None or b is None or len(a) < 6 or len(b) < 6:
        return 0.0
    p, q = (list(zip(v[::2], v[1::2], strict=False)) for v in (list(map(float, a)), list(map(float, b))))
    pa, qa = _area(p), _area(q)
    if not pa or not qa:
        return 0.0
    if _convex(p) and _convex(q):
        shared = convex_overlap(p, q)
    else:
        sign = (1 if pa > 0 else -1) * (1 if qa > 0 else -1)
        shared = sign * sum(s * t * convex_overlap(x, y) for s, x in _triangles(p) for t, y in _triangles(q))
    union = abs(pa) + abs(qa) - shared
    return shared / union if shared > 0 and union > 0 else 0.0


def _polygon_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([polygon_iou_of(None if x is None else list(x), None if y is None else list(y)) for x, y in zip(a, b, strict=True)])


def runs_box(runs: Column, h: Column) -> Column:
    """[x, y, w, h] around the foreground of column-major runs."""
    from .text import run_spans

    spans = run_spans(runs)
    xs0, xs1 = F.transform(spans, lambda s: F.floor(s["start"] / h)), F.transform(spans, lambda s: F.floor((s["end"] - 1) / h))
    whole = lambda s: F.floor(s["start"] / h) < F.floor((s["end"] - 1) / h)
    ys0 = F.transform(spans, lambda s: F.when(whole(s), 0).otherwise(s["start"] % h))
    ys1 = F.transform(spans, lambda s: F.when(whole(s), h - 1).otherwise((s["end"] - 1) % h))
    x, y = F.array_min(xs0), F.array_min(ys0)
    return F.when(F.size(spans) > 0, F.array(x, y, F.array_max(xs1) - x + 1, F.array_max(ys1) - y + 1).cast("array<double>")).otherwise(F.array(*[F.lit(0.0)] * 4))


def _udf(f, kind: str, *columns: Column | str) -> Column:
    """An Arrow function, made at its use: workers import this module without a session."""
    ship(SparkSession.active())
    return F.pandas_udf(f, kind)(*columns)


def runs_text(runs: Column | str) -> Column:
    """Text of run lengths."""
    return _udf(_runs_text, "string", runs)


def text_runs(text: Column | str) -> Column:
    """Run lengths of a text."""
    return _udf(_text_runs, "array<int>", text)


def rasterized(polygon: Column | str, h: Column | str, w: Column | str) -> Column:
    return _udf(_rasterized, "array<int>", polygon, h, w)


def polygon_iou(a: Column | str, b: Column | str) -> Column:
    return _udf(_polygon_iou, "double", a, b)
