"""Point clouds: nearest neighbours by a tree, accuracy and completion, voxels, alignment, ICP.

Points come as rows (seq, x, y, z). The others of a large seq are cut into leaves of about CELL
points by a tree whose cuts come from a bounded sample. A point is first compared with its own leaf,
which holds a neighbour, and then with the few other leaves whose boxes are no further than that
one; so rows travel twice, and the pairs that are compared never leave a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..staging import dropped, staged

XYZ = ("x", "y", "z")
NXYZ = ("nx", "ny", "nz")
#: Points of a cell or leaf from which it is cut.
CELL = 2000
#: Leaves at most, sampled points of a leaf, and points that are compared with a leaf in one group.
LEAVES, SAMPLED, GROUP = 1 << 14, 16, 20_000
#: Points of a task, about.
DEALT = 10_000


def _cell(side: float, c: str) -> Column:
    return F.floor(F.col(c) / side)


def fine_side(others: DataFrame, side: float, most: int | None = None) -> float:
    """side, halved until no cell holds more than `most` (CELL) points, or halving no longer helps."""
    before, most = None, CELL if most is None else most
    for _ in range(40):
        top = others.groupBy("seq", *[_cell(side, c) for c in XYZ]).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if top <= most or before is not None and top == before[0] and before[1] > 3:
            break
        before = (top, before[1] + 1 if before is not None and top == before[0] else 0)
        side /= 2
    return side


class _Tree:
    """Cuts of the large seqs' space: a node's left child has what lies below `at` on `axis`; axis -1 is a leaf."""

    def __init__(self) -> None:
        self.axis, self.at, self.left, self.right, self.roots = [], [], [], [], {}

    def grow(self, points: np.ndarray, most: int) -> int:
        """Number of the new node for a sample's points."""
        me = len(self.axis)
        for column in (self.axis, self.left, self.right):
            column.append(-1)
        self.at.append(0.0)
        if len(points) > most:
            axis = int(np.argmax(np.ptp(points, axis=0)))
            v = np.sort(points[:, axis])
            if v[-1] > v[0]:
                at = v[max(len(v) // 2, int(np.searchsorted(v, v[0], "right")))]
                below = points[:, axis] < at
                self.axis[me], self.at[me] = axis, float(at)
                self.left[me], self.right[me] = self.grow(points[below], most), self.grow(points[~below], most)
        return me

    def close(self) -> None:
        self.axis, self.left, self.right = (np.array(c, np.int32) for c in (self.axis, self.left, self.right))
        self.at = np.array(self.at)

    def boxed(self, leaves: dict[int, list[float]]) -> None:
        """Boxes of all nodes from those of the leaves, children having larger numbers than parents."""
        n = len(self.axis)
        self.low, self.high = np.full((n, 3), np.inf), np.full((n, 3), -np.inf)
        for i in range(n - 1, -1, -1):
            if i in leaves:
                self.low[i], self.high[i] = leaves[i][:3], leaves[i][3:]
            elif self.axis[i] >= 0:
                kids = [self.left[i], self.right[i]]
                self.low[i], self.high[i] = self.low[kids].min(0), self.high[kids].max(0)

    def leaf(self, node: np.ndarray, p: np.ndarray) -> np.ndarray:
        node, rows = node.copy(), np.arange(len(node))
        while len(rows := rows[self.axis[node[rows]] >= 0]):
            k = node[rows]
            node[rows] = np.where(p[rows, self.axis[k]] < self.at[k], self.left[k], self.right[k])
        return node

    def touched(self, node: np.ndarray, p: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose box is no further than the row's d2."""
        rows, out = np.arange(len(node)), []
        while len(rows):
            q = p[rows]
            gap = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0.0)
            near = (gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1]) + gap[:, 2] * gap[:, 2] <= d2[rows]
            rows, node = rows[near], node[near]
            end = self.axis[node] < 0
            out.append((rows[end], node[end]))
            rows, node = rows[~end], node[~end]
            rows, node = np.concatenate([rows, rows]), np.concatenate([self.left[node], self.right[node]])
        return np.concatenate([r for r, _ in out] or [rows]), np.concatenate([n for _, n in out] or [node])


def _tree(others: DataFrame) -> tuple[_Tree, DataFrame]:
    """The tree of distinct others, and (seq, root) of the seqs that have more than CELL of them."""
    counts = others.groupBy("seq").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = max(CELL, total // LEAVES)
    counts = counts.where(F.col("n") > size)
    share = min(1.0, SAMPLED / size)
    some = F.pmod(F.xxhash64("seq", *XYZ), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    kept = others.where(some).join(counts.select("seq"), "seq", "left_semi").select("seq", *XYZ).collect()
    tree, by_seq = _Tree(), {}
    for r in kept:
        by_seq.setdefault(r["seq"], []).append(tuple(r)[1:])
    for seq, points in by_seq.items():
        tree.roots[seq] = tree.grow(np.array(points), max(1, round(share * size)))
    tree.close()
    roots = others.sparkSession.createDataFrame(list(tree.roots.items()), others.select("seq", F.lit(0).alias("root")).schema)
    return tree, F.broadcast(roots)


def _compared(points: DataFrame, others: DataFrame) -> DataFrame:
    """points (seq, root, leaf, x, y, z) with d2, nx, ny, nz of the nearest of the others in their leaf. A
    leaf that very many points ask for is held by several groups."""
    key = ["seq", "leaf", "part"]
    many = points.groupBy("seq", "leaf").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    on = ["seq", "leaf"]
    a = points.join(many, on, "left").select("seq", "root", "leaf", F.pmod(F.xxhash64(*XYZ), parts).cast("int").alias("part"), *XYZ)
    b = others.join(many, on, "left").select("seq", "leaf", *NXYZ, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    tasks = min(10_000, 1 + points.count() // DEALT)
    out = points.select("seq", "root", "leaf", *XYZ, F.lit(0.0).alias("d2"), *[F.lit(0.0).alias(c) for c in NXYZ]).schema

    def search(q: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(o):
            return pd.DataFrame(columns=out.names)
        o = o.sort_values(list(NXYZ))  # the first of equal distances is the smallest
        x, y, z = (o[c].to_numpy() for c in NXYZ)
        p, step = q[list(XYZ)].to_numpy(), max(1, (1 << 18) // len(o))
        at, d2 = np.empty(len(q), np.int64), np.empty(len(q))
        for k in range(0, len(q), step):
            u, v, w = (p[k : k + step, i, None] for i in range(3))
            d = (u - x) ** 2
            d += (v - y) ** 2
            d += (w - z) ** 2
            at[k : k + step] = best = d.argmin(1)
            d2[k : k + step] = d[np.arange(len(d)), best]
        return q.assign(d2=d2, nx=x[at], ny=y[at], nz=z[at])[out.names]

    return a.repartition(tasks, *key).groupBy(*key).cogroup(b.repartition(tasks, *key).groupBy(*key)).applyInPandas(search, out)


def nearest(points: DataFrame, others: DataFrame, side: float | None = None) -> DataFrame:
    """points with nx, ny, nz, distance to the nearest of `others` of the same seq; points of a seq
    without others are left out, as are those with a null coordinate. Ties: the smallest (x, y, z).
    Equal points are searched once. The search needs no cell's side; it is taken for older callers."""
    ship(points.sparkSession)
    sound = lambda d: d.where(" and ".join(f"{c} is not null" for c in XYZ))
    whole = sound(points)
    given = staged(sound(others).select("seq", *[F.col(c).cast("double").alias(c) for c in XYZ]).distinct(), "others")
    tree, roots = _tree(given)
    asked = whole.select("seq", *[F.col(c).cast("double").alias(c) for c in XYZ]).distinct().join(given.select("seq").distinct(), "seq", "left_semi")

    @F.pandas_udf("int")
    def leaf(root: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf(root.to_numpy(), np.column_stack([x, y, z])))

    @F.pandas_udf("array<int>")
    def further(root: pd.Series, own: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series, d2: pd.Series) -> pd.Series:
        rows, leaves = tree.touched(root.to_numpy(), np.column_stack([x, y, z]), d2.to_numpy())
        new = leaves != own.to_numpy()[rows]
        rows, leaves = rows[new], leaves[new]
        order = np.argsort(rows, kind="stable")
        return pd.Series(np.split(leaves[order], np.searchsorted(rows[order], np.arange(1, len(root)))))

    def homed(d: DataFrame, label: str) -> DataFrame:
        rooted = d.join(roots, "seq", "left")
        if not tree.roots:
            return staged(rooted.withColumn("leaf", F.lit(-1)), label)
        large = rooted.where("root is not null").withColumn("leaf", leaf("root", *XYZ))
        return staged(large.unionByName(rooted.where("root is null").withColumn("leaf", F.lit(-1))), label)

    held, asked = homed(given, "held"), homed(asked, "asked")
    dropped(given)
    boxes = held.where("root is not null").groupBy("leaf").agg(*[F.min(c) for c in XYZ], *[F.max(c) for c in XYZ]).collect()
    tree.boxed({r["leaf"]: list(r)[1:] for r in boxes})
    leaves = held.select("seq", "leaf", *[F.col(c).alias(n) for c, n in zip(XYZ, NXYZ, strict=True)])
    first = staged(_compared(asked, leaves), "first")
    found = first
    if tree.roots:
        more = first.where("root is not null").select("seq", "root", F.explode(further("root", "leaf", *XYZ, "d2")).alias("leaf"), *XYZ)
        more = staged(more, "more")
        second = _compared(more, leaves)
        n = F.min(F.struct("d2", *NXYZ)).alias("n")
        found = first.unionByName(second).groupBy("seq", *XYZ).agg(n).select("seq", *XYZ, "n.*")
    found = staged(found.select("seq", *XYZ, *NXYZ, F.sqrt("d2").alias("distance")), "found")
    for t in (held, asked, first, *([more] if tree.roots else [])):
        dropped(t)
    return whole.join(found, ["seq", *XYZ]).select(*points.columns, *NXYZ, "distance")


def accuracy_completion(pred: DataFrame, gt: DataFrame, side: float, threshold: float) -> DataFrame:
    """(seq, accuracy, accuracy_median, completion, completion_median, precision, recall, fscore)."""
    one = lambda a, b, n, r: nearest(a, b, side).groupBy("seq").agg(
        F.avg("distance").alias(n), F.median("distance").alias(f"{n}_median"), F.avg((F.col("distance") < threshold).cast("double")).alias(r)
    )
    out = one(pred, gt, "accuracy", "precision").join(one(gt, pred, "completion", "recall"), "seq", "full")
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("fscore", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def voxel_iou(a: DataFrame, b: DataFrame, side: float) -> DataFrame:
    """(seq, iou) of the voxels that the clouds fill."""
    cells = lambda d, c: d.select("seq", *[_cell(side, x).alias(x) for x in XYZ], F.lit(c).alias("c"))
    filled = cells(a, 1).unionAll(cells(b, 2)).groupBy("seq", *XYZ).agg(F.bit_or("c").alias("c"))
    return filled.groupBy("seq").agg((F.sum((F.col("c") == 3).cast("int")) / F.count("*")).alias("iou"))


def umeyama(pairs: DataFrame, scaled: bool = True) -> DataFrame:
    """(seq, scale, rotation by rows, shift) that best take (x, y, z) to (nx, ny, nz), from moments by
    ordinary aggregates; only the 3 x 3 decomposition runs in Python, a row for each seq."""
    ship(pairs.sparkSession)
    src, dst = XYZ, tuple(f"n{c}" for c in XYZ)
    m = pairs.groupBy("seq").agg(
        *[F.avg(c).alias(c) for c in (*src, *dst)], *[F.avg(F.col(d) * F.col(s)).alias(f"{d}_{s}") for d in dst for s in src],
        sum((F.var_pop(c) for c in src[1:]), F.var_pop(src[0])).alias("var"),
    )
    cov = F.array(*[F.col(f"{d}_{s}") - F.col(d) * F.col(s) for d in dst for s in src])

    @F.pandas_udf("rotation array<double>, trace double")
    def decompose(c: pd.Series) -> pd.DataFrame:
        out = []
        for v in c:
            u, d, vt = np.linalg.svd(np.array(v).reshape(3, 3))
            s = np.array([1, 1, -1.0 if np.linalg.det(u) * np.linalg.det(vt) < 0 else 1.0])
            out.append(((u * s @ vt).ravel().tolist(), float((d * s).sum())))
        return pd.DataFrame(out, columns=["rotation", "trace"])

    m = m.withColumn("__d", decompose(cov)).withColumn("rotation", F.col("__d.rotation"))
    scale = F.coalesce(F.try_divide(F.col("__d.trace"), F.col("var")), F.lit(1.0)) if scaled else F.lit(1.0)
    m = m.withColumn("scale", scale)
    turned = [sum((F.col("rotation")[3 * i + j] * F.col(s) for j, s in enumerate(src)), F.lit(0.0)) for i in range(3)]
    return m.select("seq", "scale", "rotation", F.array(*[F.col(d) - F.col("scale") * t for d, t in zip(dst, turned, strict=True)]).alias("shift"))


def moved(points: DataFrame, motions: DataFrame) -> DataFrame:
    """Points of each seq under its motion; a seq without one stays."""
    r, s = F.col("rotation"), F.col("scale")
    new = [s * sum((r[3 * i + j] * F.col(c) for j, c in enumerate(XYZ)), F.lit(0.0)) + F.col("shift")[i] for i in range(3)]
    rows = points.join(motions.select("seq", "scale", "rotation", "shift"), "seq", "left")
    rows = rows.withColumn("__p", F.when(r.isNotNull(), F.array(*new)).otherwise(F.array(*XYZ)))
    return rows.select(*[F.col("__p")[XYZ.index(c)].alias(c) if c in XYZ else F.col(c) for c in points.columns])


def icp(points: DataFrame, target: DataFrame, side: float, rounds: int = 5, reach: float | None = None) -> DataFrame:
    """Point-to-point refinement: nearest neighbours (within reach), then the best rigid motion."""
    for k in range(rounds):
        pairs = nearest(points, target, side)
        if reach is not None:
            pairs = pairs.where(F.col("distance") <= reach)
        before = points
        points = staged(moved(points, umeyama(pairs, scaled=False)), "moved")  # else the lineage would grow with the rounds
        if k:  # the caller's own stay
            dropped(before)
    return points


def outliers_dropped(points: DataFrame, spread: float = 2.0) -> DataFrame:
    """Without points further than `spread` deviations from their seq's centre."""
    c = points.groupBy("seq").agg(*[F.avg(x).alias(f"m{x}") for x in XYZ], *[F.stddev_pop(x).alias(f"s{x}") for x in XYZ])
    near = [F.abs(F.col(x) - F.col(f"m{x}")) <= spread * F.col(f"s{x}") for x in XYZ]
    return points.join(c, "seq").where(near[0] & near[1] & near[2]).select(*points.columns)
