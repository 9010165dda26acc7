"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated to the principal axes of all vectors. A tree over the
leading axes cuts them into leaves; two leaves whose boxes lie further apart than the threshold
allows are never compared. A large leaf is cut into tiles of bounded size by a hash, so the tree
stays small. Within a pair of tiles products of the leading axes come
first; what the rest can add is bounded by the norms of the suffixes, and only pairs that may
still reach the threshold go on. Equal vectors are one class with a count from the start.

Cosine c of unit vectors means squared distance 2 - 2c, so boxes further apart than the root of
2 - 2 * threshold hold no link between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hash_unit, materialize, ship, table
from .components import connected_components

THRESHOLD = 0.9
#: Vectors of a tile at most (in expectation), tiles aimed at where there are few vectors, leaves of
#: the tree at most, its leading axes, vectors that place its cuts at most (in expectation).
TILE, TILES, LEAVES, AXES, SAMPLE = 4096, 12, 1024, 8, 20_000
#: Rows of a tile compared with one another at once; axes added in each stage; slack of the bounds.
ROWS, STAGES, SLACK = 1024, (16, 32), 1e-9


def valid(x):
    """Not null, finite throughout, not zero, not empty."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component first, so that nothing overflows."""
    x = rows / np.abs(rows).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Columns: axes by falling variance, from the second moments of all unit vectors; each task
    sends the sums of its rows, dim * dim numbers in all reach the driver."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for b in batches:
            u = units(np.stack(b["x"].to_numpy()))
            total += u.T @ u
        i, j = np.divmod(np.arange(dim * dim), dim)
        yield pd.DataFrame({"i": i, "j": j, "s": total.ravel()})

    got = classes.select("x").mapInPandas(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    m = np.zeros((dim, dim))
    m[got["i"], got["j"]] = got["s"]
    _, axes = np.linalg.eigh(m)
    return axes[:, ::-1]


class Tree:
    """Cuts at medians of a sample, always along the leading axis of widest spread in the node."""

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, cut, left, right; leaf: axis -1, number
        self.leaves = 0
        self._grow(points, max(1, leaves))

    def _grow(self, p: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0))
        spread = p.std(0) if len(p) > 1 else np.zeros(1)
        axis = int(np.argmax(spread))
        if leaves > 1 and spread[axis] > 0:
            cut = float(np.median(p[:, axis]))
            low = p[:, axis] < cut
            if low.any() and not low.all():
                left, right = self._grow(p[low], leaves // 2), self._grow(p[~low], leaves - leaves // 2)
                self.nodes[at] = (axis, cut, left, right)
                return at
        self.nodes[at] = (-1, 0.0, self.leaves, 0)
        self.leaves += 1
        return at

    def place(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        todo = [(0, np.arange(len(p)))]
        while todo:
            node, rows = todo.pop()
            axis, cut, left, right = self.nodes[node]
            if axis < 0:
                out[rows] = left
            elif len(rows):
                low = p[rows, axis] < cut
                todo += [(left, rows[low]), (right, rows[~low])]
        return out


def _spread_labels(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Smallest labels over the links of a block, in place, until nothing changes."""
    big = np.iinfo(np.int64).max
    while True:
        b2 = np.minimum(b, np.where(near, a[:, None], big).min(0))
        a2 = np.minimum(a, np.where(near, b2[None, :], big).min(1))
        if (a2 == a).all() and (b2 == b).all():
            return
        a[:], b[:] = a2, b2


def linked(
    a: np.ndarray, b: np.ndarray, ta: np.ndarray, tb: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Which unit rows of a (axes order) link with which of b, and the indices of those too near the
    threshold to tell by rotated components. ta, tb: norms of the suffixes behind each stage. None
    if the bounds rule out all."""
    low, high, at = threshold - SLACK, threshold + SLACK, 0
    part = np.zeros((len(a), len(b)))
    for k, to in enumerate([*(s for s in STAGES if s < a.shape[1]), a.shape[1]]):
        part += a[:, at:to] @ b[:, at:to].T
        at = to
        if at < a.shape[1]:
            alive = part + ta[:, k, None] * tb[None, :, k] >= low
            n = int(alive.sum())
            if not n:
                return None
            if n * 20 < alive.size:  # few: finish them pair by pair
                i, j = np.nonzero(alive)
                v = part[i, j] + np.einsum("ij,ij->i", a[i, at:], b[j, at:])
                keep, edge = v >= low, (v >= low) & (v < high)
                alive[i[~keep], j[~keep]] = False
                return alive, i[edge], j[edge]
    return part >= low, *np.nonzero((part >= low) & (part < high))


def compare(left: pd.DataFrame, right: pd.DataFrame | None, axes: np.ndarray, threshold: float) -> pd.DataFrame:
    """Links of two tiles, or of one with itself (right None): for each class the number of linked
    vectors, and an edge to the smallest class of its part of the tiles."""

    def load(t: pd.DataFrame):
        x = np.stack(t["x"].to_numpy()).astype(np.float64)
        u = units(x)
        r = u @ axes
        sq = np.cumsum((r**2)[:, ::-1], axis=1)[:, ::-1]
        tails = np.stack([np.sqrt(sq[:, s]) for s in STAGES if s < r.shape[1]] or [np.zeros(len(r))], axis=1)
        return t["cid"].to_numpy("int64"), t["copies"].to_numpy("int64"), u, r, tails

    ia, ca, ua, ra, ta = load(left)
    ib, cb, ub, rb, tb = (ia, ca, ua, ra, ta) if right is None else load(right)
    na, nb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
    edges = []
    for i in range(0, len(ia), ROWS):
        si = slice(i, i + ROWS)
        for j in range(i if right is None else 0, len(ib), ROWS):
            sj = slice(j, j + ROWS)
            got = linked(ra[si], rb[sj], ta[si], tb[sj], threshold)
            if got is None:
                continue
            near, p, q = got
            below = np.einsum("ij,ij->i", ua[si][p], ub[sj][q]) < threshold  # by their own components
            near[p[below], q[below]] = False
            if right is None and i == j:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            na[si] += near @ cb[sj]
            if right is not None or i != j:
                nb[sj] += near.T @ ca[si]
            la, lb = ia[si].copy(), ib[sj].copy()
            _spread_labels(near, la, lb)
            edges += [(ia[si][la != ia[si]], la[la != ia[si]]), (ib[sj][lb != ib[sj]], lb[lb != ib[sj]])]
    if right is None:
        na = na + nb
    ids, n = (ia, na) if right is None else (np.concatenate([ia, ib]), np.concatenate([na, nb]))
    out = [pd.DataFrame({"cid": ids[n > 0], "links": n[n > 0], "to": ids[n > 0]})]
    out += [pd.DataFrame({"cid": a, "links": 0, "to": b}) for a, b in edges]
    return pd.concat(out)


def near_links(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row, in double precision.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing;
    neither do vectors of different lengths, rows with a null vec_id keep their links but are never
    a component's smallest id. Repeated rows are vectors of their own and link with each other.
    """
    spark = vectors.sparkSession
    ship(spark)
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", F.when(valid(x), x).alias("x"))
    classes = materialize(rows.where("x is not null").groupBy("x").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")).withColumn("cid", F.monotonically_increasing_id()), "vectors")
    dims = [r["d"] for r in classes.select(F.size("x").alias("d")).distinct().collect()]
    found = [_compared(classes.where(F.size("x") == d), d, threshold, tile) for d in sorted(dims)]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for f in found[1:]:
        links = links.unionAll(f)
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(links.where("links = 0"), "cid", "to").withColumnRenamed("node", "cid")
    rooted = classes.select("cid", "copies", "least").join(parts, "cid", "left").withColumn("root", F.coalesce("component", "cid"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    judged = rooted.join(least, "root").join(counts, "cid", "left").select("cid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = materialize(classes.select("x", "cid").join(judged, "cid").drop("cid"), "named")
    for used in (classes, *found):
        discard(used)
    out = rows.join(named, "x", "left")
    component = F.when(F.col("x").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


def _compared(classes: DataFrame, dim: int, threshold: float, tile: int) -> DataFrame:
    """(cid, links, to) of vectors of one length: counts (to = cid) and edges (links = 0)."""
    spark = classes.sparkSession
    n = classes.count()
    axes = principal_axes(classes, dim)
    size = max(64, min(tile, n // TILES))
    lead = min(AXES, dim)

    def project(x: np.ndarray) -> np.ndarray:
        return units(np.stack(x)) @ axes[:, :lead]

    sample = classes.where(hash_unit("cid") < min(1.0, SAMPLE / max(1, n))).select("x").toPandas()["x"].to_numpy()
    tree = spark.sparkContext.broadcast(Tree(project(sample) if len(sample) else np.zeros((1, lead)), min(LEAVES, -(-n // size))))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = project(b["x"].to_numpy()) if len(b) else np.zeros((0, lead))
            yield b[["cid", "x", "copies"]].assign(leaf=tree.value.place(p), p=list(p))

    schema = "cid long, x array<double>, copies long, leaf long, p array<double>"
    placed = materialize(classes.mapInPandas(place, schema), "placed")
    box = [f(F.col("p")[k]).alias(f"{c}{k}") for k in range(lead) for c, f in (("lo", F.min), ("hi", F.max))]
    leaves = materialize(placed.groupBy("leaf").agg(F.ceil(F.count("*") / size).cast("int").alias("cuts"), *box), "boxes")
    boxes = leaves.toPandas()  # LEAVES rows at most
    names, cuts = boxes["leaf"].to_numpy(), boxes["cuts"].to_numpy()
    lo, hi = (boxes[[f"{c}{k}" for k in range(lead)]].to_numpy() for c in ("lo", "hi"))
    far = 2 - 2 * threshold + 1e-6

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for la in b["leaf"]:
                i = np.flatnonzero(names == la)[0]
                gap = np.maximum(0, np.maximum(lo[i] - hi, lo - hi[i]))
                j = np.flatnonzero(((gap**2).sum(1) <= far) & (names >= la))
                yield pd.DataFrame({"la": la, "lb": names[j], "na": cuts[i], "nb": cuts[j]})

    pairs = materialize(leaves.select("leaf").mapInPandas(near, "la long, lb long, na int, nb int"), "pairs")
    rows = placed.join(F.broadcast(leaves.select("leaf", "cuts")), "leaf").select("cid", "x", "copies", "leaf", F.pmod(F.xxhash64("cid"), "cuts").cast("int").alias("cut"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    one = rows.join(pairs, rows["leaf"] == pairs["la"]).select("la", F.col("cut").alias("ca"), "lb", every("nb"), F.lit(0).alias("side"), "cid", "x", "copies").withColumnRenamed("other", "cb")
    two = rows.join(pairs, rows["leaf"] == pairs["lb"]).select("la", every("na"), "lb", F.col("cut").alias("cb"), F.lit(1).alias("side"), "cid", "x", "copies").withColumnRenamed("other", "ca")
    # tiles of one leaf meet once, and a tile meets itself
    sent = one.where("la <> lb or ca <= cb").unionByName(two.where("la <> lb or ca < cb"))

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if key[:2] == key[2:]:
            return compare(left, None, axes, threshold)
        if not len(left) or not len(right):
            return pd.DataFrame({"cid": [], "links": [], "to": []}).astype("int64")
        return compare(left, right, axes, threshold)

    out = materialize(sent.groupBy("la", "ca", "lb", "cb").applyInPandas(meet, "cid long, links long, to long"), "links")
    for used in (placed, leaves, pairs):
        discard(used)
    return out


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return near_links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP3_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as x from embeddings
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_cosine_similarity(a.x, b.x) >= 0.9),
r as (select a as n, b as m from l union select r.n, l.b from r join l on r.m = l.a),
c as (select n, least(n, min(m)) as component_id from r group by n),
k as (select a, count(*) as n_links from l group by a)
select e.vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, e.vec_id) as component_id,
  coalesce(component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join c on c.n = e.vec_id left join k on k.a = e.vec_id
"""
