"""Exact top-k search by inner product without random access.

Candidates lie in blocks. In a block, every dimension has a list of its rows sorted by component.
A query reads the lists in step, from the end at which its products are largest: what a row has
shown so far plus the best and the worst of what it may still show bounds its score. Reading stops
when no row outside the current best can reach the k-th lower bound; the scores of rows that still
can are then resolved in full. Blocks of queries meet blocks of candidates, so a task holds one
block of each; their best k are merged by a bounded window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, ship, table

K, SCALE, EVERY = 10, 1024, 100
#: Rows of a candidate block and of a query block at most (in expectation).
BLOCK, QUERIES = 8192, 8192
#: Shares of the lists' length read in each round; bounds of sums that numpy's doubles and integers
#: hold exactly; slack of the bounds, as a share of the largest sum.
ROUNDS, DOUBLE, LONG, SLACK = (0.25, 0.6, 0.8, 1.0), 2**53, 2**63, 1e-9


class SortedLists:
    """A block's lists: order[d] has the rows of dimension d by falling component."""

    def __init__(self, x: np.ndarray) -> None:
        self.whole, self.x = x, x.astype(np.float64)
        self.most = float(np.abs(self.x).max(initial=0.0))
        self.order = np.argsort(-self.x, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(self.x.T, self.order, axis=1)

    def _read(self, down: np.ndarray, up: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and components at depths a to b: from the top of the lists `down`, the foot of `up`."""
        n = len(self.x)
        ends = slice(n - b, n - a)
        return (
            np.concatenate([self.order[down, a:b], self.order[up, ends][:, ::-1]]),
            np.concatenate([self.sorted[down, a:b], self.sorted[up, ends][:, ::-1]]),
        )

    def search(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best by q: at least all of them, ties included."""
        n = len(self.x)
        down, up = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        w = np.concatenate([q[down], q[up]]).astype(np.float64)[:, None]
        if n <= k or not len(w):
            return np.arange(n)
        floor = self._read(down, up, n - 1, n)[1] * w  # the worst that a list holds
        lower = np.full(n, floor.sum())
        # doubles round sums beyond 2^53; the bounds give way by more than that
        largest = self.most * float(np.abs(w).sum())
        slack = SLACK * largest if largest >= DOUBLE else 0.0
        rows, part, at = [], [], 0
        alive = np.arange(n)
        for share in ROUNDS:
            to = min(n, max(at + 1, int(np.ceil(share * n))))
            r, v = self._read(down, up, at, to)
            v = v * w
            rows.append(r), part.append(v)
            lower += np.bincount(r.ravel(), (v - floor).ravel(), n)
            at = to
            last = v[:, -1:]  # no unread entry of a list is better
            upper = np.full(n, last.sum())
            for r, v in zip(rows, part, strict=True):
                upper += np.bincount(r.ravel(), (v - last).ravel(), n)
            alive = np.flatnonzero(upper + slack >= np.partition(lower, n - k)[n - k])
            if len(alive) <= 4 * k:  # outsiders can't qualify; the rest is resolved in full
                break
        return alive

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products of rows with q as whole numbers; one that a long can't hold raises."""
        largest = self.most * float(np.abs(q.astype(np.float64)).sum())
        if largest < DOUBLE:
            return (self.x[rows] @ q.astype(np.float64)).astype(np.int64)
        if largest < LONG / 2:
            return self.whole[rows] @ q
        exact = self.whole[rows].astype(object) @ q.astype(object)
        if any(not -LONG <= v < LONG for v in exact):
            raise OverflowError("an inner product passes the range of a long")
        return exact.astype(np.int64)


def best(lists: SortedLists, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best rows (ties: smaller id), without the query's own."""
    rows = lists.search(query, k + int((ids == own).sum()))
    rows = rows[ids[rows] != own]
    score = lists.scores(rows, query)
    top = np.lexsort([ids[rows], -score])[:k]
    return ids[rows][top], score[top]


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component, x as double. Vectors null or holding null or
    non-finite components are left out; a component whose floor a long can't hold raises."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(F.coalesce(finite, F.lit(False)))
    whole = lambda v: F.when(F.abs(v * scale) < float(LONG), F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component passes the range of a long")).cast("long"))
    return rows.select("vec_id", F.transform(x, whole).alias("q"))


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) for every query row against every other row.

    Only vectors of one length are compared with each other. A query's own rows (the same vec_id)
    are no candidates; repeated rows of other ids count as often as they occur. A query id in
    several rows is one query, by its smallest (shortest, then least) vector. Scores are exact
    longs, one beyond their range raises; ties go to the smaller vec_id. No queries or no
    candidates: no rows.
    """
    ship(vectors.sparkSession)
    rows = materialize(quantized(vectors, scale).withColumn("dim", F.size("q")), "vectors")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "q")).alias("v")).select("vec_id", "v.q", "v.dim")
    n, nq = rows.count(), asked.count()
    blocks, qblocks = max(1, -(-n // block)), max(1, -(-nq // queries))
    mine = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    across = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.select("vec_id", "q", "dim", mine(blocks).alias("b")).withColumn("qb", across(qblocks))
    right = asked.select("vec_id", "q", "dim", mine(qblocks).alias("qb")).withColumn("b", across(blocks))

    def search(cand: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cand) and len(query):
            ids = cand["vec_id"].to_numpy("int64")
            lists = SortedLists(np.stack(cand["q"].to_numpy()))
            for own, q in zip(query["vec_id"], query["q"], strict=True):
                v, s = best(lists, ids, np.asarray(q, np.int64), own, k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": v, "score": s}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    keys = ["dim", "b", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best of all embeddings for each whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


OP9_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)::bigint) as q
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select vec_id, arg_min(q, {'n': len(q), 'q': q}) as q from v where vec_id % 100 = 0 group by vec_id),
s as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1]::hugeint * p[2]))::bigint as score
  from a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""
