"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Every round is a handful of equi-joins and partial aggregates over the edge list; no neighbour
list is ever collected, and every round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node that has a link to another node.

    component is the smallest node reachable. Self links and repeated links are ignored, nulls
    dropped; an empty edge table gives an empty result. Nodes without links are absent.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    pairs = (
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    current = materialize(pairs, "cc")
    seen = _signature(current)
    while seen[0]:
        both = current.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionAll(
            current.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        )
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(low, "a")
            .where("b > a")
            .select(F.col("b").alias("hi"), F.least("a", "m").alias("lo"))
            .distinct()
        )
        parent = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(parent, "hi")
            .where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionAll(parent.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        nxt = materialize(small, "cc")
        now = _signature(nxt)
        discard(current)
        current = nxt
        if now == seen:
            break
        seen = now
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
