"""Exact quantiles of groups and the normalisers that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quantiles
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
select l_returnflag as flag, count(*) as n, round(quantile_cont(l_extendedprice, 0.02), 4) as low, round(quantile_cont(l_extendedprice, 0.5), 4) as middle, round(quantile_cont(l_extendedprice, 0.98), 4) as high
from lineitem group by 1
""")
def group_quantiles(spark, sf_dir: str) -> DataFrame:
    """Quantiles of three large groups."""
    q = quantiles.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", (0.02, 0.5, 0.98))
    return q.select(F.col("l_returnflag").alias("flag"), "n", *[F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(("low", "middle", "high"))])


@query("""
with q as (select l_suppkey, quantile_cont(l_extendedprice::double, 0.02) as a, quantile_cont(l_extendedprice::double, 0.98) as b from lineitem where l_linenumber <> 3 group by 1)
select l_orderkey, l_partkey, l_linenumber, l_suppkey as image, case when b > a then round(least(greatest((l_extendedprice - a) / (b - a) * 2 - 1, -1), 1), 6) end as normal from lineitem left join q using (l_suppkey)
""")
def depth_normalized(spark, sf_dir: str) -> DataFrame:
    """Depths between the quantiles of their image's valid ones."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_suppkey").alias("image"), F.col("l_extendedprice").cast("double").alias("depth"), (F.col("l_linenumber") != 3).alias("valid"))
    return quantiles.normalized_depth(l, ["image"]).select("l_orderkey", "l_partkey", "l_linenumber", "image", F.round("normal", 6).alias("normal"))


def _scene(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as points: a label is a sequence of five frames; every seventh point is invalid."""
    v, i = F.col("embedding").cast("array<double>"), F.col("vec_id")
    p = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("label").alias("seq"), (i % 5).alias("frame"), i.alias("id"), *[v[k].alias(c) for k, c in enumerate("xyz")], (i % 7 != 0).alias("valid"))
    return p, p.select("seq").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).withColumns({"x": F.col("frame") * 0.1, "y": F.lit(0.25), "z": F.lit(-0.5) + F.col("frame") / 8})


_SCENE = """
p as (select label as seq, vec_id % 5 as frame, vec_id as id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, vec_id % 7 <> 0 as valid from embeddings where embedding is not null),
c as (select seq, f as frame, f * 0.1::double as x, 0.25::double as y, -0.5 + f / 8::double as z from (select distinct seq from p), range(5) t(f)),
m as (select seq, avg(x) as mx, avg(y) as my, avg(z) as mz from (select seq, frame, avg(x) as x, avg(y) as y, avg(z) as z from p where valid group by all) group by seq),
pm as (select p.seq, frame, id, x - mx as x, y - my as y, z - mz as z, valid from p join m using (seq)),
cm as (select c.seq, frame, x - mx as x, y - my as y, z - mz as z from c join m using (seq)),
d as (select pm.seq, sqrt((pm.x - e.x) ** 2 + (pm.y - e.y) ** 2 + (pm.z - e.z) ** 2) as d from pm join cm e on e.seq = pm.seq and e.frame = 0 where valid),
k as (select seq, d + 1e-6 as s from (select *, row_number() over (partition by seq order by d desc) as r, count(*) over (partition by seq) as n from d) where r = greatest(floor(n * 0.005 + 0.5), 1)),
sc as (select pm.seq, pm.frame, id, valid, pm.x / s as x, pm.y / s as y, pm.z / s as z, e.x as ex, e.y as ey, e.z as ez from pm join k using (seq) join cm e on e.seq = pm.seq and e.frame = pm.frame),
r as (
  select *, coalesce(list_min(list_filter([(sign(x - ex) - ex) / nullif(x - ex, 0), (sign(y - ey) - ey) / nullif(y - ey, 0), (sign(z - ez) - ez) / nullif(z - ez, 0)], lambda v: v > 0)), 0) as t from sc)
"""


@query(f"with {_SCENE} select seq, id, " + ", ".join(f"round(case when valid then {c} else least(greatest(t * ({c} - e{c}) + e{c}, -1), 1) end, 6) + 0.0 as {c}" for c in "xyz") + " from r")
def sequence_normalized(spark, sf_dir: str) -> DataFrame:
    points, _ = quantiles.normalized_sequences(*_scene(spark, sf_dir))
    return points.select("seq", "id", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


@query(f"with {_SCENE} select cm.seq, frame, " + ", ".join(f"round({c} / s, 6) + 0.0 as {c}" for c in "xyz") + " from cm join k using (seq)")
def cameras_normalized(spark, sf_dir: str) -> DataFrame:
    _, cameras = quantiles.normalized_sequences(*_scene(spark, sf_dir))
    return cameras.select("seq", "frame", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


@query("select label as seq, round(greatest(coalesce(sum(d), 0) / (count(d) + 1e-8), 1e-8), 6) as factor from (select label, case when embedding[1] > 0 then embedding[1]::double end as d from embeddings) group by 1")
def mean_depth_factor(spark, sf_dir: str) -> DataFrame:
    """What an image's depths are divided by: the mean of those above 0."""
    e = table(spark, sf_dir, "embeddings")
    return quantiles.unit_mean(e, ["label"], F.col("embedding")[0].cast("double")).select(F.col("label").alias("seq"), F.round("factor", 6).alias("factor"))
