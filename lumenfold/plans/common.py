"""Tables and the synthetic boxes that stand for detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str, each: int = 50_000) -> DataFrame:
    """Rows of a stored table dealt by key to tasks of about `each` rows, for steps that make many rows of
    one: tasks that are put together by their bytes before would hold too many."""
    return rows.repartition(1 + rows.count() // each, key)


def box_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A true box for each line item and, unless returned, a shifted prediction; whole numbers."""
    l = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").cast("int").alias("pos"), F.col("l_returnflag").alias("cat"),
        (F.col("l_partkey") % 100).cast("int").alias("x"), (F.col("l_suppkey") % 100).cast("int").alias("y"),
        (F.lit(20) + F.col("l_quantity").cast("int") % 30).alias("w"), (F.lit(20) + F.col("l_linenumber").cast("int") * 5).alias("h"),
        ((F.col("l_partkey") + F.col("l_linenumber")) % 7).cast("int").alias("dx"), ((F.col("l_suppkey") + F.col("l_linenumber")) % 5).cast("int").alias("dy"),
        F.round(F.col("l_discount").cast("double"), 2).alias("score"),
    )
    return l.withColumn("has_pred", F.col("cat") != "R")


def box_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: gt and pred, arrays of (cat, box) in order of position."""
    r = box_rows(spark, sf_dir)
    g = F.struct("pos", "x", "y", "w", "h", "cat")
    p = F.struct("pos", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "w", "h", "cat")
    out = r.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(g)).alias("gt"), F.array_sort(F.collect_list(F.when(F.col("has_pred"), p))).alias("pred")
    )
    entry = lambda e: F.struct(e["cat"].alias("cat"), boxes.xyxy(e["x"], e["y"], e["w"], e["h"]).alias("box"))
    return out.select("sample_id", F.transform("gt", entry).alias("gt"), F.transform("pred", entry).alias("pred"))


#: The same rows in SQL: gt and pred with their places gi and pi in the sample.
BOXES = """
rows_ as (
  select l_orderkey as sample_id, l_linenumber::int as pos, l_returnflag as cat, (l_partkey % 100)::int as x, (l_suppkey % 100)::int as y,
    20 + trunc(l_quantity)::int % 30 as w, 20 + l_linenumber::int * 5 as h, ((l_partkey + l_linenumber) % 7)::int as dx,
    ((l_suppkey + l_linenumber) % 5)::int as dy, round(l_discount::double, 2) as score
  from lineitem),
gt as (
  select sample_id, row_number() over (partition by sample_id order by pos, x, y, w, h, cat) as gi, cat,
    x::double as x0, y::double as y0, (x + w)::double as x1, (y + h)::double as y1 from rows_),
pred as (
  select sample_id, row_number() over (partition by sample_id order by pos, x + dx, y + dy, w, h, cat) as pi, cat,
    (x + dx)::double as x0, (y + dy)::double as y0, (x + dx + w)::double as x1, (y + dy + h)::double as y1, score, pos
  from rows_ where cat <> 'R'),
cross_ as (
  select g.sample_id, gi, pi, g.cat as gcat, p.cat as pcat,
    greatest(least(g.x1, p.x1) - greatest(g.x0, p.x0), 0) * greatest(least(g.y1, p.y1) - greatest(g.y0, p.y0), 0) as inter,
    (g.x1 - g.x0) * (g.y1 - g.y0) as ga, (p.x1 - p.x0) * (p.y1 - p.y0) as pa
  from gt g join pred p using (sample_id)),
pairs as (select sample_id, gi, pi, gcat, pcat, inter / (ga + pa - inter) as iou from cross_ where inter > 0)
"""


def greedy_sql(where: str = "true", thresholds: str = "0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95") -> str:
    """CTEs of greedy matching: counts has a row for each sample and threshold."""
    return f"""
cand as (select *, exists (select 1 from gt where gt.sample_id = pairs.sample_id and gt.cat = pairs.pcat) as known from pairs),
thr as (select unnest([{thresholds}])::double as thr),
sizes as (
  select sample_id, n_gt, coalesce(n_pred, 0) as n_pred from (select sample_id, count(*) as n_gt from gt group by 1)
  left join (select sample_id, count(*) as n_pred from pred group by 1) using (sample_id)),
walk as (
  select sample_id, thr, 0::bigint as gi, []::bigint[] as used from sizes, thr
  union all
  select w.sample_id, w.thr, w.gi + 1, case when b.pi is null then w.used else list_append(w.used, b.pi) end
  from walk w join sizes s on s.sample_id = w.sample_id and w.gi < s.n_gt
  left join lateral (
    select c.pi from cand c where c.sample_id = w.sample_id and c.gi = w.gi + 1 and c.iou >= w.thr and ({where})
      and not list_contains(w.used, c.pi) order by c.iou desc, c.pi limit 1) b on true),
counts as (
  select w.sample_id, w.thr, len(w.used) as matches, n_gt, n_pred, len(w.used) / n_gt as recall,
    case when n_pred = 0 then 0.0 else len(w.used) / n_pred end as precision
  from walk w join sizes s on s.sample_id = w.sample_id and w.gi = s.n_gt)
"""
