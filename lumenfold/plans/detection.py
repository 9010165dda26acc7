"""Detection, pointing and keypoint metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..operators import matching
from .common import BOXES, box_rows, box_samples, greedy_sql, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _macro_sql(where: str) -> str:
    return f"""
with recursive {BOXES}, {greedy_sql(where)}
select iou, round(r, 6) as recall, round(p, 6) as precision, case when p + r > 0 then round(2 * p * r / (p + r), 6) else 0.0 end as f1, samples
from (select thr as iou, avg(recall) as r, avg(precision) as p, count(*) as samples from counts group by thr)
"""


@query(_macro_sql("c.known"))
def det_prf1_multi_iou(spark, sf_dir: str) -> DataFrame:
    return matching.macro(matching.detection_counts(box_samples(spark, sf_dir)), "iou")


@query(_macro_sql("c.gcat = c.pcat"))
def det_prf1_by_category(spark, sf_dir: str) -> DataFrame:
    return matching.macro(matching.detection_counts(box_samples(spark, sf_dir), mode="by_category"), "iou")


@query(_macro_sql("true"))
def det_referring(spark, sf_dir: str) -> DataFrame:
    return matching.macro(matching.detection_counts(box_samples(spark, sf_dir), mode="referring"), "iou")


@query(f"""
with recursive {BOXES}, {greedy_sql("c.known")},
m as (select thr, avg(recall) as r, avg(precision) as p, count(*) as n from counts group by thr),
f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end as f from m)
select round(max(case when thr = 0.5 then f end), 6) as iou05_f1, round(max(case when thr = 0.95 then f end), 6) as iou095_f1,
  round(avg(p), 6) as miou_precision, round(avg(r), 6) as miou_recall, round(avg(f), 6) as miou_f1, max(n) as samples from f
""")
def det_summary(spark, sf_dir: str) -> DataFrame:
    """Means over the thresholds, two levels."""
    counts = matching.detection_counts(box_samples(spark, sf_dir))
    m = counts.groupBy("iou").agg(F.avg("recall").alias("r"), F.avg("precision").alias("p"), F.count("*").alias("n"))
    m = m.withColumn("f", matching.f1(F.col("p"), F.col("r")))
    at = lambda t: F.round(F.max(F.when(F.col("iou") == t, F.col("f"))), 6)
    return m.agg(
        at(0.5).alias("iou05_f1"), at(0.95).alias("iou095_f1"), F.round(F.avg("p"), 6).alias("miou_precision"),
        F.round(F.avg("r"), 6).alias("miou_recall"), F.round(F.avg("f"), 6).alias("miou_f1"), F.max("n").alias("samples"),
    )


@query(f"""
with {BOXES}
select g.sample_id, count(*) filter (where (p.x0 + p.x1) / 2 between g.x0 and g.x1 and (p.y0 + p.y1) / 2 between g.y0 and g.y1) > 0 as hit
from gt g left join pred p using (sample_id) where g.gi = 1 group by g.sample_id
""")
def det_gui(spark, sf_dir: str) -> DataFrame:
    """The first box is the target; a centre of a predicted box in it is a hit."""
    s = box_samples(spark, sf_dir)
    found = F.transform("pred", lambda p: p["box"])
    hit = matching.gui_hit(F.array().cast("array<array<double>>"), found, F.get("gt", F.lit(0))["box"])
    return s.select("sample_id", (hit > 0).alias("hit"))


@query("""
select o_orderpriority as dataset, round(avg((coalesce(n, 0) = 0)::int), 6) as accuracy, count(*) as samples
from orders left join (select l_orderkey, count(*) as n from lineitem where l_returnflag <> 'R' group by 1) on l_orderkey = o_orderkey group by 1
""")
def det_halluc(spark, sf_dir: str) -> DataFrame:
    """A sample that should have no box scores 1 if nothing was predicted."""
    n = box_rows(spark, sf_dir).where("has_pred").groupBy("sample_id").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("sample_id"), "left")
    return o.groupBy(F.col("o_orderpriority").alias("dataset")).agg(
        F.round(F.avg(F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).otherwise(0.0)), 6).alias("accuracy"), F.count("*").alias("samples")
    )


@query(f"with {BOXES} select round(avg(abs(n_gt - coalesce(n_pred, 0))), 6) as mae, count(*) as samples from (select sample_id, count(*) as n_gt from gt group by 1) left join (select sample_id, count(*) as n_pred from pred group by 1) using (sample_id)")
def det_count_mae(spark, sf_dir: str) -> DataFrame:
    s = box_samples(spark, sf_dir)
    return s.agg(F.round(F.avg(F.abs(F.size("gt") - F.size("pred"))), 6).alias("mae"), F.count("*").alias("samples"))


@query(f"""
with {BOXES}, a as (select sample_id, list_distinct(list(cat)) as cats from gt group by 1), b as (select sample_id, list_distinct(list(cat)) as cats from pred group by 1)
select a.sample_id, round(len(list_intersect(a.cats, coalesce(b.cats, []))) / len(a.cats), 6) as ratio from a left join b using (sample_id)
""")
def det_instruction_following(spark, sf_dir: str) -> DataFrame:
    s = box_samples(spark, sf_dir)
    cats = lambda c: F.transform(c, lambda e: e["cat"])
    return s.select("sample_id", F.round(matching.followed(F.array_distinct(cats("gt")), cats("pred")), 6).alias("ratio"))


@query("""
select l_linestatus as dataset, round(sum(refused)::double / count(*), 6) as wrong_rejection, count(*) as samples from (
  select l_linestatus, (bool_or(l_returnflag = 'R'))::int as refused from lineitem group by l_linestatus, l_orderkey) group by 1
""")
def det_wrong_rejection(spark, sf_dir: str) -> DataFrame:
    """Returned items answered `None`."""
    l = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_orderkey", F.when(F.col("l_returnflag") == "R", "None").otherwise(F.col("l_returnflag")).alias("a"))
    s = l.groupBy("l_linestatus", "l_orderkey").agg(F.collect_set("a").alias("answers")).withColumn("refused", matching.refused_wrongly(F.col("answers")))
    return s.groupBy(F.col("l_linestatus").alias("dataset")).agg(F.round(F.sum("refused") / F.count("*"), 6).alias("wrong_rejection"), F.count("*").alias("samples"))


@query(f"""
with {BOXES}, g as (select sample_id, case when (x1 - x0) * (y1 - y0) < 1024 then 'small' when (x1 - x0) * (y1 - y0) < 9216 then 'medium' else 'large' end as size, 1 as g, 0 as p from gt
  union all select sample_id, case when (x1 - x0) * (y1 - y0) < 1024 then 'small' when (x1 - x0) * (y1 - y0) < 9216 then 'medium' else 'large' end, 0, 1 from pred)
select size, sum(g)::bigint as n_gt, sum(p)::bigint as n_pred from g group by size
""")
def det_size_buckets(spark, sf_dir: str) -> DataFrame:
    s = box_samples(spark, sf_dir)
    one = lambda c, g, p: s.select(F.explode(c).alias("e")).select(boxes.size_bucket(boxes.area(F.col("e.box"))).alias("size"), F.lit(g).alias("g"), F.lit(p).alias("p"))
    return one("gt", 1, 0).unionAll(one("pred", 0, 1)).groupBy("size").agg(F.sum("g").alias("n_gt"), F.sum("p").alias("n_pred"))


@query(f"""
with recursive {BOXES}, {greedy_sql("c.known", "0.5")}
select case when n_gt <= 1 then '1' when n_gt <= 3 then '2-3' when n_gt <= 5 then '4-5' when n_gt <= 10 then '6-10' else '11+' end as bucket,
  round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, count(*) as samples from counts group by 1
""")
def det_gt_count_buckets(spark, sf_dir: str) -> DataFrame:
    c = matching.detection_counts(box_samples(spark, sf_dir), (0.5,))
    return c.groupBy(boxes.count_bucket(F.col("n_gt")).alias("bucket")).agg(
        F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"), F.count("*").alias("samples")
    )


_SIZE = "case when (x1 - x0) * (y1 - y0) < 1024 then 'small' when (x1 - x0) * (y1 - y0) < 9216 then 'medium' else 'large' end"
#: A sample and a size stand for a sample.
_SIZED = BOXES.replace("\ngt as (", "\ngt0 as (").replace("\npred as (", "\npred0 as (").replace("\ncross_ as (", f"""
gt as (
  select sample_id || '/' || size as sample_id, row_number() over (partition by sample_id, size order by gi) as gi, cat, x0, y0, x1, y1
  from (select *, {_SIZE} as size from gt0)),
pred as (select sample_id || '/' || {_SIZE} as sample_id, pi, cat, x0, y0, x1, y1 from pred0),
cross_ as (""")


@query(f"""
with recursive {_SIZED}, {greedy_sql("true", "0.5")},
every as (select l_orderkey || '/' || size as sample_id, size from (select distinct l_orderkey from lineitem), (select unnest(['small', 'medium', 'large']) as size)),
lone as (select distinct sample_id from pred)
select size, round(avg(coalesce(recall, empty)), 6) as recall, round(avg(coalesce(precision, empty)), 6) as precision, count(*) as samples from (
  select e.size, recall, precision, case when l.sample_id is null then 1.0 else 0.0 end as empty
  from every e left join counts c on c.sample_id = e.sample_id left join lone l on l.sample_id = e.sample_id) group by 1
""")
def det_size_prf1(spark, sf_dir: str) -> DataFrame:
    """Recall and precision by size of box: each size is matched on its own."""
    sizes = F.explode(F.array(*[F.lit(x) for x in ("small", "medium", "large")]))
    s = box_samples(spark, sf_dir).withColumn("size", sizes)
    of_size = lambda e: boxes.size_bucket(boxes.area(e["box"])) == F.col("size")
    s = s.select("sample_id", "size", *[F.filter(c, of_size).alias(c) for c in ("gt", "pred")])
    rows = matching.detection_counts(s, (0.5,), "referring", keep=("sample_id", "size"))
    return rows.groupBy("size").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"), F.count("*").alias("samples"))


@query(f"""
with {BOXES}, n as (select sample_id, count(*) as n from pred group by 1),
d as (
  select a.sample_id, count(*) as d from pred a join pred b on a.sample_id = b.sample_id and a.pi < b.pi
  where greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)
    > 0.9 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)
      - greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)) group by 1)
select sample_id, round(coalesce(d, 0) / n, 6) as duplicate_ratio from n left join d using (sample_id)
""")
def det_duplicate_ratio(spark, sf_dir: str) -> DataFrame:
    s = box_samples(spark, sf_dir).where(F.size("pred") > 0)
    return s.select("sample_id", F.round(matching.duplicate_ratio(F.col("pred")), 6).alias("duplicate_ratio"))


@query(f"with {BOXES} select g.sample_id, g.gi::int as gi, count(p.pi) as inside from gt g left join pred p on p.sample_id = g.sample_id and p.x0 between g.x0 and g.x1 and p.y0 between g.y0 and g.y1 group by all")
def point_in_box(spark, sf_dir: str) -> DataFrame:
    """How many predicted corners lie in each true box, pairs kept within the sample."""
    s = box_samples(spark, sf_dir)
    g = s.select("sample_id", "pred", F.posexplode("gt").alias("i", "g"))
    n = F.size(F.filter("pred", lambda p: boxes.point_in_box(p["box"], F.col("g.box"))))
    return g.select("sample_id", (F.col("i") + 1).alias("gi"), n.cast("long").alias("inside"))


def _keypoints(spark, sf_dir: str) -> DataFrame:
    """Corners of a box as its keypoints."""
    s = box_samples(spark, sf_dir)
    names = (("tl", 0, 1), ("br", 2, 3), ("bl", 0, 3))
    corners = lambda e: F.array(*[F.named_struct(F.lit("name"), F.lit(n), F.lit("x"), e["box"][i], F.lit("y"), e["box"][j]) for n, i, j in names])
    inst = lambda e: F.named_struct(F.lit("area"), boxes.area(e["box"]), F.lit("kpts"), matching.aligned(corners(e), [n for n, _, _ in names]))
    by_area = F.array_sort(F.transform("gt", lambda e, i: F.named_struct(F.lit("a"), -boxes.area(e["box"]), F.lit("i"), i, F.lit("e"), inst(e))))
    once = F.explode(F.array(F.lit(0))).alias("once")  # ends the projection, so that instances are aligned once
    return s.select("sample_id", F.transform(by_area, lambda x: x["e"]).alias("gt"), F.transform("pred", inst).alias("pred"), once)


@query(f"""
with recursive {BOXES}, ranked as (select *, row_number() over (partition by sample_id order by (x1 - x0) * (y1 - y0) desc, gi) as gj from gt),
cand as (
  select g.sample_id, g.gj, p.pi, (exp(-((g.x0 - p.x0) ** 2 + (g.y0 - p.y0) ** 2) / (0.00125 * (g.x1 - g.x0) * (g.y1 - g.y0)))
    + exp(-((g.x1 - p.x1) ** 2 + (g.y1 - p.y1) ** 2) / (0.00125 * (g.x1 - g.x0) * (g.y1 - g.y0)))
    + exp(-((g.x0 - p.x0) ** 2 + (g.y1 - p.y1) ** 2) / (0.00125 * (g.x1 - g.x0) * (g.y1 - g.y0)))) / 3 as oks
  from ranked g join pred p using (sample_id)),
sizes as (select sample_id, n_gt, coalesce(n_pred, 0) as n_pred from (select sample_id, count(*) as n_gt from gt group by 1) left join (select sample_id, count(*) as n_pred from pred group by 1) using (sample_id)),
thr as (select unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::double as thr),
walk as (
  select sample_id, thr, 0::bigint as gj, []::bigint[] as used from sizes, thr
  union all
  select w.sample_id, w.thr, w.gj + 1, case when b.pi is null then w.used else list_append(w.used, b.pi) end
  from walk w join sizes s on s.sample_id = w.sample_id and w.gj < s.n_gt
  left join lateral (select c.pi from cand c where c.sample_id = w.sample_id and c.gj = w.gj + 1 and c.oks >= w.thr and not list_contains(w.used, c.pi) order by round(c.oks, 9) desc, c.pi limit 1) b on true)
select thr as oks_threshold, round(avg(len(used) / n_gt), 6) as recall, round(avg(case when n_pred = 0 then 0.0 else len(used) / n_pred end), 6) as precision, count(*) as samples
from walk w join sizes s on s.sample_id = w.sample_id and w.gj = s.n_gt group by thr
""")
def oks_prf1(spark, sf_dir: str) -> DataFrame:
    """Instances by falling area, each to the best unused prediction."""
    s = _keypoints(spark, sf_dir)
    m = matching.score_matrix(F.col("gt"), F.col("pred"), lambda g, p: F.round(matching.oks_aligned(g["kpts"], p["kpts"], g["area"]), 9))
    grid = F.array(*[F.lit(t) for t in matching.THRESHOLDS])
    s = s.select(F.size("gt").alias("n_gt"), F.size("pred").alias("n_pred"), matching.candidates(m, matching.THRESHOLDS[0]).alias("m"))
    s = s.select("n_gt", "n_pred", "m", F.explode(grid).alias("t")).withColumn("n", matching.n_taken(F.col("m"), F.col("t")))
    p = F.when(F.col("n_pred") == 0, 0.0).otherwise(F.col("n") / F.col("n_pred"))
    return s.groupBy(F.col("t").alias("oks_threshold")).agg(
        F.round(F.avg(F.col("n") / F.col("n_gt")), 6).alias("recall"), F.round(F.avg(p), 6).alias("precision"), F.count("*").alias("samples")
    )


@query(f"""
with recursive {BOXES},
c as (select sample_id, pi as a, gi as b, iou, row_number() over (partition by sample_id order by iou desc, pi, gi) as j from pairs),
walk as (
  select sample_id, 0::bigint as j, []::bigint[] as a, []::bigint[] as b, 0.0::double as s from c group by 1
  union all
  select w.sample_id, c.j, case when free then list_append(w.a, c.a) else w.a end, case when free then list_append(w.b, c.b) else w.b end, case when free then s + iou else s end
  from walk w join c on c.sample_id = w.sample_id and c.j = w.j + 1, lateral (select not list_contains(w.a, c.a) and not list_contains(w.b, c.b) as free))
select p.sample_id, round(coalesce(s / len(a), 0), 6) as miou, coalesce(len(a), 0)::int as pairs from (select distinct sample_id from pred) p left join (
  select w.* from walk w where j = (select max(j) from c where c.sample_id = w.sample_id)) w on w.sample_id = p.sample_id
""")
def greedy_mask_miou(spark, sf_dir: str) -> DataFrame:
    """Largest overlaps first, rows and columns removed, as long as one is above 0; mean of the overlaps taken."""
    s = box_samples(spark, sf_dir).where(F.size("pred") > 0)
    m = matching.score_matrix(F.col("pred"), F.col("gt"), lambda p, g: boxes.iou(g["box"], p["box"]))
    taken = F.filter(matching.best_pairs(m), lambda v: v > 0)
    s = s.select("sample_id", taken.alias("t"), F.explode(F.array(F.lit(0))).alias("once"))  # ends the projection
    mean = F.when(F.size("t") > 0, F.aggregate("t", F.lit(0.0), lambda a, v: a + v) / F.size("t")).otherwise(0.0)
    return s.select("sample_id", F.round(mean, 6).alias("miou"), F.size("t").alias("pairs"))
