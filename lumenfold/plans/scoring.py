"""Curves, segmentation, depth, normals, poses and point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as geo
from ..operators import clouds, curves, dense, router, segments
from .common import BOXES, box_rows, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- precision-recall curves


def _truths(spark, sf_dir: str) -> DataFrame:
    from ..functions import boxes

    r = box_rows(spark, sf_dir)
    pos = F.struct("pos", "x", "y", "w", "h")
    return r.select(F.col("sample_id").alias("image"), "cat", pos.alias("pos"), boxes.xyxy(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"), F.lit(False).alias("crowd"), F.lit(False).alias("ignore"))


def _detections(spark, sf_dir: str) -> DataFrame:
    from ..functions import boxes

    r = box_rows(spark, sf_dir).where("has_pred")
    pos = F.struct("pos", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "w", "h")
    return r.select(
        F.col("sample_id").alias("image"), "cat", pos.alias("pos"),
        boxes.xyxy(F.col("x") + F.col("dx"), F.col("y") + F.col("dy"), F.col("w"), F.col("h")).alias("box"), "score", F.lit(False).alias("skip"),
    )


_AP = f"""
with recursive {BOXES},
det as (select *, row_number() over (partition by sample_id, cat order by score desc, pos, pi) as di from pred),
dn as (select sample_id, cat, count(*) as n from det group by all),
tgt as (select *, row_number() over (partition by sample_id, cat order by gi) as ci from gt),
ov as (
  select d.sample_id, d.cat, d.di, t.ci, greatest(least(t.x1, d.x1) - greatest(t.x0, d.x0), 0) * greatest(least(t.y1, d.y1) - greatest(t.y0, d.y0), 0) as inter,
    (t.x1 - t.x0) * (t.y1 - t.y0) as ga, (d.x1 - d.x0) * (d.y1 - d.y0) as da
  from det d join tgt t on t.sample_id = d.sample_id and t.cat = d.cat),
cand as (select sample_id, cat, di, ci, inter / (ga + da - inter) as iou from ov where inter > 0),
thr as (select unnest([0.5, 0.75])::double as thr),
walk as (
  select sample_id, cat, thr, 0::bigint as di, []::bigint[] as used, -1::bigint as got from dn, thr
  union all
  select w.sample_id, w.cat, w.thr, w.di + 1, case when b.ci is null then w.used else list_append(w.used, b.ci) end, coalesce(b.ci, -1)
  from walk w join dn on dn.sample_id = w.sample_id and dn.cat = w.cat and w.di < dn.n
  left join lateral (
    select c.ci from cand c where c.sample_id = w.sample_id and c.cat = w.cat and c.di = w.di + 1 and c.iou >= w.thr and not list_contains(w.used, c.ci)
    order by c.iou desc, c.ci desc limit 1) b on true),
npos as (select cat, count(*) as npos from gt group by 1),
m as (select w.cat, w.thr as iou, d.score, w.sample_id, w.di, (got >= 0)::int as tp from walk w join det d on d.sample_id = w.sample_id and d.cat = w.cat and d.di = w.di),
c as (
  select *, sum(tp) over (partition by cat, iou order by score desc, sample_id, di rows unbounded preceding) as ctp,
    count(*) over (partition by cat, iou order by score desc, sample_id, di rows unbounded preceding) as cn from m),
e as (
  select c.*, npos, max(ctp / cn) over (partition by c.cat, iou order by score desc, sample_id, di rows between current row and unbounded following) as env
  from c join npos using (cat)),
s as (select cat, iou, sum(env * (ceil(ctp * 100 / npos) - ceil((ctp - tp) * 100 / npos))) / 101 as ap, max(ctp) / max(npos) as recall from e group by all)
"""


def _ap(spark, sf_dir: str, thresholds=(0.5, 0.75), areas=("all",)) -> DataFrame:
    t = _truths(spark, sf_dir)
    m = curves.match_codes(t, _detections(spark, sf_dir), thresholds, areas)
    return curves.average_precisions(m, curves.positives(t, areas), thresholds, areas)


@query(_AP + "select n.cat, t.thr as iou, round(coalesce(ap, 0), 6) as ap, round(coalesce(recall, 0), 6) as recall from npos n cross join thr t left join s on s.cat = n.cat and s.iou = t.thr")
def ap101_per_category(spark, sf_dir: str) -> DataFrame:
    return _ap(spark, sf_dir).select("cat", "iou", F.round("ap", 6).alias("ap"), F.round("recall", 6).alias("recall"))


_AP12 = f"""
with recursive {BOXES},
det as (select *, (x1 - x0) * (y1 - y0) as da, row_number() over (partition by sample_id, cat order by score desc, pos, pi) as di from pred),
dn as (select sample_id, cat, count(*) as n from det group by all),
tgt as (select *, (x1 - x0) * (y1 - y0) as ga, row_number() over (partition by sample_id, cat order by gi) as ci from gt),
ov as (
  select d.sample_id, d.cat, d.di, t.ci, ga, da, greatest(least(t.x1, d.x1) - greatest(t.x0, d.x0), 0) * greatest(least(t.y1, d.y1) - greatest(t.y0, d.y0), 0) as inter
  from det d join tgt t on t.sample_id = d.sample_id and t.cat = d.cat),
cand as (select sample_id, cat, di, ci, ga, inter / (ga + da - inter) as iou from ov where inter > 0),
thr as (select unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::double as thr),
areas as (select * from (values ('all', 0, 1e10), ('small', 0, 1024), ('medium', 1024, 9216), ('large', 9216, 1e10)) t(area, lo, hi)),
walk as (
  select sample_id, cat, thr, area, lo, hi, 0::bigint as di, []::bigint[] as used, -1::bigint as got, false as counted from dn, thr, areas
  union all
  select w.sample_id, w.cat, w.thr, area, lo, hi, w.di + 1, case when b.ci is null then w.used else list_append(w.used, b.ci) end, coalesce(b.ci, -1), coalesce(b.counted, false)
  from walk w join dn on dn.sample_id = w.sample_id and dn.cat = w.cat and w.di < dn.n
  left join lateral (
    select c.ci, c.ga between w.lo and w.hi as counted from cand c
    where c.sample_id = w.sample_id and c.cat = w.cat and c.di = w.di + 1 and c.iou >= w.thr and not list_contains(w.used, c.ci)
    order by (c.ga between w.lo and w.hi) desc, c.iou desc, c.ci desc limit 1) b on true),
npos as (select cat, area, count(*) as npos from tgt, areas where ga between lo and hi group by all),
m as (
  select w.cat, w.area, w.thr as iou, d.score, w.sample_id, w.di, (got >= 0)::int as tp from walk w join det d on d.sample_id = w.sample_id and d.cat = w.cat and d.di = w.di
  where case when got >= 0 then counted else da between lo and hi end),
c as (
  select *, sum(tp) over (partition by cat, area, iou order by score desc, sample_id, di rows unbounded preceding) as ctp,
    count(*) over (partition by cat, area, iou order by score desc, sample_id, di rows unbounded preceding) as cn from m),
e as (
  select c.*, npos, max(ctp / cn) over (partition by c.cat, c.area, iou order by score desc, sample_id, di rows between current row and unbounded following) as env
  from c join npos using (cat, area)),
s as (select cat, area, iou, sum(env * (ceil(ctp * 100 / npos) - ceil((ctp - tp) * 100 / npos))) / 101 as ap, max(ctp) / max(npos) as recall from e group by all),
ap as (select n.cat, n.area, thr as iou, npos, coalesce(ap, 0) as ap, coalesce(recall, 0) as recall from npos n cross join thr left join s on s.cat = n.cat and s.area = n.area and s.iou = thr)
"""


@query(_AP12 + """,
p as (select area, coalesce(avg(ap) filter (where ap > 0), 0) as ap, coalesce(avg(ap) filter (where ap > 0 and iou = 0.5), 0) as ap50, coalesce(avg(ap) filter (where ap > 0 and iou = 0.75), 0) as ap75, coalesce(avg(recall) filter (where recall > 0), 0) as ar from ap group by area)
select area, round(ap, 6) as ap, round(ap50, 6) as ap50, round(ap75, 6) as ap75, round(ar, 6) as ar, case when ap + ar > 0 then round(2 * ap * ar / (ap + ar), 6) else 0.0 end as f1 from p
""")
def ap_summary12(spark, sf_dir: str) -> DataFrame:
    """Mean precision and recall by area, at 0.5 and 0.75, and the F1 of the positive means."""
    ap = _ap(spark, sf_dir, curves.THRESHOLDS, tuple(curves.AREAS))
    at = lambda t: curves.positive_mean(F.when(F.col("iou") == t, F.col("ap")))
    p, r = curves.positive_mean(F.col("ap")), curves.positive_mean(F.col("recall"))
    out = ap.groupBy("area").agg(p.alias("ap"), at(0.5).alias("ap50"), at(0.75).alias("ap75"), r.alias("ar"))
    f = F.when(F.col("ap") + F.col("ar") > 0, 2 * F.col("ap") * F.col("ar") / (F.col("ap") + F.col("ar"))).otherwise(0.0)
    return out.select("area", *[F.round(c, 6).alias(c) for c in ("ap", "ap50", "ap75", "ar")], F.round(f, 6).alias("f1"))


@query(_AP12 + """,
k as (select cat, iou, sum(tp) filter (where di <= 1) as n1, sum(tp) filter (where di <= 2) as n2, sum(tp) filter (where di <= 100) as n100 from m where area = 'all' group by all),
r as (select avg(coalesce(n1 / npos, 0)) as ar1, avg(coalesce(n2 / npos, 0)) as ar2, avg(coalesce(n100 / npos, 0)) as ar100 from ap left join k using (cat, iou) where area = 'all'),
a as (
  select avg(ap) filter (where area = 'all') as ap, avg(ap) filter (where area = 'all' and iou = 0.5) as ap50, avg(ap) filter (where area = 'all' and iou = 0.75) as ap75,
    avg(ap) filter (where area = 'small') as ap_small, avg(ap) filter (where area = 'medium') as ap_medium, avg(ap) filter (where area = 'large') as ap_large,
    avg(recall) filter (where area = 'small') as ar_small, avg(recall) filter (where area = 'medium') as ar_medium, avg(recall) filter (where area = 'large') as ar_large from ap)
select round(columns(*), 6) from a, r
""")
def ap_summary_by_rank(spark, sf_dir: str) -> DataFrame:
    """The twelve summary figures, recall by the first, the first two and the first hundred detections (an image has few)."""
    t = _truths(spark, sf_dir)
    areas = tuple(curves.AREAS)
    out = curves.summary(curves.match_codes(t, _detections(spark, sf_dir), areas=areas), curves.positives(t, areas), (1, 2, 100))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(_AP12.replace("l_returnflag as cat,", "l_returnflag as flag, '' as cat,").replace("from rows_ where cat <> 'R'", "from rows_ where flag <> 'R'") + """,
k as (select cat, iou, sum(tp) filter (where di <= 1) as n1, sum(tp) filter (where di <= 10) as n10, sum(tp) filter (where di <= 100) as n100 from m where area = 'all' group by all),
r as (select avg(coalesce(n1 / npos, 0)) as ar1, avg(coalesce(n10 / npos, 0)) as ar10, avg(coalesce(n100 / npos, 0)) as ar100 from ap left join k using (cat, iou) where area = 'all'),
a as (
  select avg(ap) filter (where area = 'all') as ap, avg(ap) filter (where area = 'all' and iou = 0.5) as ap50, avg(ap) filter (where area = 'all' and iou = 0.75) as ap75,
    avg(ap) filter (where area = 'small') as ap_small, avg(ap) filter (where area = 'medium') as ap_medium, avg(ap) filter (where area = 'large') as ap_large,
    avg(recall) filter (where area = 'small') as ar_small, avg(recall) filter (where area = 'medium') as ar_medium, avg(recall) filter (where area = 'large') as ar_large from ap)
select round(columns(*), 6) from a, r
""")
def evaluate_agnostic(spark, sf_dir: str) -> DataFrame:
    """The twelve figures without categories, by the one entry point."""
    out = router.evaluate(_truths(spark, sf_dir), _detections(spark, sf_dir), agnostic=True)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(_AP.replace("from rows_ where cat <> 'R'", "from rows_ where cat <> 'R' and (sample_id % 3 <> 0 or cat = 'A')") + "select n.cat, t.thr as iou, round(coalesce(ap, 0), 6) as ap from npos n cross join thr t left join s on s.cat = n.cat and s.iou = t.thr")
def lvis_federated_ap(spark, sf_dir: str) -> DataFrame:
    """Images divisible by three are labelled for category A alone: other detections there don't count. All detections of an image are matched."""
    t, d = _truths(spark, sf_dir), _detections(spark, sf_dir)
    seen = t.where("image % 3 <> 0 or cat = 'A'")
    every = d.select("image").distinct().select("image", F.explode(F.array(F.lit("A"), F.lit("N"))).alias("cat"))
    negative = every.where("image % 3 <> 0 or cat = 'A'")
    kept = curves.federated(d, seen, negative, d.limit(0).select("image", "cat"))
    m = curves.match_codes(t, kept, (0.5, 0.75), top=None)
    return curves.average_precisions(m, curves.positives(t), (0.5, 0.75)).select("cat", "iou", F.round("ap", 6).alias("ap"))


# ---- segmentation; events stand for pixels

_CELLS = """
cells as (
  select event_id // 400 as image, (user_id % 6)::int as gt, ((user_id + case when event_id % 4 = 0 then 1 else 0 end) % 6)::int as pred, count(*) as n
  from events group by all)
"""


def _cells(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    shift = F.when(F.col("event_id") % 4 == 0, 1).otherwise(0)
    return e.groupBy(
        F.floor(F.col("event_id") / 400).alias("image"), (F.col("user_id") % 6).cast("int").alias("gt"), ((F.col("user_id") + shift) % 6).cast("int").alias("pred")
    ).agg(F.count("*").alias("n"))


def _segments(cells: DataFrame, c: str) -> DataFrame:
    crowd = (F.col("id") == 5) if c == "gt" else F.lit(False)
    return cells.select("image", F.col(c).alias("id")).where("id <> 0").distinct().withColumn("cat", F.col("id") % 3).withColumn("crowd", crowd)


@query(f"""
with {_CELLS},
pa as (select image, pred, sum(n) as pa, sum(n) filter (where gt = 0) as nv from cells group by all),
ga as (select image, gt, sum(n) as ga from cells group by all),
x as (select c.*, pa, ga, coalesce(nv, 0) as nv, gt % 3 as gcat, pred % 3 as pcat from cells c join pa using (image, pred) join ga using (image, gt) where gt <> 0 and pred <> 0),
hit as (select image, gt, pred, gcat as cat, n / (pa + ga - n - nv) as iou from x where gt <> 5 and gcat = pcat and n / (pa + ga - n - nv) > 0.5),
fn as (select gt % 3 as cat from ga where gt not in (0, 5) and not exists (select 1 from hit h where h.image = ga.image and h.gt = ga.gt)),
fp as (
  select p.pred % 3 as cat from pa p left join x c on c.image = p.image and c.pred = p.pred and c.gt = 5 and c.pcat = 2
  where p.pred <> 0 and not exists (select 1 from hit h where h.image = p.image and h.pred = p.pred) and (coalesce(p.nv, 0) + coalesce(c.n, 0)) / p.pa <= 0.5),
k as (select cat, sum(iou) as iou, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from (
  select cat, iou, 1 as tp, 0 as fp, 0 as fn from hit union all select cat, 0, 0, 1, 0 from fp union all select cat, 0, 0, 0, 1 from fn) group by cat),
q as (select *, case when cat > 0 then 'things' else 'stuff' end as part, iou / (tp + fp / 2 + fn / 2) as pq from k)
select coalesce(part, 'all') as part, round(avg(pq), 6) as pq, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from q group by grouping sets ((part), ())
""")
def pq_all_things_stuff(spark, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    q = segments.panoptic_quality(segments.panoptic_counts(cells, _segments(cells, "gt"), _segments(cells, "pred")))
    q = q.withColumn("part", F.when(F.col("cat") > 0, "things").otherwise("stuff"))
    out = q.rollup("part").agg(F.round(F.avg("pq"), 6).alias("pq"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return out.withColumn("part", F.coalesce("part", F.lit("all")))


@query(f"""
with {_CELLS}, m as (select gt, pred, sum(n) as n from cells group by all),
g as (select gt as cls, sum(n) as g from m group by 1), p as (select pred as cls, sum(n) as p from m group by 1)
select g.cls, round(t.n / (g + p - t.n), 6) as iou, round(t.n / g, 6) as acc from g join p using (cls) left join m t on t.gt = g.cls and t.pred = g.cls
""")
def confusion_iou(spark, sf_dir: str) -> DataFrame:
    s = segments.class_scores(segments.confusion(_cells(spark, sf_dir)))
    return s.select("cls", F.round("iou", 6).alias("iou"), F.round("acc", 6).alias("acc"))


@query(f"with {_CELLS} select gt, pred, sum(n)::bigint as n from cells group by all")
def confusion_matrix(spark, sf_dir: str) -> DataFrame:
    return segments.confusion(_cells(spark, sf_dir))


@query("select quality as gt, toxic as pred, count(*) as n from labels group by all")
def label_confusion(spark, sf_dir: str) -> DataFrame:
    return segments.confusion(table(spark, sf_dir, "labels").select(F.col("quality").alias("gt"), F.col("toxic").alias("pred"), F.lit(1).alias("n")))


@query("""
with s as (
  select event_id // 400 as image, sum((user_id % 5 = 0 and user_id % 3 = 0)::int) as inter, sum((user_id % 5 = 0 or user_id % 3 = 0)::int) as uni,
    sum((user_id % 5 <> 0 and user_id % 3 <> 0)::int) as bg, count(*) as px from events group by 1)
select round(avg(case when uni > 0 then inter / uni end), 6) as giou, round(sum(inter) / sum(uni), 6) as ciou, round(sum(inter + bg) / sum(px), 6) as pacc from s
""")
def binary_giou_ciou_pacc(spark, sf_dir: str) -> DataFrame:
    a, b = F.col("user_id") % 5 == 0, F.col("user_id") % 3 == 0
    n = lambda c: F.sum(c.cast("int"))
    m = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 400).alias("image")).agg(n(a & b).alias("inter"), n(a | b).alias("uni"), n(~a & ~b).alias("bg"), F.count("*").alias("px"))
    return segments.binary_scores(m).select(*[F.round(c, 6).alias(c) for c in ("giou", "ciou", "pacc")])


@query("""
with d as (select distinct event_id // 400 as image, (user_id % 40)::int as x, (user_id // 40 % 40)::int as y from events)
select distinct d.image, d.x, d.y from d, (values (1, 0), (-1, 0), (0, 1), (0, -1)) s(a, b)
where not exists (select 1 from d e where e.image = d.image and e.x = d.x + s.a and e.y = d.y + s.b)
""")
def mask_boundary(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = e.select(F.floor(F.col("event_id") / 400).alias("image"), (F.col("user_id") % 40).cast("int").alias("x"), (F.floor(F.col("user_id") / 40) % 40).cast("int").alias("y")).distinct()
    return segments.contour(d)


# ---- depth and normals

_DEPTH = """
px as (
  select l_suppkey as sample, l_extendedprice::double / 10000 as gt, l_extendedprice::double / 10000 * (0.8 + l_linenumber * 0.05) + l_discount::double as pred,
    l_quantity::double > 5 as valid from lineitem)
"""
_DEPTH_SCORES = """
e as (
  select sample, avg(abs(pred - gt) / gt) as abs_rel, avg((pred - gt) ** 2 / gt) as sq_rel, sqrt(avg((pred - gt) ** 2)) as rmse, sqrt(avg((ln(pred) - ln(gt)) ** 2)) as rmse_log,
    avg(abs(log10(pred) - log10(gt))) as log10, sqrt(avg((1 / pred - 1 / gt) ** 2)) as i_rmse, avg((greatest(pred / gt, gt / pred) < 1.25)::int) as delta1,
    avg((greatest(pred / gt, gt / pred) < 1.5625)::int) as delta2, avg((greatest(pred / gt, gt / pred) < 1.953125)::int) as delta3,
    100 * sqrt(greatest(avg((ln(pred) - ln(gt)) ** 2) - avg(ln(pred) - ln(gt)) ** 2, 0)) as silog
  from {} where valid and gt > 0 and pred > 0 group by sample)
"""
_DEPTH_NAMES = ("abs_rel", "sq_rel", "rmse", "rmse_log", "log10", "i_rmse", "delta1", "delta2", "delta3", "silog")
_DEPTH_OUT = "select " + ", ".join(f"round(avg({c}), 6) as {c}" for c in _DEPTH_NAMES) + ", count(*) as samples from e"


def _depth(spark, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    gt = F.col("l_extendedprice").cast("double") / 10000
    return l.select(F.col("l_suppkey").alias("sample"), gt.alias("gt"), (gt * (0.8 + F.col("l_linenumber") * F.lit(0.05)) + F.col("l_discount").cast("double")).alias("pred"), (F.col("l_quantity").cast("double") > 5).alias("valid"))


@query(f"with {_DEPTH}, {_DEPTH_SCORES.format('px')} {_DEPTH_OUT}")
def depth_metrics(spark, sf_dir: str) -> DataFrame:
    return dense.means(dense.depth_errors(_depth(spark, sf_dir)), _DEPTH_NAMES)


@query(f"""
with {_DEPTH}, f as (select sample, regr_slope(gt, pred) as k, regr_intercept(gt, pred) as c from px where valid group by sample),
al as (select px.sample, gt, valid, least(greatest(coalesce(pred * k + c, pred), 0.001), 1000) as pred from px left join f using (sample)), {_DEPTH_SCORES.format("al")} {_DEPTH_OUT}
""")
def depth_lsq_align(spark, sf_dir: str) -> DataFrame:
    return dense.means(dense.depth_errors(dense.align_depth(_depth(spark, sf_dir))), _DEPTH_NAMES)


@query(f"""
with {_DEPTH}, inv as (select sample, gt, 1 / pred as pred, valid from px),
f as (select sample, regr_slope(1 / gt, pred) as k, regr_intercept(1 / gt, pred) as c from inv where valid group by sample),
al as (select inv.sample, gt, valid, least(greatest(case when coalesce(pred * k + c, pred) > 0 then 1 / coalesce(pred * k + c, pred) else 1000 end, 0.001), 1000) as pred
  from inv left join f using (sample)), {_DEPTH_SCORES.format("al")} {_DEPTH_OUT}
""")
def disparity_align(spark, sf_dir: str) -> DataFrame:
    p = _depth(spark, sf_dir).withColumn("pred", 1 / F.col("pred"))
    return dense.means(dense.depth_errors(dense.align_depth(p, disparity=True)), _DEPTH_NAMES)


_ERR = """
err as (
  select label as sample, degrees(acos(greatest(least(coalesce((a1 * b1 + a2 * b2 + a3 * b3) / nullif(sqrt(a1 * a1 + a2 * a2 + a3 * a3) * sqrt(b1 * b1 + b2 * b2 + b3 * b3), 0), 0), 1), -1))) as err
  from (select label, embedding[1]::double as a1, embedding[2]::double as a2, embedding[3]::double as a3, embedding[4]::double as b1, embedding[5]::double as b2, embedding[6]::double as b3 from embeddings))
"""


def _angles(spark, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("sample"), dense.angle([v[i] for i in range(3)], [v[i] for i in range(3, 6)]).alias("err"))


@query(f"""
with {_ERR} select sample, round(avg(err), 4) as mean, round(median(err), 4) as median, round(sqrt(avg(err * err)), 4) as rmse,
  {", ".join(f"round(avg((err < {a})::int) * 100, 4) as sub{n}" for a, n in ((5, "5"), (7.5, "7_5"), (11.25, "11_25"), (22.5, "22_5"), (30, "30")))} from err group by sample
""")
def normal_angular_error(spark, sf_dir: str) -> DataFrame:
    return dense.normal_errors(_angles(spark, sf_dir))


# ---- poses: a sequence for each order, a frame for each line item


def _poses(spark, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    q = F.array(F.lit(8.0), F.col("l_partkey") % 7, F.col("l_suppkey") % 5, F.col("l_linenumber")).cast("array<double>")
    p = F.array(F.lit(8.0), F.col("l_partkey") % 7 + F.lit(0.5), F.col("l_suppkey") % 5, F.col("l_linenumber")).cast("array<double>")
    t = F.array(F.col("l_partkey") % 13, F.col("l_suppkey") % 11, F.col("l_linenumber")).cast("array<double>")
    s = F.array(F.col("l_partkey") % 13, F.col("l_suppkey") % 11, F.col("l_linenumber") + F.lit(0.5)).cast("array<double>")
    frame = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return l.select(F.col("l_orderkey").alias("seq"), frame.alias("frame"), geo.unit(q).alias("q"), t.alias("t"), geo.unit(p).alias("pq"), s.alias("pt"))


def pair_errors(poses: DataFrame) -> DataFrame:
    """(seq, i, j, r_err, t_err) of all pairs i < j of a sequence: relative predicted pose against relative
    true pose. Pairs grow with the square of a sequence's frames, which the benchmarks fix at ten."""
    a = poses.select("seq", F.col("frame").alias("i"), *[F.col(c).alias(f"a{c}") for c in ("q", "t", "pq", "pt")])
    b = poses.select("seq", F.col("frame").alias("j"), *[F.col(c).alias(f"b{c}") for c in ("q", "t", "pq", "pt")])
    r = a.join(b, "seq").where("i < j")
    turn = lambda x, y: geo.product(F.col(y), geo.conjugate(F.col(x)))
    shift = lambda m, x, y: geo.sub(F.col(y), geo.rotate(geo.matrix(m), F.col(x)))
    r = r.withColumn("rq", turn("aq", "bq")).withColumn("rp", turn("apq", "bpq"))
    r = r.withColumn("rt", shift(F.col("rq"), "at", "bt")).withColumn("rs", shift(F.col("rp"), "apt", "bpt"))
    return r.select("seq", "i", "j", geo.rotation_error(F.col("rp"), F.col("rq")).alias("r_err"), geo.translation_error(F.col("rs"), F.col("rt")).alias("t_err"))


def pose_scores(errors: DataFrame, limits=(5, 15, 30)) -> DataFrame:
    """Shares of pairs with rotation, translation error below each limit, and the area under the
    accuracy curve of the larger error: a pair of error e below the limit T adds (T - floor(e)) / T."""
    e = F.floor(F.greatest("r_err", "t_err"))
    out = []
    for t in limits:
        auc = F.when(F.greatest("r_err", "t_err") <= t, (t - F.least(e, F.lit(t - 1))) / t).otherwise(0.0)
        share = lambda c, t=t: F.avg((F.col(c) < t).cast("double")) * 100
        out += [F.round(share("r_err"), 4).alias(f"racc_{t}"), F.round(share("t_err"), 4).alias(f"tacc_{t}"), F.round(F.avg(auc) * 100, 4).alias(f"auc_{t}")]
    return errors.agg(*out, F.count("*").alias("pairs"))


_PRODUCT = (
    "{b}[1] * {a}[1] + {b}[2] * {a}[2] + {b}[3] * {a}[3] + {b}[4] * {a}[4]", "-{b}[1] * {a}[2] + {b}[2] * {a}[1] - {b}[3] * {a}[4] + {b}[4] * {a}[3]",
    "-{b}[1] * {a}[3] + {b}[2] * {a}[4] + {b}[3] * {a}[1] - {b}[4] * {a}[2]", "-{b}[1] * {a}[4] - {b}[2] * {a}[3] + {b}[3] * {a}[2] + {b}[4] * {a}[1]",
)  # of b with a's conjugate
_TURNED = (
    "(1 - 2 * ({q}[3] ** 2 + {q}[4] ** 2)) * {v}[1] + 2 * ({q}[2] * {q}[3] - {q}[1] * {q}[4]) * {v}[2] + 2 * ({q}[2] * {q}[4] + {q}[1] * {q}[3]) * {v}[3]",
    "2 * ({q}[2] * {q}[3] + {q}[1] * {q}[4]) * {v}[1] + (1 - 2 * ({q}[2] ** 2 + {q}[4] ** 2)) * {v}[2] + 2 * ({q}[3] * {q}[4] - {q}[1] * {q}[2]) * {v}[3]",
    "2 * ({q}[2] * {q}[4] - {q}[1] * {q}[3]) * {v}[1] + 2 * ({q}[3] * {q}[4] + {q}[1] * {q}[2]) * {v}[2] + (1 - 2 * ({q}[2] ** 2 + {q}[3] ** 2)) * {v}[3]",
)


def _list(parts, **names: str) -> str:
    return "[" + ", ".join(p.format(**names) for p in parts) + "]"


def _gap(q: str, b: str, a: str) -> str:
    """b less a turned by q."""
    return "[" + ", ".join(f"{b}[{i + 1}] - ({t.format(q=q, v=a)})" for i, t in enumerate(_TURNED)) + "]"


_POSES = """
raw as (
  select l_orderkey as seq, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as frame, [8.0, l_partkey % 7, l_suppkey % 5, l_linenumber]::double[] as q,
    [8.0, l_partkey % 7 + 0.5, l_suppkey % 5, l_linenumber]::double[] as pq, [l_partkey % 13, l_suppkey % 11, l_linenumber]::double[] as t, [l_partkey % 13, l_suppkey % 11, l_linenumber + 0.5]::double[] as pt from lineitem),
poses as (
  select seq, frame, list_transform(q, lambda v: v / sqrt(list_dot_product(q, q))) as q, list_transform(pq, lambda v: v / sqrt(list_dot_product(pq, pq))) as pq, t, pt from raw)
"""
_ERRORS = f"""
{_POSES},
met as (
  select a.seq, a.frame as i, b.frame as j, {_list(_PRODUCT, a="a.q", b="b.q")} as rq, {_list(_PRODUCT, a="a.pq", b="b.pq")} as rp, a.t as ta, b.t as tb, a.pt as apt, b.pt as bpt from poses a join poses b on a.seq = b.seq and a.frame < b.frame),
shifts as (select *, {_gap("rq", "tb", "ta")} as rt, {_gap("rp", "bpt", "apt")} as rs from met),
losses as (
  select *, greatest(1 - list_dot_product(rp, rq) ** 2, 1e-15) as rl, list_dot_product(rs, rt) / nullif(sqrt(list_dot_product(rs, rs)) * sqrt(list_dot_product(rt, rt)), 0) as c from shifts),
errors as (
  select seq, i, j, degrees(acos(greatest(1 - 2 * rl, -1))) as r_err, coalesce(degrees(acos(sqrt(greatest(1 - greatest(1 - c * c, 1e-15), 0)))), 1e6) as t_err from losses)
"""


@query(f"with {_ERRORS} select " + ", ".join(
    f"round(avg((r_err < {t})::int) * 100, 4) as racc_{t}, round(avg((t_err < {t})::int) * 100, 4) as tacc_{t}, "
    f"round(avg(case when greatest(r_err, t_err) <= {t} then ({t} - least(floor(greatest(r_err, t_err)), {t} - 1)) / {t} else 0 end) * 100, 4) as auc_{t}" for t in (5, 15, 30)
) + ", count(*) as pairs from errors")
def pose_pairs_auc(spark, sf_dir: str) -> DataFrame:
    return pose_scores(pair_errors(_poses(spark, sf_dir)))


@query(f"""
with {_POSES}, r as (select a.seq, a.frame, {_list(_PRODUCT, a="b.q", b="a.q")} as rq, a.t as t, b.t as t0 from poses a join poses b on b.seq = a.seq and b.frame = 1), s as (select *, {_gap("rq", "t", "t0")} as d from r)
select seq, frame, {", ".join(f"round(d[{i + 1}], 6) + 0.0 as {n}" for i, n in enumerate(("dx", "dy", "dz")))}, {", ".join(f"round(case when rq[1] < 0 then -rq[{i + 1}] else rq[{i + 1}] end, 6) + 0.0 as q{n}" for i, n in enumerate("wxyz"))} from s
""")
def relative_to_first(spark, sf_dir: str) -> DataFrame:
    """Each frame's pose after undoing that of the first frame of its sequence."""
    p = _poses(spark, sf_dir)
    w = Window.partitionBy("seq").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.select("seq", "frame", geo.matrix(F.first("q").over(w)).alias("m0"), F.first("t").over(w).alias("t0"), geo.matrix(F.col("q")).alias("m"), "t")
    m, t = geo.relative_pose(F.col("m0"), F.col("t0"), F.col("m"), F.col("t"))
    p = p.select("seq", "frame", t.alias("d"), geo.quaternion(m).alias("q"))
    show = lambda c, names: [(F.round(F.col(c)[i], 6) + 0.0).alias(n) for i, n in enumerate(names)]
    return p.select("seq", "frame", *show("d", ("dx", "dy", "dz")), *show("q", ("qw", "qx", "qy", "qz")))


# ---- point clouds


def _cloud(spark, sf_dir: str, half: int) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").where(F.col("label") % 2 == half).select(F.floor(F.col("label") / 2).cast("int").alias("seq"), v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def _whole(spark, sf_dir: str) -> DataFrame:
    """All embeddings, a cloud for each label."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("seq"), v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


_CLOUD = """
pts as (select (label // 2)::int as seq, label % 2 as half, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings),
nn as (
  select a.seq, a.half, a.x, a.y, a.z, sqrt(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) as d
  from (select *, row_number() over () as id from pts) a join pts b on a.seq = b.seq and a.half <> b.half group by a.id, a.seq, a.half, a.x, a.y, a.z)
"""


@query(f"""
with {_CLOUD}, s as (
  select seq, avg(d) filter (where half = 0) as acc, median(d) filter (where half = 0) as accm, avg(d) filter (where half = 1) as comp, median(d) filter (where half = 1) as compm,
    avg((d < 0.05)::int) filter (where half = 0) as p, avg((d < 0.05)::int) filter (where half = 1) as r from nn group by seq)
select seq, round(acc, 6) as accuracy, round(accm, 6) as accuracy_median, round(comp, 6) as completion, round(compm, 6) as completion_median, round(p, 6) as "precision", round(r, 6) as recall,
  round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as fscore from s
""")
def nn_accuracy_completion(spark, sf_dir: str) -> DataFrame:
    s = clouds.accuracy_completion(_cloud(spark, sf_dir, 0), _cloud(spark, sf_dir, 1), 0.2, 0.05)
    return s.select("seq", *[F.round(c, 6).alias(c) for c in s.columns if c != "seq"])


@query(f"""
with {_CLOUD}, v as (select distinct seq, half, floor(x / 0.1) as a, floor(y / 0.1) as b, floor(z / 0.1) as c from pts), n as (select seq, a, b, c, count(*) as k from v group by all)
select seq, round(sum((k = 2)::int) / count(*), 6) as iou from n group by seq
""")
def voxel_iou(spark, sf_dir: str) -> DataFrame:
    return clouds.voxel_iou(_cloud(spark, sf_dir, 0), _cloud(spark, sf_dir, 1), 0.1).select("seq", F.round("iou", 6).alias("iou"))


def _paired(spark, sf_dir: str) -> DataFrame:
    """A cloud and the same one turned by 90 degrees about z, scaled by two and shifted."""
    c = _whole(spark, sf_dir)
    return c.select("*", (-2 * F.col("y") + 1).alias("nx"), (2 * F.col("x") - 1).alias("ny"), (2 * F.col("z") + 0.5).alias("nz"))


@query()
def umeyama_align(spark, sf_dir: str) -> DataFrame:
    m = clouds.umeyama(_paired(spark, sf_dir))
    show = lambda c: F.transform(c, lambda v: F.round(v, 6) + 0.0)
    return m.select("seq", F.round("scale", 6).alias("scale"), show("rotation").alias("rotation"), show("shift").alias("shift"))


@query()
def icp_refinement(spark, sf_dir: str) -> DataFrame:
    """A cloud shifted by a little finds back; mean distance left."""
    gt = _whole(spark, sf_dir)
    near = gt.select("seq", (F.col("x") + 0.01).alias("x"), (F.col("y") - 0.005).alias("y"), F.col("z").alias("z"))
    back = clouds.icp(near, gt, 0.2, rounds=2)
    return clouds.nearest(back, gt, 0.2).groupBy("seq").agg(F.round(F.avg("distance"), 6).alias("left"), F.count("*").alias("points"))
