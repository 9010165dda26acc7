"""Mixed tables of all tasks, scored in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..operators import router
from .common import BOXES, box_samples, greedy_sql, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TASKS = ("common_object_detection", "referring_object_detection", "pointing", "pointing_referring", "keypoint", "hallucination", "gui", "visual_prompt_detection")


def _mixed(spark, sf_dir: str) -> DataFrame:
    """Samples of all tasks; every fifth that has a first prediction answers it with none as well; corners are keypoints."""
    s = box_samples(spark, sf_dir)
    k = F.col("sample_id") % len(TASKS)
    corners = lambda e: F.array(*[F.struct(F.lit(n).alias("name"), e["box"][i].alias("x"), e["box"][j].alias("y")) for n, i, j in (("tl", 0, 1), ("br", 2, 3), ("bl", 0, 3))])
    full = lambda e: F.struct(F.upper(e["cat"]).alias("cat"), e["box"].alias("box"), corners(e).alias("kpts"))
    none = F.transform(F.slice("pred", 1, 1), lambda e: full(e).withField("box", F.lit(None).cast("array<double>")))
    pred = F.transform("pred", full)
    pred = F.when((F.col("sample_id") % 5 == 0) & (F.size("pred") > 0), F.concat(pred, none)).otherwise(pred)
    return s.select(F.element_at(F.array(*[F.lit(t) for t in TASKS]), (k + 1).cast("int")).alias("task"), F.concat(F.lit("d"), F.col("sample_id") % 2).alias("dataset"), F.transform("gt", full).alias("gt"), pred.alias("pred"))


_T = "(sample_id % 8)"
_REORDERED = BOXES.replace("\ngt as (", "\ngt0 as (").replace("\npred as (", f"""
gt as (
  select sample_id, row_number() over (partition by sample_id order by case when {_T} = 4 then -(x1 - x0) * (y1 - y0) else 0 end, gi) as gi, cat, x0, y0, x1, y1 from gt0),
pred as (""")
_SQL = f"""
with recursive {_REORDERED[: _REORDERED.index("cross_ as")]}
firsts as (select p.sample_id, p.cat as pcat, g.cat as gcat from pred p join gt g using (sample_id) where p.pi = 1 and g.gi = 1),
valued as (
  select g.sample_id, gi, pi, g.cat as gcat, p.cat as pcat, f.gcat as fg, f.pcat as fp,
    greatest(least(g.x1, p.x1) - greatest(g.x0, p.x0), 0) * greatest(least(g.y1, p.y1) - greatest(g.y0, p.y0), 0) as inter, (g.x1 - g.x0) * (g.y1 - g.y0) as ga, (p.x1 - p.x0) * (p.y1 - p.y0) as pa,
    p.x0 between g.x0 and g.x1 and p.y0 between g.y0 and g.y1 as inside,
    (exp(-((g.x0 - p.x0) ** 2 + (g.y0 - p.y0) ** 2) / (0.00125 * (g.x1 - g.x0) * (g.y1 - g.y0))) + exp(-((g.x1 - p.x1) ** 2 + (g.y1 - p.y1) ** 2) / (0.00125 * (g.x1 - g.x0) * (g.y1 - g.y0)))
      + exp(-((g.x0 - p.x0) ** 2 + (g.y1 - p.y1) ** 2) / (0.00125 * (g.x1 - g.x0) * (g.y1 - g.y0)))) / 3 as oks
  from gt g join pred p using (sample_id) join firsts f using (sample_id)),
pairs as (
  select sample_id, gi, pi, gcat, pcat, iou from (
    select *, case {_T} when 1 then inter / (ga + pa - inter) when 2 then (gcat = pcat and inside)::int::double when 3 then (pcat = fp and gcat = fg and inside)::int::double when 4 then round(oks, 9)
      else case when exists (select 1 from gt h where h.sample_id = valued.sample_id and h.cat = pcat) then inter / (ga + pa - inter) else 0 end end as iou from valued)
  where iou > 0 and {_T} not in (5, 6)),
{greedy_sql("true").replace("from pred group by 1", "from pred p where (sample_id % 8) <> 3 or cat = (select pcat from firsts f where f.sample_id = p.sample_id) group by 1").replace("c.iou >= w.thr", "c.iou >= case when w.sample_id % 8 in (2, 3) then 0.5 else w.thr end")},
hits as (
  select g.sample_id, coalesce(bool_or((p.x0 + p.x1) / 2 between g.x0 and g.x1 and (p.y0 + p.y1) / 2 between g.y0 and g.y1), false) as hit from gt g left join pred p using (sample_id) where g.gi = 1 group by 1),
cats as (
  select sample_id, len(list_intersect(a, coalesce(b, []))) / len(a) as follows, b is not null and sample_id % 5 = 0 as refused
  from (select sample_id, list_distinct(list(cat)) as a from gt group by 1) left join (select sample_id, list_distinct(list(cat)) as b from pred group by 1) using (sample_id)),
rows as (
  select {_T} as t, sample_id % 2 as d, thr, case {_T} when 5 then (n_pred = 0)::int when 6 then hit::int else recall end as recall, case {_T} when 5 then (n_pred = 0)::int when 6 then hit::int else precision end as precision,
    case {_T} when 5 then 0 when 6 then 1 else n_gt end as n_gt, n_pred, refused, follows from counts join hits using (sample_id) join cats using (sample_id)),
sums as (
  select t, 'd' || d as dataset, thr as iou, avg(recall) as r, avg(precision) as p, avg(refused::int) as w, avg(abs(n_pred - n_gt)) as mae, avg(follows) as follows, sum(n_gt)::bigint as n_gt, sum(n_pred)::bigint as n_pred, count(*) as samples from rows group by all)
select ([{", ".join(f"'{t}'" for t in TASKS)}])[t + 1] as task, dataset, iou, round(r, 6) as recall, round(p, 6) as precision, case when p + r > 0 then round(2 * p * r / (p + r), 6) else 0.0 end as f1,
  case when t in (5, 6) then round(r, 6) end as accuracy, case when t <> 5 then round(w, 6) end as wrong_rejection, case when t = 7 then round(mae, 6) end as count_mae, round(follows, 6) as follows, n_gt, n_pred, samples from sums
"""


@query(_SQL)
def routed_tasks(spark, sf_dir: str) -> DataFrame:
    """All families' figures of a mixed table in one pass."""
    return router.routed_scores(_mixed(spark, sf_dir))


@query(f"""
with {BOXES},
e as (
  select sample_id, 'gt' as side, gi as k, case when sample_id % 3 = 2 then 'the thing' else lower(cat) || ' b' end as cat, x0 / 200 as x0, y0 / 200 as y0, x1 / 200 as x1, y1 / 200 as y1 from gt
  union all select sample_id, 'pred', pi, case when sample_id % 3 = 2 then 'the thing' else lower(cat) || ' b' end, x0 / 200, y0 / 200, x1 / 200, y1 / 200 from pred),
l as (select *, dense_rank() over (partition by sample_id, side order by f) as lab from (select *, min(k) over (partition by sample_id, side, case when sample_id % 3 = 2 then k else 0 end, cat) as f from e)),
kept as (select * from l where sample_id % 3 <> 1 or side = 'pred' or (lab = (select max(lab) from l m where m.sample_id = l.sample_id and m.side = 'gt') and k = f))
select sample_id, side, cat, round(least(round(x0, 3), 0.999) * 640, 2) as x0, round(least(round(y0, 3), 0.999) * 480, 2) as y0, round(least(round(x1, 3), 0.999) * 640, 2) as x1, round(least(round(y1, 3), 0.999) * 480, 2) as y1, count(*) as n
from kept group by all
""")
def detection_rows(spark, sf_dir: str) -> DataFrame:
    """Entries built from rendered answers: detection, gui (the first box of the last label) and visual prompts (one category)."""
    from ..functions import text

    s = box_samples(spark, sf_dir)
    visual, share = F.col("sample_id") % 3 == 2, lambda e: F.transform(e["box"], lambda v: v / 200)
    label = lambda e: F.concat(e["cat"], F.lit("-b"))
    grouped = lambda c: F.transform(F.array_distinct(F.transform(c, label)), lambda l: F.struct(l.alias("label"), F.transform(F.filter(c, lambda e: label(e) == l), share).alias("items")))
    single = lambda c: F.transform(c, lambda e, i: F.struct(F.concat(F.lit("object"), i).alias("label"), F.array(share(e)).alias("items")))
    rendered = lambda c: text.render_boxes(F.when(visual, single(c)).otherwise(grouped(c)))
    task = F.element_at(F.array(F.lit("common_object_detection"), F.lit("gui"), F.lit("visual_prompt_detection")), (F.col("sample_id") % 3 + 1).cast("int"))
    rows = s.select("sample_id", task.alias("task"), F.lit("The-Thing").alias("category"), F.lit(640).alias("width"), F.lit(480).alias("height"), rendered("gt").alias("truth"), rendered("pred").alias("answer"))
    built = router.answer_rows(rows)
    side = lambda c: F.transform(c, lambda e: F.struct(F.lit(c).alias("side"), e.alias("e")))
    # both sides in one pass; outer, as explode() would test the sizes first and parse all texts twice
    e = built.select("sample_id", F.explode_outer(F.concat(side("gt"), side("pred"))).alias("s")).where("s is not null").select("sample_id", "s.side", "s.e")
    return e.groupBy("sample_id", "side", F.col("e.cat").alias("cat"), *[F.round(F.col("e.box")[i], 2).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]).agg(F.count("*").alias("n"))
