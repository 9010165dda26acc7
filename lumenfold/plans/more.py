"""Pointing, instances, pixel masks, filters, lookups and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..functions import geometry as geo
from ..operators import dense, instances, matching, reports, selection
from .common import BOXES, box_rows, box_samples, greedy_sql, table
from .detection import _keypoints
from .scoring import _DEPTH, _ERRORS, _depth, _poses, pair_errors

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _boxes_with(pairs: str) -> str:
    """The boxes' CTEs with other pairs."""
    return BOXES[: BOXES.index("cross_ as")] + f"pairs as ({pairs})"


_POINTS = "select g.sample_id, gi, pi, g.cat as gcat, p.cat as pcat, 1.0 as iou from gt g join pred p using (sample_id) where p.x0 between g.x0 and g.x1 and p.y0 between g.y0 and g.y1"
_MEANS = "select round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, count(*) as samples from counts"


def _mean(c: DataFrame) -> DataFrame:
    return c.agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"), F.count("*").alias("samples"))


@query(f"with recursive {_boxes_with(_POINTS)}, {greedy_sql('c.gcat = c.pcat', '0.5')} {_MEANS}")
def pointing_prf1(spark, sf_dir: str) -> DataFrame:
    """Corners of predicted boxes as points."""
    return _mean(instances.pointing_counts(box_samples(spark, sf_dir)))


_REFERRED = _boxes_with("""
select g.sample_id, gi, pi, g.cat as gcat, p.cat as pcat, 1.0 as iou from gt g join pred2 p using (sample_id)
where p.x0 between g.x0 and g.x1 and p.y0 between g.y0 and g.y1 and g.cat = (select h.cat from gt h where h.sample_id = g.sample_id and h.gi = 1)""").replace(
    "pairs as (", "pred2 as (select p.* from pred p join pred f on f.sample_id = p.sample_id and f.pi = 1 and f.cat = p.cat),\npairs as ("
)


@query(f"with recursive {_REFERRED}, {greedy_sql('true', '0.5').replace('from pred group by 1', 'from pred2 group by 1')} {_MEANS}")
def pointing_referring_prf1(spark, sf_dir: str) -> DataFrame:
    return _mean(instances.pointing_counts(box_samples(spark, sf_dir), referring=True))


@query(f"""
with recursive {BOXES}, ranked as (select *, row_number() over (partition by sample_id order by (x1 - x0) * (y1 - y0) desc, gi) as gj from gt),
cand as (
  select g.sample_id, g.gj, p.pi, round((exp(-((g.x0 - p.x0) ** 2 + (g.y0 - p.y0) ** 2) / (0.00125 * (g.x1 - g.x0) * (g.y1 - g.y0)))
    + exp(-((g.x1 - p.x1) ** 2 + (g.y1 - p.y1) ** 2) / (0.00125 * (g.x1 - g.x0) * (g.y1 - g.y0)))
    + exp(-((g.x0 - p.x0) ** 2 + (g.y1 - p.y1) ** 2) / (0.00125 * (g.x1 - g.x0) * (g.y1 - g.y0)))) / 3, 9) as oks
  from ranked g join pred p using (sample_id)),
best as (select sample_id, gj, max(oks) as oks from cand group by all having max(oks) > 0.5),
b as (select sample_id, avg(oks) as avg_oks, count(*) as pairs from best group by 1)
select s.sample_id, round(coalesce(avg_oks, 0), 6) as avg_oks, coalesce(pairs, 0)::int as pairs from (select distinct sample_id from gt) s left join b using (sample_id)
""")
def keypoint_best_oks(spark, sf_dir: str) -> DataFrame:
    """Mean of each true instance's best similarity above one half."""
    s = _summary(spark, sf_dir)
    return s.select("sample_id", F.round("avg_oks", 6).alias("avg_oks"), "pairs")


_OKS = """
cand as (
  select g.sample_id, g.gi, p.pi, g.cat as gcat, p.cat as pcat, round((exp(-((g.x0 - p.x0) ** 2 + (g.y0 - p.y0) ** 2) / (0.00125 * (g.x1 - g.x0) * (g.y1 - g.y0)))
    + exp(-((g.x1 - p.x1) ** 2 + (g.y1 - p.y1) ** 2) / (0.00125 * (g.x1 - g.x0) * (g.y1 - g.y0)))
    + exp(-((g.x0 - p.x0) ** 2 + (g.y1 - p.y1) ** 2) / (0.00125 * (g.x1 - g.x0) * (g.y1 - g.y0)))) / 3, 9) as iou
  from (select sample_id, cat, x0, y0, x1, y1, row_number() over (partition by sample_id order by (x1 - x0) * (y1 - y0) desc, gi) as gi from gt) g join pred p using (sample_id)),
thr as"""
_BEST = "best as (select sample_id, gi, max(iou) as iou from cand group by all having max(iou) > 0.5), b as (select sample_id, avg(iou) as a, count(*) as n from best group by 1)"


@query(f"with recursive {BOXES}, " + _OKS + greedy_sql("true", "0.5, 0.75, 0.9, 0.95").split("thr as", 1)[1] + f", {_BEST}" + """
select """ + ", ".join(f"(select round(avg(recall), 6) from counts where thr = {t / 100}) as ap{t}" for t in (50, 75, 90, 95)) + """,
  (select round(sum(a) / (select count(distinct sample_id) from gt), 6) from b) as avg_oks, (select sum(n)::bigint from b) as pairs
""")
def keypoint_ap_summary(spark, sf_dir: str) -> DataFrame:
    """Means over samples; AP at a threshold is the sample's recall there."""
    return _summary(spark, sf_dir).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("ap50", "ap75", "ap90", "ap95", "avg_oks")], F.sum("pairs").alias("pairs"))


def _summary(spark, sf_dir: str) -> DataFrame:
    s = _keypoints(spark, sf_dir)
    m = matching.score_matrix(F.col("gt"), F.col("pred"), lambda g, p: F.round(matching.oks_aligned(g["kpts"], p["kpts"], g["area"]), 9))
    s = s.select("sample_id", F.size("gt").alias("n_gt"), m.alias("m"), F.explode(F.array(F.lit(0))).alias("once"))  # ends the projection
    return s.select("sample_id", *instances.keypoint_summary(F.col("m"), F.col("n_gt")))


_CROWDS = """
select sample_id, gi, pi, gcat, pcat, inter / case when gi = 1 then pa else ga + pa - inter end as iou from (
  select g.sample_id, gi, pi, g.cat as gcat, p.cat as pcat, greatest(least(g.x1, p.x1) - greatest(g.x0, p.x0), 0) * greatest(least(g.y1, p.y1) - greatest(g.y0, p.y0), 0) as inter,
    (g.x1 - g.x0) * (g.y1 - g.y0) as ga, (p.x1 - p.x0) * (p.y1 - p.y0) as pa from gt g join pred p using (sample_id)) where inter > 0"""


@query(f"""
with recursive {_boxes_with(_CROWDS)}, {greedy_sql('c.gcat = c.pcat', '0.5')}, t as (select sum(matches)::bigint as matches, sum(n_gt)::bigint as gt_count, sum(n_pred)::bigint as pred_count from counts)
select *, round(matches / pred_count, 6) as precision, round(matches / gt_count, 6) as recall, round(2 * matches / (gt_count + pred_count), 6) as f1 from t
""")
def instance_f1(spark, sf_dir: str) -> DataFrame:
    """The first true box of a sample stands for a crowd."""
    s = box_samples(spark, sf_dir)
    s = s.withColumn("gt", F.transform("gt", lambda g, i: F.struct(g["cat"].alias("cat"), g["box"].alias("box"), (i == 0).alias("crowd"))))
    return instances.instance_f1(s).select("matches", "gt_count", "pred_count", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _pixels(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 400).alias("image"), F.col("event_id").alias("pos"), (F.floor(F.col("event_id") / 3) % 5).alias("id"))


@query("""
with p as (select event_id // 400 as image, event_id as pos, event_id // 3 % 5 as id from events),
r as (select *, pos - row_number() over (partition by image, id order by pos) as run from p where id <> 0)
select image, id, (id % 3)::int as cat, case when id = 1 then 0.5 else 1.0 end::double as score, count(*) as area, count(distinct run)::int as runs, min(pos) as first from r group by all
""")
def panoptic_to_instances(spark, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    s = p.select("image", "id").distinct().where("id <> 0").select("image", "id", (F.col("id") % 3).cast("int").alias("cat"), F.when(F.col("id") == 1, 0.5).alias("score"))
    empty = s.select("image", (F.col("id") + 100).alias("id"), "cat", "score")  # segments without pixels go
    m = instances.panoptic_to_instances(p, s.unionAll(empty))
    return m.select("image", "id", "cat", "score", "area", F.size("spans").alias("runs"), F.col("spans")[0]["start"].alias("first"))


@query("select event_id // 400 as image, (user_id % 4)::int as cat, count(distinct user_id % 97) as pixels from events group by all")
def mask_union(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 400).alias("image"), (F.col("user_id") % 4).cast("int").alias("cat"), (F.col("user_id") % 97).alias("pos"))
    return instances.mask_union(e, "image", "cat").groupBy("image", "cat").agg(F.count("*").alias("pixels"))


@query("""
with p as (select distinct event_id // 400 as image, (user_id % 20)::int as x, (user_id // 20 % 12)::int as y from events)
select image, x.x::bigint as x, y.y::bigint as y from p join range(33) x(x) on x.x * 20 // 33 = p.x join range(7) y(y) on y.y * 12 // 7 = p.y
""")
def resized_mask(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p = e.select(F.floor(F.col("event_id") / 400).alias("image"), (F.col("user_id") % 20).cast("int").alias("x"), (F.floor(F.col("user_id") / 20) % 12).cast("int").alias("y")).distinct()
    return instances.resized_mask(p, 20, 12, 33, 7, "image")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_partkey % 60 > 0 and (l_partkey % 60) / 100.0 between 0.05 and 0.5")
def mask_area_filter(spark, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 60).alias("area"), F.lit(20).alias("width"), F.lit(5).alias("height"))
    return instances.with_area_ratio(l, 0.05, 0.5).drop("area", "width", "height")


@query("""
with d as (select round(l_discount::double, 2) as score from lineitem where l_returnflag <> 'R')
select 'document' as rule, count(*) as n from d union all select 'federated', count(*) from d where score > 0.05 union all select 'standard', count(*) from d where score >= 0.05
""")
def score_thresholds(spark, sf_dir: str) -> DataFrame:
    d = box_rows(spark, sf_dir).where("has_pred")
    parts = [selection.above_score(d, r, 0.05).agg(F.lit(r).alias("rule"), F.count("*").alias("n")) for r in selection.SCORE_RULES]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("select p_partkey, case when split_part(p_name, ' ', 1) = 'green' then 'olive' else split_part(p_name, ' ', 1) end as category from part")
def category_alias(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", selection.aliased(F.split("p_name", " ")[0], {"green": "olive"}).alias("category"))


@query("select l_orderkey as sample from lineitem group by 1 having bool_or(l_returnflag = 'A')")
def loss_bearing(spark, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).agg(F.collect_list(F.struct((F.col("l_returnflag") == "A").cast("int").alias("loss"))).alias("plan"))
    return l.where(selection.bears_loss(F.col("plan"))).select("sample")


@query("""
select l_orderkey as seq, count(*) as n from lineitem group by 1
having min(l_quantity::double) > 3 and count(*) >= 3 and max(sqrt((l_partkey % 13) ** 2 + (l_suppkey % 11) ** 2)) <= 14 and min(l_tax::double + 0.01) >= 0.01 and max(l_tax::double + 0.01) <= 0.08
""")
def usable_sequences(spark, sf_dir: str) -> DataFrame:
    t = F.array((F.col("l_partkey") % 13).cast("double"), (F.col("l_suppkey") % 11).cast("double"))
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_quantity").cast("double").alias("quality"), t.alias("t"), (F.col("l_tax").cast("double") + 0.01).alias("scale"))
    return selection.usable_sequences(f, 3.0, 14.0, 3, (0.01, 0.08))


@query("select case when n is null then 'missing' when n <> o_orderkey % 4 + 1 then 'mismatch' else 'used' end as status, count(*) as sequences from orders left join (select l_orderkey, count(*) as n from lineitem where l_returnflag <> 'R' group by 1) on l_orderkey = o_orderkey group by 1")
def paired_sequences(spark, sf_dir: str) -> DataFrame:
    p = box_rows(spark, sf_dir).where("has_pred").groupBy(F.col("sample_id").alias("seq")).agg(F.count("*").alias("frames"))
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 4 + 1).alias("frames"))
    return selection.paired_sequences(p, t).groupBy("status").agg(F.count("*").alias("sequences"))


@query("select c_custkey, coalesce((select n_name from nation where n_nationkey = c_custkey), (select n_name from nation where n_nationkey = c_nationkey)) as n_name from customer")
def first_key_found(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return selection.by_any_key(c, table(spark, sf_dir, "nation"), ["c_custkey", "c_nationkey"], "n_nationkey", "n_name").select("c_custkey", "n_name")


@query("select event_type, round(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1), 6) as mean, round(sum(value) / (select count(*) from events), 6) as share from events group by 1")
def weighted_means(spark, sf_dir: str) -> DataFrame:
    """A running metric's weighted mean, and a sum over the length of the whole set."""
    e = table(spark, sf_dir, "events").withColumn("w", F.col("event_id") % 7 + 1)
    n = e.agg(F.count("*").alias("n"))
    s = e.groupBy("event_type").agg(F.round(selection.weighted_mean("value", "w"), 6).alias("mean"), F.sum("value").alias("s"))
    return s.join(F.broadcast(n)).select("event_type", "mean", F.round(F.col("s") / F.col("n"), 6).alias("share"))


@query("select doc_id from documents where n_chars > 500 order by doc_id limit 50")
def emitted_limit(spark, sf_dir: str) -> DataFrame:
    """The first fifty that pass, the operator's own limit."""
    return selection.emitted(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars") > 500, 50, "doc_id").select("doc_id")


@query(f"with {BOXES} select sample_id, list([x0, y0, x1, y1] order by x0, y0, x1, y1) as found from gt group by 1")
def boxes_by_corner(spark, sf_dir: str) -> DataFrame:
    return box_samples(spark, sf_dir).select("sample_id", selection.by_corner(F.transform("gt", lambda g: g["box"])).alias("found"))


def _uniform_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296"


@query(f"""
with {BOXES}, h as (select sample_id, list([x0, y0, x1, y1] order by md5('5:' || sample_id || ':' || (gi - 1)), x0, y0, x1, y1) as b, count(*) as n from gt group by 1)
select sample_id, b[1:least(case when n <= 2 or {_uniform_sql("'5-one:' || sample_id")} < 0.6 then 1 else 1 + floor({_uniform_sql("'5-k:' || sample_id")} * greatest(n // 3, 1))::int end, n)] as chosen from h
""")
def reference_boxes(spark, sf_dir: str) -> DataFrame:
    """The boxes chosen as references of a sample."""
    s = box_samples(spark, sf_dir).select("sample_id", F.transform("gt", lambda g: g["box"]).alias("b"))
    return s.select("sample_id", selection.reference_boxes(F.col("b"), 5, "sample_id").alias("chosen"))


@query("select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 64 as batch from orders qualify row_number() over (order by o_orderkey) > 64 * 3")
def skipped_batches(spark, sf_dir: str) -> DataFrame:
    return selection.without_first_batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 64, 3)


@query("select l_orderkey as sample, list(l_linenumber::int order by l_linenumber) || list_transform(range(9 - count(*)), lambda i: -1)::int[] as ids from lineitem group by 1")
def padded_lists(spark, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("int"))).alias("x"))
    return l.select("sample", selection.padded(F.col("x"), F.lit(9), F.lit(-1)).alias("ids"))


_PLACES = "select event_id, event_id // 12 as doc, event_id as at, case when event_id % 12 between 2 and 5 then 1 else -1 end as f, case when event_id % 12 between 6 and 8 then 2 when event_id % 12 > 8 then 3 else -1 end as n from events"


@query(f"""
with p as ({_PLACES})
select q.event_id, count(*) as sees from p q join p k on q.doc = k.doc and (k.at <= q.at or q.f = k.f and q.f >= 0) and not (k.n >= 0 and k.n <> q.n) group by 1
""")
def attention_spans(spark, sf_dir: str) -> DataFrame:
    """How many places of its document each place sees."""
    i = F.col("event_id") % 12
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 12).alias("doc"), F.col("event_id").alias("at"), F.when(i.between(2, 5), 1).otherwise(-1).alias("full"), F.when(i.between(6, 8), 2).when(i > 8, 3).otherwise(-1).alias("noise"))
    return selection.visible_counts(e).select("event_id", "sees")


@query(f"""
with {_DEPTH}, s as (
  select sample, avg(abs(pred - gt)) as l1, avg(abs((pred - gt) / gt)) as mae_rel, avg((ln(pred) - ln(gt)) ** 2) - 0.85 * avg(ln(pred) - ln(gt)) ** 2 as silog_mse from px where valid and gt > 0 group by 1)
select round(avg(l1), 6) as l1, round(avg(mae_rel), 6) as mae_rel, round(avg(silog_mse), 6) as silog_mse, round(avg(10 * sqrt(greatest(silog_mse, 0))), 6) as silog_rmse from s
""")
def training_losses(spark, sf_dir: str) -> DataFrame:
    s = dense.training_losses(_depth(spark, sf_dir), 0.85, 10.0)
    return s.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("l1", "mae_rel", "silog_mse", "silog_rmse")])


@query("select vec_id, sqrt(a * a + b * b + c * c) >= 0.1 as usable, [floor((least(greatest(a, -1), 1) + 1) / 2 * 255)::int, floor((least(greatest(b, -1), 1) + 1) / 2 * 255)::int, floor((least(greatest(c, -1), 1) + 1) / 2 * 255)::int] as rgb from (select vec_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings)")
def normal_images(spark, sf_dir: str) -> DataFrame:
    n = F.slice(F.col("embedding").cast("array<double>"), 1, 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", dense.usable_normal(n).alias("usable"), dense.normal_bytes(n).alias("rgb"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(a / r, 6) as x, round(b / r, 6) as y, round(1 / r, 6) as z, (479 - 250.0)::double as cx from (select *, sqrt(a * a + b * b + 1) as r from (select *, (l_partkey % 640 - 320.0)::double / 500 as a, (l_suppkey % 480 - 250.0)::double / 500 as b from lineitem))")
def pixel_rays(spark, sf_dir: str) -> DataFrame:
    """Directions of pixels, and the centre of the image turned a quarter."""
    k = [F.lit(v) for v in (500.0, 500.0, 320.0, 250.0)]
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geo.ray((F.col("l_partkey") % 640).cast("double"), (F.col("l_suppkey") % 480).cast("double"), *k).alias("d"))
    turned = geo.turned_intrinsics(*k, F.lit(640.0), F.lit(480.0), 1)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(F.col("d")[i], 6).alias(c) for i, c in enumerate("xyz")], turned["cx"].alias("cx"))


@query(f"with {_ERRORS}, e as (select greatest(r_err, t_err) as e from errors) select " + ", ".join(
    f"round(avg(case when e <= {t} then ({t} + 1 - least(floor(e * ({t} + 1) / {t}), {t})) / ({t} + 1) else 0.0 end), 6) as auc_{t}" for t in (5, 15, 30)
) + " from e")
def pose_auc_bins(spark, sf_dir: str) -> DataFrame:
    """The other area under the curve: max + 1 equal bins over [0, max], errors beyond left out."""
    e = pair_errors(_poses(spark, sf_dir)).select(F.greatest("r_err", "t_err").alias("e"))
    return e.agg(*[F.round(binned_auc(F.col("e"), t), 6).alias(f"auc_{t}") for t in (5, 15, 30)])


def binned_auc(error, limit: int):
    """Mean of the cumulated shares of a histogram of limit + 1 bins: an error in bin b is counted in the
    limit + 1 - b bins from there on."""
    b = F.least(F.floor(error * (limit + 1) / limit), F.lit(limit))
    return F.avg(F.when(error <= limit, (limit + 1 - b) / (limit + 1)).otherwise(0.0))


@query("select doc_id, case when source like 'src1%' then 'one' when contains(source, '2') then 'two' else source end as alias, case when starts_with(source, 'src') then 'Detection' end as kind from documents")
def alias_and_kind(spark, sf_dir: str) -> DataFrame:
    s = F.col("source")
    return table(spark, sf_dir, "documents").select("doc_id", text.resolved(s, {"src1": "one", "2": "two"}).alias("alias"), text.dataset_kind(s).alias("kind"))


@query("select user_id, max_by(event_id, event_id) as event_id, count(*) as n, sum((event_type = 'click')::int)::bigint as clicks from events group by 1")
def last_rows_and_counts(spark, sf_dir: str) -> DataFrame:
    """The last row of each sequence's table, and counts by status."""
    e = table(spark, sf_dir, "events")
    n = e.groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "click").cast("long")).alias("clicks"))
    return reports.latest(e.select("user_id", "event_id"), "user_id", "event_id").join(n, "user_id")


@query("select conv_id, turn, trim(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^''+|''+$', '', 'g')) as plain, false as tagged from conversations")
def plain_captions(spark, sf_dir: str) -> DataFrame:
    """Tags and colours put into the texts go again."""
    c = table(spark, sf_dir, "conversations")
    t = F.concat(F.lit("<p>'"), "text", F.lit(" </p> (1, 22,3) [SEG]"))
    t = F.replace(t, F.lit(" [SEG]"), F.lit("<SEG>'"))
    return c.select("conv_id", "turn", text.plain_caption(t).alias("plain"), F.contains(text.plain_caption(t), F.lit("</p>")).alias("tagged"))
