"""Masks, polygons, captions and annotation joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, masks, text
from ..operators import captions, joins
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


def _items(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _runs(shift: int):
    p, s = F.col("l_partkey") + shift, F.col("l_suppkey")
    return F.array(p % 5, s % 7 + 1, p % 3 + 1, s % 4 + 2, F.lit(30) - p % 5 - s % 7 - p % 3 - s % 4).cast("array<int>")


@query(f"""
with m as (select {_ID}, l_partkey % 5 as a0, l_suppkey % 7 + 1 as a1, l_partkey % 3 + 1 as a2, l_suppkey % 4 + 2 as a3, (l_partkey + 1) % 5 as b0, (l_partkey + 1) % 3 + 1 as b2 from lineitem),
s as (select *, a0 as s1, a0 + a1 as e1, a0 + a1 + a2 as s2, a0 + a1 + a2 + a3 as e2, b0 as t1, b0 + a1 as f1, b0 + a1 + b2 as t2, b0 + a1 + b2 + a3 as f2 from m)
select {_ID}, (a1 + a3)::bigint as area, (greatest(least(e1, f1) - greatest(s1, t1), 0) + greatest(least(e1, f2) - greatest(s1, t2), 0) + greatest(least(e2, f1) - greatest(s2, t1), 0) + greatest(least(e2, f2) - greatest(s2, t2), 0))::bigint as shared from s
""")
def mask_run_overlap(spark, sf_dir: str) -> DataFrame:
    """Areas and shared pixels of run-length masks, no pixel ever expanded."""
    return _items(spark, sf_dir).select("*", text.run_area(_runs(0)).alias("area"), text.run_overlap(_runs(0), _runs(1)).alias("shared"))


@query(f"""
with m as (select {_ID}, l_partkey % 5 as a0, l_suppkey % 7 + 1 as a1, l_partkey % 3 + 1 as a2, l_suppkey % 4 + 2 as a3 from lineitem)
select {_ID}, case when {{p}} >= a0 and {{p}} < a0 + a1 or {{p}} >= a0 + a1 + a2 and {{p}} < a0 + a1 + a2 + a3 then true else false end as inside from m
""".replace("{p}", "(l_suppkey % 12)"))
def point_in_mask_runs(spark, sf_dir: str) -> DataFrame:
    at = (F.col("l_suppkey") % 12).cast("long")
    return _items(spark, sf_dir).select("*", F.exists(text.run_spans(_runs(0)), lambda s: (s["start"] <= at) & (at < s["end"])).alias("inside"))


@query(f"select {_ID}, true as same from lineitem")
def mask_codec_round_trip(spark, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).withColumn("r", _runs(0))
    return rows.withColumn("t", masks.runs_text("r")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (masks.text_runs("t") == F.col("r")).alias("same"))


@query(f"""
with b as (select {_ID}, (l_partkey % 10)::double as x0, (l_suppkey % 10)::double as y0, l_partkey % 10 + 5.0 as x1, l_suppkey % 10 + 4.0 as y1, (l_partkey % 7)::double as u0, (l_suppkey % 6)::double as v0,
  l_partkey % 7 + 6.0 as u1, l_suppkey % 6 + 6.0 as v1 from lineitem), i as (select *, greatest(least(x1, u1) - greatest(x0, u0), 0) * greatest(least(y1, v1) - greatest(y0, v0), 0) as inter from b)
select {_ID}, round(inter / (20 + 36 - inter), 9) as iou from i
""")
def polygon_iou(spark, sf_dir: str) -> DataFrame:
    """Boxes as polygons, so that their overlap is known."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    a, b = F.array(p % 10, s % 10, p % 10 + 5, s % 10 + 4).cast("array<double>"), F.array(p % 7, s % 6, p % 7 + 6, s % 6 + 6).cast("array<double>")
    return _items(spark, sf_dir).select("*", F.round(masks.polygon_iou(boxes.box_polygon(a), boxes.box_polygon(b)), 9).alias("iou"))


_CIDER = """
words as (select *, list_filter(regexp_split_to_array(lower(candidate), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as cw, list_filter(regexp_split_to_array(lower(reference), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as rw from cap),
sizes_ as (select unnest(range(1, 5)) as n),
rg as (
  select image, rid, n, gram, count(*)::double as tf from (select image, reference as rid, n, unnest(list_transform(range(1, len(rw) - n + 2), lambda i: array_to_string(rw[i:i + n - 1], ' '))) as gram from words, sizes_) group by all),
cg as (
  select image, n, gram, count(*)::double as tf from (select image, n, unnest(list_transform(range(1, len(cw) - n + 2), lambda i: array_to_string(cw[i:i + n - 1], ' '))) as gram from (select image, min(cw) as cw from words group by image), sizes_) group by all),
df as (select n, gram, count(distinct image) as df from rg group by all),
images as (select ln(greatest(1, count(distinct image))) as li from cap),
rw_ as (select rg.*, tf * (li - ln(greatest(df, 1))) as w from rg join df using (n, gram), images),
cw_ as (select cg.*, tf * (li - ln(greatest(coalesce(df, 1), 1))) as w from cg left join df using (n, gram), images),
rn as (select image, rid, n, sqrt(sum(w * w)) as rn from rw_ group by all),
cn as (select image, n, sqrt(sum(w * w)) as cn from cw_ group by all),
dot as (select r.image, r.rid, n, sum(least(c.w, r.w) * r.w) as dot from cw_ c join rw_ r using (image, n, gram) group by all),
sim as (select image, rid, sum(coalesce(dot / nullif(rn * cn, 0), 0)) / 4 as s from rn left join cn using (image, n) left join dot using (image, rid, n) group by all),
cider as (select image, avg(s) * 10 as cider from sim group by image)
"""
_CAPTIONS = """
first as (select conv_id, min_by(text, turn) as candidate, min(turn) as t from conversations where role = 'assistant' group by 1),
cap as (select conv_id as image, candidate, text as reference from conversations join first using (conv_id) where role = 'assistant' and turn > t)
"""


@query(f"with {_CAPTIONS}, {_CIDER} select image, round(cider, 6) as cider from cider")
def caption_cider(spark, sf_dir: str) -> DataFrame:
    """Each conversation's first answer against its other answers."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("candidate"), F.min("turn").alias("t"))
    pairs = c.join(first, "conv_id").where("turn > t").select(F.col("conv_id").alias("image"), "candidate", F.col("text").alias("reference"))
    return captions.cider(pairs).select("image", F.round("cider", 6).alias("cider"))


@query("""
with s as (select count(*) filter (where quality = 1 and toxic = 0) as tp, count(*) filter (where quality = 1 and toxic = 1) as fn, count(*) filter (where quality = 0) as fp, count(*) as images from labels),
r as (select *, tp / greatest(tp + fp, 1) as p, tp / greatest(tp + fn, 1) as r from s)
select tp, fn, fp, images, round(p, 6) as "precision", round(r, 6) as recall, round(2 * p * r / greatest(p + r, 1e-8), 6) as f1 from r
""")
def caption_counts(spark, sf_dir: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    n = lambda c, a: c.cast("long").alias(a)
    s = captions.counted(table(spark, sf_dir, "labels").select(n((q == 1) & (t == 0), "tp"), n((q == 1) & (t == 1), "fn"), n(q == 0, "fp")))
    return s.select("tp", "fn", "fp", "images", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""
with l as (select distinct url as path from pages where page_id % 3 = 0), c as (select page_id, unnest([url || '.bak', url, 'none']) as path, unnest([0, 1, 2]) as rank from pages)
select page_id, min_by(c.path, rank) as path from c join l using (path) group by page_id
""")
def first_existing_path(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    c = p.select("page_id", F.array(F.concat("url", F.lit(".bak")), "url", F.lit("none")).alias("c"))
    return joins.first_existing(c, "page_id", "c", p.where("page_id % 3 = 0").select(F.col("url").alias("path")))


@query("select user_id, event_id from (select user_id, event_id, value, lag(value) over (partition by user_id order by event_id) as p from events) where value < p")
def order_breaches(spark, sf_dir: str) -> DataFrame:
    return joins.unordered(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id")


@query("select o_orderkey, w, h, w * h // 256 as tokens from (select o_orderkey, (greatest(round_even(least(1.0, 1024.0 / greatest(a, b)) * a / 16, 0)::bigint, 1) * 16) as w, (greatest(round_even(least(1.0, 1024.0 / greatest(a, b)) * b / 16, 0)::bigint, 1) * 16) as h from (select o_orderkey, (o_custkey % 1900 + 100)::double as a, (o_orderkey % 1500 + 80)::double as b from orders))")
def image_resize_plan(spark, sf_dir: str) -> DataFrame:
    a, b = (F.col("o_custkey") % 1900 + 100).cast("double"), (F.col("o_orderkey") % 1500 + 80).cast("double")
    r = table(spark, sf_dir, "orders").select("o_orderkey", boxes.resize_plan(a, b, 1024, 16).alias("p"))
    return r.select("o_orderkey", F.col("p.width").alias("w"), F.col("p.height").alias("h"), boxes.image_tokens(F.col("p.width"), F.col("p.height"), 16).alias("tokens"))
