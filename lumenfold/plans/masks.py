"""Masks given by runs: merges, growth, suppression, and the scores of grounded captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import captions, curves, runs
from ..staging import staged
from .common import BOXES, box_rows, dealt, table
from .scoring import _AP
from .shapes import _CAPTIONS, _CIDER

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Places of a column and columns of the made masks' images.
HEIGHT, WIDTH = 48, 64


def _rectangles(spark, sf_dir: str) -> DataFrame:
    """A line item is a rectangle in its order's image: image, id, score, x0, y0, w, h."""
    l = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    one = l.groupBy(F.col("l_orderkey").alias("image")).agg(F.array_sort(F.collect_list(key)).alias("m")).select("image", F.posexplode("m").alias("id", "m"))
    part, supp, n, q = (F.col(f"m.{c}") for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    sides = {"x0": part % 50, "y0": supp % 30, "w": 4 + n, "h": 5 + q.cast("int") % 12}
    return one.select("image", F.col("id").cast("long").alias("id"), F.col("m.l_discount").cast("double").alias("score"), *[c.alias(k) for k, c in sides.items()])


def _slanted(rectangles: DataFrame) -> DataFrame:
    """It begins on a slant, so runs have several lengths."""
    cols = rectangles.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    start = (F.col("x0") + F.col("k")) * HEIGHT + F.col("y0") + F.col("k") % 3
    return cols.select("image", "id", "score", start.cast("long").alias("start"), (start + F.col("h")).cast("long").alias("end"))


def _masks(spark, sf_dir: str) -> DataFrame:
    return _slanted(_rectangles(spark, sf_dir))


_PIXELS = f"""
m as (
  select l_orderkey as image, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) - 1 as id,
    l_discount::double as score, l_partkey % 50 as x0, l_suppkey % 30 as y0, 4 + l_linenumber as w, 5 + trunc(l_quantity)::int % 12 as h from lineitem),
col as (select image, id, score, x0 + k as x, y0 + k % 3 as y0, h from (select *, unnest(range(w)) as k from m)),
px as (select image, id, score, x, y0 + j as y from (select *, unnest(range(h)) as j from col)),
cover as (select image, x, y, count(*) as n from px group by all)
"""


def _islands(cells: str) -> str:
    """Runs of a relation (image, x, y) without repeats."""
    return f"""select image, min(p)::bigint as start, max(p)::bigint + 1 as "end" from (
  select image, p, p - row_number() over (partition by image order by p) as g from (select image, x * {HEIGHT} + y as p from {cells})) group by image, g"""


@query(f"with {_PIXELS}, c as (select * from cover) {_islands('c')}")
def mask_merge(spark, sf_dir: str) -> DataFrame:
    """The union of an image's masks."""
    return runs.merged(_masks(spark, sf_dir), ["image"])


@query(f"with {_PIXELS}, c as (select * from cover where n >= 2) {_islands('c')}")
def mask_twice(spark, sf_dir: str) -> DataFrame:
    """What two masks of an image cover at least."""
    return runs.merged(_masks(spark, sf_dir), ["image"], 2)


def _sized(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"height": F.lit(HEIGHT), "width": F.lit(WIDTH)})


_SHIFTED = "(select image, x + a as x, y + b as y from cover, (select unnest(range(-{r}, {r} + 1)) as a), (select unnest(range(-{r}, {r} + 1)) as b))"
_INSIDE = f"x >= 0 and x < {WIDTH} and y >= 0 and y < {HEIGHT}"
_SHRUNK = f"select image, x, y from {_SHIFTED.format(r=1)} where {_INSIDE} group by all having count(*) = 9"


@query(f"with {_PIXELS}, c as (select distinct image, x, y from {_SHIFTED.format(r=2)} where {_INSIDE}) {_islands('c')}")
def mask_grown(spark, sf_dir: str) -> DataFrame:
    """The union, grown by two places on all sides."""
    return runs.grown(_sized(mask_merge(spark, sf_dir)), ["image"], 2)


@query(f"with {_PIXELS}, c as ({_SHRUNK}) {_islands('c')}")
def mask_shrunk(spark, sf_dir: str) -> DataFrame:
    return runs.shrunk(_sized(mask_merge(spark, sf_dir)), ["image"], 1)


@query(f"with {_PIXELS}, c as (select image, x, y from cover except {_SHRUNK}) {_islands('c')}")
def mask_rim(spark, sf_dir: str) -> DataFrame:
    """Places of the union beside its outside."""
    return runs.boundary(_sized(mask_merge(spark, sf_dir)), ["image"])


@query(f"with {_PIXELS} select image, id, min(x)::bigint as x0, min(y)::bigint as y0, (max(x) - min(x) + 1)::bigint as w, (max(y) - min(y) + 1)::bigint as h, count(*) as area from px group by image, id")
def mask_bounds(spark, sf_dir: str) -> DataFrame:
    m = _masks(spark, sf_dir)
    box = runs.bounds(_sized(m), ["image", "id"])
    return box.join(runs.areas(m, ["image", "id"]), ["image", "id"]).select("image", "id", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "w", "h", "area")])


@query(f"""
with recursive {_PIXELS},
size as (select image, id, count(*) as a from px group by all),
met as (select p.image, p.id as a, q.id as b, count(*) as n from px p join px q on p.image = q.image and p.x = q.x and p.y = q.y and p.id <> q.id group by all),
near as (select met.image, met.a, met.b from met join size s on s.image = met.image and s.id = met.a join size t on t.image = met.image and t.id = met.b where n / (s.a + t.a - n) > 0.2),
ranked as (select image, id, row_number() over (partition by image order by score desc, id) as j from (select distinct image, id, score from px)),
walk as (
  select image, 0::bigint as j, []::bigint[] as kept from ranked group by image
  union all
  select w.image, r.j, case when exists (select 1 from near n where n.image = w.image and n.b = r.id and list_contains(w.kept, n.a)) then w.kept else list_append(w.kept, r.id) end
  from walk w join ranked r on r.image = w.image and r.j = w.j + 1)
select r.image, r.id, list_contains(kept, r.id) as kept from ranked r join walk w on w.image = r.image and w.j = (select max(j) from ranked x where x.image = r.image)
""")
def mask_suppression(spark, sf_dir: str) -> DataFrame:
    """Of masks that overlap by more than a fifth the better one stays."""
    r = _rectangles(spark, sf_dir)
    return runs.suppressed(_slanted(r).select("image", "id", "start", "end"), r.where("w > 0").select("image", "id", "score"), 0.2)


# ---- grounded captions: boxes of the detection queries as masks, all of one category

_ONE = BOXES.replace("l_returnflag as cat", "l_returnflag as flag, 'a' as cat").replace("from rows_ where cat <> 'R'", "from rows_ where flag <> 'R'")


def _grounded(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """True and found masks, one row each: image, id, score and the lists of their runs, one for each column."""
    r, h = dealt(box_rows(spark, sf_dir), "sample_id"), 256

    def masks(t: DataFrame, *at: str) -> DataFrame:
        order = Window.partitionBy("sample_id").orderBy("pos", *at, "w", "h", "cat", "score")
        start = (F.col(at[0]) * h + F.col(at[1])).cast("long")
        every = lambda s: F.sequence(s, s + (F.col("w") - 1) * h, F.lit(h).cast("long"))
        rows = t.withColumn("id", (F.row_number().over(order) - 1).cast("long"))
        return rows.select(F.col("sample_id").alias("image"), "id", "score", every(start).alias("starts"), every(start + F.col("h")).alias("ends"))

    moved = r.where("has_pred").withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")})
    return masks(r, "x", "y"), masks(moved, "x", "y")


@query(f"""
with recursive {_ONE},
ious as (select sample_id, pi as a, gi as b, iou, row_number() over (partition by sample_id order by iou desc, pi, gi) as j from pairs),
walk as (
  select sample_id, 0::bigint as j, []::bigint[] as a, []::bigint[] as b, 0.0::double as s from ious group by 1
  union all
  select w.sample_id, i.j, case when free then list_append(w.a, i.a) else w.a end, case when free then list_append(w.b, i.b) else w.b end, case when free then s + iou else s end
  from walk w join ious i on i.sample_id = w.sample_id and i.j = w.j + 1, lateral (select not list_contains(w.a, i.a) and not list_contains(w.b, i.b) as free))
select image, round(coalesce(s / len(a), 0), 6) as miou, coalesce(len(a), 0)::int as pairs from (select distinct sample_id as image from gt) left join (
  select w.* from walk w where j = (select max(j) from ious i where i.sample_id = w.sample_id)) w on w.sample_id = image
""")
def paired_mask_miou(spark, sf_dir: str) -> DataFrame:
    """Masks paired by the largest overlap again and again."""
    return runs.paired_overlaps(*[t.drop("score") for t in _grounded(spark, sf_dir)]).select("image", F.round("miou", 6).alias("miou"), "pairs")


@query(_AP.replace("with recursive", "with recursive", 1).replace(BOXES, _ONE) + ", " + _CAPTIONS.replace("select conv_id as image", "select distinct conv_id as image") + ", " + _CIDER + """,
pi as (select sample_id, pi as a, gi as b, iou, row_number() over (partition by sample_id order by iou desc, pi, gi) as j from pairs),
pw as (
  select sample_id, 0::bigint as j, []::bigint[] as a, []::bigint[] as b, 0.0::double as s from pi group by 1
  union all
  select w.sample_id, i.j, case when free then list_append(w.a, i.a) else w.a end, case when free then list_append(w.b, i.b) else w.b end, case when free then s + iou else s end
  from pw w join pi i on i.sample_id = w.sample_id and i.j = w.j + 1, lateral (select not list_contains(w.a, i.a) and not list_contains(w.b, i.b) as free)),
mi as (select image, coalesce(v, 0) as v from (select distinct sample_id as image from gt) left join (
  select sample_id, s / len(a) as v from pw w where j = (select max(j) from pi i where i.sample_id = w.sample_id)) w on w.sample_id = image)
select (select round(avg(v) * 100, 4) from mi) as miou, (select round(ap * 100, 4) from s where iou = 0.5) as ap50, (select round(ap * 100, 4) from s where iou = 0.75) as ap75,
  (select round(avg(cider) * 100, 4) from cider) as cider, (select count(*) from mi) as images
""")
def grounded_caption_scores(spark, sf_dir: str) -> DataFrame:
    """Of grounded captions: mask overlap of paired masks, mask precision (one category) and the captions' score."""
    g, p = _grounded(spark, sf_dir)
    hits = staged(runs.mask_hits(p, g), "hits")
    miou = runs.paired_overlaps(hits=hits).agg(F.round(F.avg("miou") * 100, 4).alias("miou"), F.count("*").alias("images"))
    tb, fb = runs.overlap_boxes(hits=hits)
    mask = lambda t: t.select("image", F.lit("a").alias("cat"), F.col("id").alias("pos"), "box", "id")
    truths = mask(tb).drop("id").withColumns({"crowd": F.lit(False), "ignore": F.lit(False)})
    found = mask(fb).join(p.select("image", "id", "score"), ["image", "id"]).drop("id").withColumn("skip", F.lit(False))
    m = curves.match_codes(truths, found, (0.5, 0.75), overlap=runs.mask_iou, size=runs.mask_area)
    ap = curves.average_precisions(m, curves.positives(truths, size=runs.mask_area), (0.5, 0.75))
    ap = ap.agg(*[F.round(F.max(F.when(F.col("iou") == t, F.col("ap"))) * 100, 4).alias(n) for t, n in ((0.5, "ap50"), (0.75, "ap75"))])
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("candidate"), F.min("turn").alias("t"))
    cap = c.join(first, "conv_id").where("turn > t").select(F.col("conv_id").alias("image"), "candidate", F.col("text").alias("reference")).distinct()
    cider = captions.cider(cap).agg(F.round(F.avg("cider") * 100, 4).alias("cider"))
    return miou.crossJoin(ap).crossJoin(cider)  # one row each
