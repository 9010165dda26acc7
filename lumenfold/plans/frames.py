"""Frames, cameras, paths, painted masks, nested values and loose parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import boxes, loose, text
from ..functions import geometry as geo
from ..operators import assembly, dense, frames, mixture, nested, runs, segments
from .assembly import _SQL as _ASSEMBLED
from .assembly import _inputs
from .common import table
from .masks import _PIXELS, _islands, _masks
from .scoring import _CELLS

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _frames(spark, sf_dir: str) -> DataFrame:
    """A user's events are a sequence's frames; one in four won't do."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), at.cast("long").alias("frame"), "event_id", (F.col("event_id") % 4 != 0).alias("usable"))


_FRAMES = "f as (select user_id as seq, row_number() over (partition by user_id order by event_id) - 1 as frame, event_id, event_id % 4 <> 0 as usable from events)"


@query(f"""
with {_FRAMES}, s as (select seq, count(*) as n from f group by 1), a as (select unnest(range(5)) as attempt),
d as (select seq, attempt, floor(('0x' || substr(md5('9-' || attempt || ':' || seq), 1, 8))::bigint / 4294967296 * (n - 3 + 1))::bigint as start from s, a where n >= 3),
ok as (select d.seq, attempt, start from d join f on f.seq = d.seq and f.frame between start and start + 2 and usable group by all having count(*) = 3),
w as (select seq, min(attempt) as attempt, arg_min(start, attempt) as start from ok group by 1)
select s.seq, attempt::int as attempt, case when start is not null then [start, start + 1, start + 2] end as frames from s left join w using (seq)
""")
def frames_drawn(spark, sf_dir: str) -> DataFrame:
    """Three neighbouring frames of each sequence, drawn again up to five times until all will do."""
    f = _frames(spark, sf_dir)
    return frames.drawn_frames(f.groupBy("seq").agg(F.count("*").alias("n")), f.where("usable"), 3, 5, 9)


@query(f"""
with {_FRAMES}, q as (select seq from f group by 1 having avg(usable::int) > 0.7)
select f.seq, f.frame, event_id, l_orderkey from f join (select l_suppkey % 50 as seq, l_linenumber as frame, l_orderkey from lineitem) w on w.seq = f.seq and w.frame = f.frame where f.seq in (select seq from q)
""")
def frames_listed(spark, sf_dir: str) -> DataFrame:
    """Frames that a list names, of sequences of good quality."""
    f = _frames(spark, sf_dir)
    wanted = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("seq"), F.col("l_linenumber").cast("long").alias("frame"), "l_orderkey")
    good = f.groupBy("seq").agg(F.avg(F.col("usable").cast("int")).alias("q")).where("q > 0.7")
    return frames.listed_frames(f.select("seq", "frame", "event_id"), wanted, good)


_Q = "sqrt(64 + (l_partkey % 7) ** 2 + (l_suppkey % 5) ** 2 + l_linenumber ** 2)"
_CAM = f"""
c as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, 8 / {_Q} as w, (l_partkey % 7) / {_Q} as x, (l_suppkey % 5) / {_Q} as y, l_linenumber / {_Q} as z,
    (l_partkey % 13)::double as t1, (l_suppkey % 11)::double as t2, l_linenumber::double as t3 from lineitem),
m as (select *, 1 - 2 * (y * y + z * z) as r11, 2 * (x * y - w * z) as r12, 2 * (x * z + w * y) as r13, 2 * (x * y + w * z) as r21, 1 - 2 * (x * x + z * z) as r22, 2 * (y * z - w * x) as r23,
  2 * (x * z - w * y) as r31, 2 * (y * z + w * x) as r32, 1 - 2 * (x * x + y * y) as r33 from c)
"""


def _cameras(spark, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    q = geo.unit(F.array(F.lit(8.0), F.col("l_partkey") % 7, F.col("l_suppkey") % 5, F.col("l_linenumber")).cast("array<double>"))
    t = F.array(F.col("l_partkey") % 13, F.col("l_suppkey") % 11, F.col("l_linenumber")).cast("array<double>")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.alias("q"), t.alias("t"))


def _shown(**values) -> list:
    return [(F.round(v, 6) + 0.0).alias(k) for k, v in values.items()]


@query(f"""
with {_CAM}
select l_orderkey, l_linenumber, l_partkey, l_suppkey, {", ".join(f"round({v}, 6) + 0.0 as {k}" for k, v in {
    "p11": "-r11", "p12": "-r21", "p13": "-r31", "p31": "r13", "p33": "r33", "pt1": "-t1 / 30", "pt3": "t3 / 30", "e11": "r22", "e12": "-r23", "e13": "r21", "e31": "r12", "et1": "t2 / 100", "et2": "-t3 / 100", "et3": "t1 / 100",
    "cycled": "t2", "cycled_q": "y"}.items())},
  round(1.5 * least(640, 480) / 2, 6) as fx, round(640 / 2 - 0.1 * 240, 6) + 0.5 as cx from m
""")
def camera_conventions(spark, sf_dir: str) -> DataFrame:
    """Cameras of other conventions: flipped axes, an engine's axes, cycled axes, intrinsics in half sides."""
    c = _cameras(spark, sf_dir).withColumn("m", geo.matrix(F.col("q")))
    pose = F.array(*[F.col("t")[i] for i in range(3)], *[F.col("q")[i] for i in (1, 2, 3, 0)])
    c = c.withColumn("pose", pose)
    pm, pt = geo.projection_camera(F.col("m"), F.col("t"), 30.0)
    em, et = geo.engine_camera(F.col("pose"))
    cq, ct = geo.axes_cycled(F.col("pose"))
    k = geo.projection_intrinsics(F.array(F.lit(1.5), F.lit(1.5)), F.array(F.lit(0.1), F.lit(-0.1)), F.lit(640), F.lit(480))
    c = c.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pm.alias("pm"), pt.alias("pt"), em.alias("em"), et.alias("et"), cq.alias("cq"), ct.alias("ct"), geo.shifted_intrinsics(k, 0.5).alias("k"))
    g = lambda c, i: F.col(c)[i]
    return c.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        *_shown(p11=g("pm", 0), p12=g("pm", 1), p13=g("pm", 2), p31=g("pm", 6), p33=g("pm", 8), pt1=g("pt", 0), pt3=g("pt", 2), e11=g("em", 0), e12=g("em", 1), e13=g("em", 2), e31=g("em", 6), et1=g("et", 0), et2=g("et", 1), et3=g("et", 2), cycled=g("ct", 0), cycled_q=g("cq", 1), fx=F.col("k.fx"), cx=F.col("k.cx")),
    )


@query("""
with c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 13)::double as cx, (l_suppkey % 11)::double as cy, l_linenumber::double as cz, (l_partkey % 13 + 1 + l_suppkey % 3)::double as tx, (l_suppkey % 11 + l_partkey % 4)::double as ty, (l_linenumber + 5)::double as tz from lineitem),
z as (select *, sqrt((tx - cx) ** 2 + (ty - cy) ** 2 + (tz - cz) ** 2) as d from c), n as (select *, (tx - cx) / d as z1, (ty - cy) / d as z2, (tz - cz) / d as z3 from z),
x as (select *, -z3 / sqrt(z3 * z3 + z1 * z1) as x1, 0.0::double as x2, z1 / sqrt(z3 * z3 + z1 * z1) as x3 from n),
y as (select *, -(x2 * z3 - x3 * z2) as y1, -(x3 * z1 - x1 * z3) as y2, -(x1 * z2 - x2 * z1) as y3 from x), u as (select *, sqrt(y1 * y1 + y2 * y2 + y3 * y3) as yd from y)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(x1, 6) + 0.0 as x1, round(x3, 6) + 0.0 as x3, round(y1 / yd, 6) + 0.0 as y1, round(y2 / yd, 6) + 0.0 as y2, round(z3, 6) + 0.0 as z3,
  round(-(x1 * cx + x3 * cz), 5) + 0.0 as s1, round(-(z1 * cx + z2 * cy + z3 * cz), 5) + 0.0 as s3, round((x1 * tx + x3 * tz) - (x1 * cx + x3 * cz), 5) + 0.0 as seen from u
""")
def look_at_cameras(spark, sf_dir: str) -> DataFrame:
    """Cameras that look at a point; it then lies on their axis."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array(p % 13, s % 11, n).cast("array<double>").alias("c"), F.array(p % 13 + 1 + s % 3, s % 11 + p % 4, n + 5).cast("array<double>").alias("to"))
    m, t = geo.look_at(F.col("c"), F.col("to"))
    l = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", m.alias("m"), t.alias("t"), "to")
    whole = F.array(*[x for i in range(3) for x in (*[F.col("m")[3 * i + j] for j in range(3)], F.col("t")[i])], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    l = l.withColumn("seen", geo.transformed(whole, F.col("to"), 3))
    g = lambda i: F.col("m")[i]
    five = lambda c, a: (F.round(c, 5) + 0.0).alias(a)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_shown(x1=g(0), x3=g(2), y1=g(3), y2=g(4), z3=g(8)), five(F.col("t")[0], "s1"), five(F.col("t")[2], "s3"), five(F.col("seen")[0], "seen"))


@query("select n_nationkey, x + 1 as x, y + 2 as y from nation, range(n_nationkey % 4 + 1) a(x), range(n_regionkey + 1) b(y)")
def pixel_grids(spark, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    size = lambda c: F.col(c).cast("int")
    return n.select("n_nationkey", F.explode(geo.pixel_grid(size("n_nationkey") % 4 + 1, size("n_regionkey") + 1, 1, 2)).alias("p")).select("n_nationkey", F.col("p.x").cast("long").alias("x"), F.col("p.y").cast("long").alias("y"))


@query("""
select doc_id, case when doc_id % 3 = 0 then '/abs/' || source when doc_id % 3 = 1 then 's3://b/' || source when doc_id % 2 = 0 then '/data/in/' || source else 'hdfs://x/out/' || source end as path from documents
""")
def media_paths(spark, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.when(i % 3 == 0, F.concat(F.lit("/abs/"), "source")).when(i % 3 == 1, F.concat(F.lit("s3://b/"), "source")).otherwise(F.col("source"))
    return d.select("doc_id", text.media_path(path, F.when(i % 2 == 0, "input").otherwise("output"), {"input": "/data/in/", "output": "hdfs://x/out"}).alias("path"))


@query(f"""
with {_PIXELS}, top as (select image, x, y, max(id) as id from px where id % 5 <> 4 group by all), c as (select image, x, y from top where id % 3 <> 1) {_islands('c')}
""")
def painted_masks(spark, sf_dir: str) -> DataFrame:
    """Shapes painted in order: every third clears, flags paint nothing."""
    label = F.when(F.col("id") % 5 == 4, " Flag").when(F.col("id") % 3 == 1, "ignore this").otherwise("thing")
    return runs.painted(_masks(spark, sf_dir).select("image", label.alias("label"), F.col("id").alias("at"), "start", "end"), ["image"])


@query(f"with {_CELLS} select image, pred, sum(n)::bigint as n from cells group by all")
def label_counts(spark, sf_dir: str) -> DataFrame:
    return segments.distinct_labels(_cells(spark, sf_dir), "pred")


def _cells(spark, sf_dir: str) -> DataFrame:
    from .scoring import _cells as cells

    return cells(spark, sf_dir)


@query(f"""
with {_CELLS}, m as (select gt, pred, sum(n) as n from cells group by all),
s as (select c as cls, (select sum(n) from m where gt = c and pred = c) as tp, (select sum(n) from m where gt = c) as g, (select sum(n) from m where pred = c) as p from range(6) t(c)),
i as (select cls, coalesce(tp, 0) / nullif(coalesce(g, 0) + coalesce(p, 0) - coalesce(tp, 0), 0) as iou, coalesce(tp, 0) / nullif(coalesce(g, 0), 0) as acc from s)
select 'class ' || cls as class, round(iou, 6) as IoU, round(acc, 6) as ACC from i where cls < 5 and (iou is not null or acc is not null)
union all select 'overall', (select round(avg(iou), 6) from i), (select round(sum(n) filter (where gt = pred) / sum(n), 6) from m)
""")
def class_table(spark, sf_dir: str) -> DataFrame:
    """Figures of the named classes and of all."""
    m = segments.confusion(_cells(spark, sf_dir))
    names = spark.range(5).select(F.col("id").cast("int").alias("cls"), F.concat(F.lit("class "), "id").alias("name"))
    return segments.class_report(m, names).select("class", F.round("IoU", 6).alias("IoU"), F.round("ACC", 6).alias("ACC"))


@query(_ASSEMBLED + """
g as (select m.image, m.place, phrase, id::bigint as cid, n from named m join pixels using (image, place) join registry on key = trim(lower(replace(replace(replace(replace(replace(base, '-merged', ''), '-other', ''), '-stuff', ''), '-negative', ''), '-', ' '))))
select o_orderkey as image_id, o_orderkey || '.png' as file_name, coalesce(list([cid, n] order by place) filter (where cid is not null), []) as segments, coalesce(list(phrase order by place) filter (where cid is not null), []) as phrases, o_orderpriority as caption
from orders left join g on image = o_orderkey group by o_orderkey, o_orderpriority
""")
def panoptic_records(spark, sf_dir: str) -> DataFrame:
    """Annotation records of all images, as files have them."""
    s, _ = assembly.panoptic_segments(*_inputs(spark, sf_dir))
    names = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.concat("o_orderkey", F.lit(".png")).alias("file_name"), F.col("o_orderpriority").alias("caption"))
    a = segments.annotations(s, names)
    return a.select("image_id", "file_name", F.transform("segments_info", lambda e: F.array(e["category_id"], e["area"])).alias("segments"), F.col("gcg_phrases").alias("phrases"), F.col("gcg_caption").alias("caption"))


# ---- texts built from rows, and what must be found in them

_P = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"""
with b as (select {_P}, l_partkey % 100 / 100 as x, l_suppkey % 100 / 100 as y from lineitem)
select {_P}, 'dog' as label, 'nose' as name, round(least(x * 200, 199), 4) as px, round(least(y * 100, 99), 4) as py, case when l_linenumber % 2 = 0 then 'animal' else '' end as kind from b
union all select {_P}, 'dog', 'root of tail', least(l_partkey % 300 + 2, 199), least(l_suppkey % 300 + 2, 99), 'animal' from b where l_linenumber % 2 = 0
""")
def loose_keypoints(spark, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    body = F.format_string("<p>dog</p><ins>The  NOSE:<kpt>[%s, %s]</kpt> left hip [1,2,x]", (p % 100 / 100).cast("string"), (s % 100 / 100).cast("string"))
    tail = F.when(F.col("l_linenumber") % 2 == 0, F.format_string(" root of tail = [%d,%d]</ins>", p % 300 + 2, s % 300 + 2)).otherwise(" wing<kpt>[3,4]</kpt></ins>")
    l = l.select(*_P.split(", "), F.explode(loose.parse_loose_keypoints(F.concat(body, tail), F.lit(200), F.lit(100), F.lit(""))).alias("i"))
    l = l.select(*_P.split(", "), "i.label", "i.kind", F.explode("i.keypoints").alias("k"))
    return l.select(*_P.split(", "), "label", F.col("k.name").alias("name"), F.round(F.col("k.xy")[0], 4).alias("px"), F.round(F.col("k.xy")[1], 4).alias("py"), "kind")


@query(f"""
select {_P}, 'bbox' as kind, [20.0, 10.0, 20.0 + l_linenumber * 10, 60.0]::double[] as coords from lineitem
union all select {_P}, 'point', [least(l_partkey % 400 + 2, 199), 50.0]::double[] from lineitem
""")
def prompts_found(spark, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    q = F.format_string("in <BBOX>[20,10,%d,60]</bbox> and <point> [%d, 50] </point>, not <point>[1]</point>", F.lit(20) + F.col("l_linenumber") * 10, F.col("l_partkey") % 400 + 2)
    l = l.select(*_P.split(", "), F.explode(loose.visual_prompts(q, F.lit(200), F.lit(100))).alias("v"))
    return l.select(*_P.split(", "), "v.kind", "v.coords")


_VALUE = """'{"things": [[1, 2, 9, 9], [5, ' || n || ']], "deep": {"k": {"k": ' || n || '}}, "name": "' || w || '"}'"""


@query(f"""
with v as (select c_custkey as id, c_nationkey as n, c_mktsegment as w from customer)
select id, 'deep.k' as path, '{{"k":' || n || '}}' as value from v union all select id, 'deep.k.k', n::varchar from v
""")
def nested_keys(spark, sf_dir: str) -> DataFrame:
    """Members of the name k, at any depth."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.format_string('{"things": [[1, 2, 9, 9], [5, %d]], "deep": {"k": {"k": %d}}, "name": "%s"}', "c_nationkey", "c_nationkey", "c_mktsegment").alias("value"))
    return nested.find_key(c, "k").select("id", F.array_join("path", ".").alias("path"), "value")


@query("""
select c_custkey as id, 'things.0' as path, 'bbox' as kind, 'things' as label, 0 as color, [1.0, 2.0, 9.0, 9.0]::double[] as coords from customer
union all select c_custkey, 'things.1', 'point', 'things', 1, [5.0, c_nationkey]::double[] from customer
""")
def nested_primitives(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(200).alias("width"), F.lit(100).alias("height"), F.format_string('{"things": [[1, 2, 9, 9], [5, %d]], "deep": {"k": {"k": %d}}, "name": "%s"}', "c_nationkey", "c_nationkey", "c_mktsegment").alias("value"))
    return nested.primitives(c).select("id", F.array_join("path", ".").alias("path"), "kind", "label", "color", "coords")


@query("""
select n_regionkey as id, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int as place, n_nationkey::bigint as category_id, n_name as name, case when n_nationkey % 2 = 0 then 0 else 1 end as isthing from nation
""")
def category_metadata(spark, sf_dir: str) -> DataFrame:
    """Lists of objects and names, and what they say."""
    n = table(spark, sf_dir, "nation")
    entry = F.format_string('{"id": %d, "name": "%s", "isthing": %d}', F.col("n_nationkey"), F.col("n_name"), F.col("n_nationkey") % 2)
    lists = n.groupBy(F.col("n_regionkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("e")))).alias("e"))
    values = lists.select("id", F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["e"]), ","), F.lit("]")).alias("value"))
    return nested.categories(values)


# ---- samples of frames, positions, images that are sound


@query("""
with v as (select o_orderkey as video, (o_custkey % 40)::int as n from orders), i as (select unnest(range(8)) as i),
m as (select video, n, i, least(8, n) as k from v, i where n > 0),
e as (select video, i, floor(least(i, k - 1) * n / k) as lo, floor((least(i, k - 1) + 1) * n / k) - 1 as hi, least(i, k - 1) as j from m),
r as (select *, ('0x' || substr(md5('3:' || video || ':' || j), 1, 8))::bigint / 4294967296 as u from e),
g as (select video, list(floor((lo + hi) / 2)::int order by i) as middle, list((lo + floor(u * greatest(hi - lo + 1, 1)))::int order by i) as drawn from r group by 1)
select v.video, coalesce(middle, []) as middle, coalesce(drawn, []) as drawn,
  list_filter(list_transform(range(ceil(n / 10 / 0.5)::bigint), lambda k: round_even((0.25 + k * 0.5) * 10, 0)::int), lambda f: f < n)[1:5] as at_rate from v left join g using (video)
""")
def sampled_frames(spark, sf_dir: str) -> DataFrame:
    """Eight frames by intervals, middles and draws, and two a second at ten a second."""
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"), (F.col("o_custkey") % 40).cast("int").alias("n"))
    return v.select("video", mixture.interval_frames(F.col("n"), 8).alias("middle"), mixture.interval_frames(F.col("n"), 8, 3, "video").alias("drawn"), mixture.rate_frames(F.col("n"), F.lit(10), 2.0, 5).alias("at_rate"))


@query("""
with p as (select c_custkey, (c_nationkey % 5 + 1) as rows, (c_custkey % 4 + 1) as cols from customer)
select c_custkey, y * 16 + x as own, floor(y / rows * 16 + 1e-9)::int * 16 + floor(x / cols * 16 + 1e-9)::int as spread from p, lateral (select unnest(range(rows)) as y), lateral (select unnest(range(cols)) as x)
""")
def patch_positions(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    w, h = (F.col("c_custkey") % 4 + 1) * 14 + 3, (F.col("c_nationkey") % 5 + 1) * 14 + 5
    both = F.arrays_zip(boxes.patch_positions(w, h, 14, 16).alias("own"), boxes.patch_positions(w, h, 14, 16, True).alias("spread"))
    return c.select("c_custkey", F.explode(both).alias("p")).select("c_custkey", F.col("p.own").cast("long").alias("own"), F.col("p.spread").alias("spread"))


@query("""
with p as (select l_suppkey as image, l_orderkey, l_partkey, l_linenumber, l_extendedprice::double as depth, l_discount::double as d, l_tax::double as t from lineitem),
a as (select image from p group by 1 having avg((not (depth between 2000 and 90000))::int) <= 0.1), b as (select image from p group by 1 having avg((sqrt(d * d + t * t) < 0.02)::int) <= 0.12)
select l_orderkey, l_partkey, l_linenumber, image, image in (from a) as depth_sound, image in (from b) as normals_sound from p where image in (from a) or image in (from b)
""")
def sound_images(spark, sf_dir: str) -> DataFrame:
    """Images with few invalid depths, and those with few normals of no length."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), "l_orderkey", "l_partkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("depth"), F.array("l_discount", "l_tax").cast("array<double>").alias("n"))
    key = ["image", "l_orderkey", "l_partkey", "l_linenumber"]
    rules = {"depth_sound": (dense.sound_depth(F.col("depth"), 2000.0, 90000.0), 0.1), "normals_sound": (dense.usable_normal(F.col("n"), 0.02), 0.12)}
    sound = dense.soundness(l, ["image"], rules).where("depth_sound or normals_sound")
    # an image whose number is null is none
    return l.select(*key).join(sound, "image").select(*key[1:], "image", "depth_sound", "normals_sound")


@query(f"""
with {_CAM} select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(r21, 6) + 0.0 as m11, round(-r12, 6) + 0.0 as m22, round(r33, 6) + 0.0 as m33, round(-r21, 6) + 0.0 as back11, 510.0::double as fx, (480 - 200)::double as cx, (640 - 300)::double as back_cy from m
""")
def cameras_turned(spark, sf_dir: str) -> DataFrame:
    """Cameras of images turned by a quarter, either way."""
    c = _cameras(spark, sf_dir).withColumn("m", geo.matrix(F.col("q")))
    k = F.struct(*[F.lit(v).alias(n) for v, n in ((500.0, "fx"), (510.0, "fy"), (300.0, "cx"), (200.0, "cy"))])
    c = c.withColumn("k", k)
    (k1, m1), (k2, m2) = (geo.turned_camera(F.col("k"), F.col("m"), F.lit(640.0), F.lit(480.0), w) for w in (True, False))
    return c.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_shown(m11=m1[0], m22=m1[4], m33=m1[8], back11=m2[0]), k1["fx"].alias("fx"), k1["cx"].alias("cx"), k2["cy"].alias("back_cy"))


@query("""
with d as (select conv_id, turn, '<task: x>: find <p>cat</p> and <p>dog</p> ' || turn as t, md5('4-coin:' || conv_id || ':' || turn) as h, ('0x' || substr(md5('4-template:' || conv_id || ':' || turn), 1, 8))::bigint / 4294967296 as u from conversations)
select conv_id, turn, t as raw, 'find <p>cat</p> and <p>dog</p> ' || turn as plain,
  case when substr(h, 1, 1) < '8' then case when u < 0.5 then 'Please find cat, dog:' else 'Look.' end || ' ' else '' end || 'find <p>cat</p> and <p>dog</p> ' || turn as natural from d
""")
def task_prompts(spark, sf_dir: str) -> DataFrame:
    """Prompts with their task mark, without it, or with a template in its place."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("<task: x>: find <p>cat</p> and <p>dog</p> "), "turn").alias("t"))
    modes = {m: mixture.task_prompt(F.col("t"), m, ["Please find {categories}:", "Look."], 4, "conv_id", "turn") for m in ("raw", "plain", "natural")}
    return c.select("conv_id", "turn", *[v.alias(k) for k, v in modes.items()])
