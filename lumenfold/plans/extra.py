"""Pixels, cameras, sequence positions and sampling rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import boxes, text
from ..functions import geometry as geo
from ..functions.binding import let
from ..operators import dense, mixture, packing
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


#: A palette of four colours; black is background.
PALETTE = ((0, 0, 0), (220, 20, 60), (0, 130, 200), (60, 180, 75))


@query(f"""
with p as (select * from (values {", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTE))}) t(k, r, g, b)),
e as (select event_id, (user_id * 7 % 256)::int as r, (event_id * 13 % 256)::int as g, (event_id % 251)::int as b from events)
select event_id, (arg_min(k, ((e.r - p.r) ** 2 + (e.g - p.g) ** 2 + (e.b - p.b) ** 2) * 10 + k))::int as cls, (any_value(e.r) + 256 * any_value(e.g) + 65536 * any_value(e.b))::bigint as id from e, p group by event_id
""")
def colour_to_class(spark, sf_dir: str) -> DataFrame:
    """The nearest colour of a small palette, ties to the first, without a join: the palette is a literal."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 7 % 256).cast("int").alias("r"), (F.col("event_id") * 13 % 256).cast("int").alias("g"), (F.col("event_id") % 251).cast("int").alias("b"))
    near = [F.struct(sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip("rgb", rgb, strict=True)), F.lit(0)).alias("d"), F.lit(k).alias("k")) for k, rgb in enumerate(PALETTE)]
    return e.select("event_id", F.least(*near)["k"].alias("cls"), text.id_of_rgb(F.col("r"), F.col("g"), F.col("b")).alias("id"))


@query("""
with l as (select n_nationkey as old, row_number() over (order by n_nationkey) - 1 as new from nation where n_regionkey <> 0)
select c_custkey, coalesce(new, 255)::int as cls from customer left join l on old = c_nationkey
""")
def label_remap(spark, sf_dir: str) -> DataFrame:
    """Labels to contiguous numbers, what is ignored to 255."""
    l = table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("c_nationkey"), (F.row_number().over(Window.orderBy("n_nationkey")) - 1).alias("new"))
    return table(spark, sf_dir, "customer").join(l, "c_nationkey", "left").select("c_custkey", F.coalesce("new", F.lit(255)).alias("cls"))


@query("""
with d as (select l_suppkey as sample, l_orderkey, l_linenumber, l_partkey, l_extendedprice::double as depth from lineitem),
r as (select sample, 1 / max(depth) as lo, 1 / min(depth) as hi from d where depth > 0 group by 1)
select sample, l_orderkey, l_linenumber, l_partkey, round(coalesce((1 / depth - lo) / nullif(hi - lo, 0), 0), 6) as share from d join r using (sample)
""")
def inverse_depth(spark, sf_dir: str) -> DataFrame:
    """Inverse depth over each sample's own range of it."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("double").alias("depth"))
    r = d.where("depth > 0").groupBy("sample").agg((1 / F.max("depth")).alias("lo"), (1 / F.min("depth")).alias("hi"))
    share = F.coalesce(F.try_divide(1 / F.col("depth") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return d.join(r, "sample").select("sample", "l_orderkey", "l_linenumber", "l_partkey", F.round(share, 6).alias("share"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 640)::double as u, (l_suppkey % 480)::double as v, round((l_partkey % 640 - 320.0) / 500 * (l_quantity::double + 1), 9) as x from lineitem")
def unproject_project(spark, sf_dir: str) -> DataFrame:
    """Pixels to camera points and back."""
    l = table(spark, sf_dir, "lineitem")
    u, v, z = (F.col("l_partkey") % 640).cast("double"), (F.col("l_suppkey") % 480).cast("double"), F.col("l_quantity").cast("double") + 1
    k = [F.lit(x) for x in (500.0, 500.0, 320.0, 240.0)]
    p = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geo.unproject(u, v, z, *k).alias("p"))
    q = geo.project(F.col("p"), *k)
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(q[0], 6).alias("u"), F.round(q[1], 6).alias("v"), F.round(F.col("p")[0], 9).alias("x"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, 0.0::double as turned, 0.0::double as moved from lineitem")
def pose_round_trip(spark, sf_dir: str) -> DataFrame:
    """Quaternion to matrix and back, and a pose after its own inverse: nothing is left."""
    l = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        geo.unit(F.array(F.col("l_partkey") % 7 + 1, F.col("l_suppkey") % 5, F.col("l_linenumber"), F.col("l_partkey") % 3).cast("array<double>")).alias("q"),
        F.array(F.col("l_partkey") % 13, F.col("l_suppkey") % 11, F.col("l_linenumber")).cast("array<double>").alias("t"),
    )
    r = l.withColumn("m", geo.matrix(F.col("q")))
    back = geo.quaternion(F.col("m"))
    mi, ti = geo.inverse_pose(F.col("m"), F.col("t"))
    left = geo.add(geo.rotate(mi, F.col("t")), ti)
    turned = let(back, lambda b: F.greatest(*[F.abs(b[i] - F.col("q")[i]) for i in range(4)]))
    left = let(left, lambda v: F.array(F.sqrt(geo.dot(v, v, 3))))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.abs(F.round(turned, 6)).alias("turned"), F.abs(F.round(left[0], 6)).alias("moved"))


@query("""
with s as (select doc_id, n_chars, lead(doc_id) over (partition by source order by doc_id) as nxt, coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as offset_ from documents)
select doc_id, offset_ as "offset", round(1.0 / nullif(n_chars, 0), 9) as per_sample, round(1.0 / sqrt(nullif(n_chars, 0)), 9) as per_root from s
""")
def pack_offsets_and_weights(spark, sf_dir: str) -> DataFrame:
    """Running offset of each sample in its pack, and loss weights 1/n and 1/sqrt(n)."""
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("n_chars").cast("double")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.sum("n_chars").over(w), F.lit(0)).alias("offset"), F.round(packing.loss_weight(n, "sample"), 9).alias("per_sample"), F.round(packing.loss_weight(n, "square"), 9).alias("per_root"))


@query("select doc_id, md5('11:' || doc_id)[1:1] < '8' as plain, ['a {x}', 'b {x}', 'c'][1 + floor(('0x' || md5('12:' || doc_id)[1:8])::bigint / 4294967296 * 3)::int] as template from documents")
def prompt_choice(spark, sf_dir: str) -> DataFrame:
    """A coin and one of several templates by hash of the row's key."""
    t = F.array(*[F.lit(x) for x in ("a {x}", "b {x}", "c")])
    return table(spark, sf_dir, "documents").select("doc_id", mixture.coin(11, "doc_id").alias("plain"), mixture.choose(t, 12, "doc_id").alias("template"))


@query("select page_id, not regexp_matches(p, '^/|(^|/)\\.\\.(/|$)|://') and p <> '' as safe from (select page_id, case page_id % 4 when 0 then url when 1 then 'a/../b' when 2 then 'a/b..c' else '/abs' end as p from pages)")
def safe_paths(spark, sf_dir: str) -> DataFrame:
    p = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, "a/../b").when(F.col("page_id") % 4 == 2, "a/b..c").otherwise("/abs")
    return table(spark, sf_dir, "pages").select("page_id", text.safe_path(p).alias("safe"))


@query("select event_id, case when event_id % 2 = 0 then event_type else event_type || '-x' end as name, case when event_id % 2 = 0 then (user_id % 9)::int end as \"index\", (event_id % 100)::int as frame from events")
def name_index_split(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.when(F.col("event_id") % 2 == 0, F.concat_ws("-", "event_type", (F.col("user_id") % 9).cast("string"))).otherwise(F.concat("event_type", F.lit("-x")))
    f = F.concat(F.lit("frame"), (F.col("event_id") % 100).cast("string"), F.lit(".png"))
    return e.select("event_id", text.name_index(n)["name"].alias("name"), text.name_index(n)["index"].alias("index"), text.frame_number(f).alias("frame"))


@query("select user_id, value as scale from (select user_id, value, row_number() over (partition by user_id order by value desc, event_id) as r, count(*) over (partition by user_id) as n from events) where r = greatest(1, ceil(n * 0.05))")
def robust_scale(spark, sf_dir: str) -> DataFrame:
    """The value that a twentieth of a group's values reach."""
    w = Window.partitionBy("user_id")
    r = table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(w.orderBy(F.desc("value"), "event_id")).alias("r"), F.count("*").over(w).alias("n"))
    return r.where(F.col("r") == F.greatest(F.lit(1), F.ceil(F.col("n") * 0.05))).select("user_id", F.col("value").alias("scale"))


@query("select source, doc_id, epoch::int as epoch from (select source, doc_id, n, w, row_number() over (partition by source order by md5('4:' || doc_id), doc_id) - 1 as a from (select source, doc_id, count(*) over (partition by source) as n, case source when 'src1' then 150 when 'src2' then 50 end as w from documents)), range(400) e(epoch) where w is not null and epoch * n + a < w")
def mixture_quotas(spark, sf_dir: str) -> DataFrame:
    """Two hundred samples at three to one, a small source going round again."""
    return mixture.quotas(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", {"src1": 3.0, "src2": 1.0}, 200, 4, "doc_id").select("source", "doc_id", "epoch")


@query("""
select label as sample, round(10 * log10(1 / nullif(avg((embedding[1]::double - embedding[2]::double) ** 2), 0)), 6) as psnr from embeddings group by 1
""")
def psnr(spark, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    p = table(spark, sf_dir, "embeddings").select(F.col("label").alias("sample"), v[0].alias("gt"), v[1].alias("pred"))
    return dense.psnr(p).select("sample", F.round("psnr", 6).alias("psnr"))


@query("""
select o_orderkey, [x0, y0, x1, y1] as box from (select o_orderkey, least(greatest(a * 100, 0), 100) as x0, least(greatest(b * 50, 0), 50) as y0, least(greatest(c * 100, 0), 100) as x1, least(greatest(d * 50, 0), 50) as y1
  from (select o_orderkey, o_custkey % 8 / 8 as a, o_orderkey % 8 / 8 as b, o_custkey % 8 / 8 + 0.25 as c, o_orderkey % 4 / 4 as d from orders)) where x1 > x0 and y1 > y0
""")
def auto_scaled_boxes(spark, sf_dir: str) -> DataFrame:
    """Normalised or pixel boxes, told apart by their size; those without extent go."""
    a, b = F.col("o_custkey") % 8 / 8, F.col("o_orderkey") % 8 / 8
    box = F.array(a, b, a + 0.25, F.col("o_orderkey") % 4 / 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", boxes.auto_scaled(box, F.lit(100.0), F.lit(50.0)).alias("box")).where("box is not null")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, [a, b, a + 3, b + 4]::double[] as box, 6.0::double as area from (select *, (l_partkey % 50)::double as a, (l_suppkey % 50)::double as b from lineitem)")
def polygon_boxes(spark, sf_dir: str) -> DataFrame:
    """Box and area of triangles."""
    a, b = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 50).cast("double")
    p = F.array(a, b, a + 3, b, a + 3, b + 4)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", boxes.polygon_box(p).alias("box"), boxes.polygon_area(p).alias("area"))
