"""Neighbourhood queries: events are pixels of images of 20 by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stencil
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


#: Tiles that cut the small images, so that neighbours meet over edges.
TILE = 8


def _pixels(spark, sf_dir: str) -> DataFrame:
    """A quarter of depths is steeper, one in thirteen is missing."""
    i, u = F.col("event_id"), F.col("user_id")
    depth = (F.lit(2) + (i % 20) / 10 + F.when(u % 4 == 0, 1.0).otherwise(0.0) + (u % 5) / 100).cast("double")
    return table(spark, sf_dir, "events").select(F.floor(i / 400).alias("image"), (i % 20).alias("x"), (F.floor(i / 20) % 20).alias("y"), F.when(u % 13 != 0, depth).alias("depth"), ((u % 100) / 100).alias("a"), ((u % 100) / 200 + (i % 7) / 20).alias("b"))


_PX = """
px as (
  select event_id // 400 as image, event_id % 20 as x, (event_id // 20) % 20 as y, case when user_id % 13 <> 0 then 2 + (event_id % 20) / 10 + case when user_id % 4 = 0 then 1.0 else 0.0 end + (user_id % 5) / 100 end::double as depth,
    ((user_id % 100) / 100)::double as a, ((user_id % 100) / 200 + (event_id % 7) / 20)::double as b from events),
st as (select unnest(range(-1, 2)) as s)
"""


@query(f"""
with {_PX}, w as (select p.image, p.x, p.y, p.depth, max(q.depth) as hi, min(q.depth) as lo from px p join px q on q.image = p.image and abs(q.x - p.x) <= 1 and abs(q.y - p.y) <= 1 where p.depth is not null group by all)
select image, x, y, hi - lo > 0.6 or (hi - lo) / depth > 0.4 as edge, least(hi - depth, depth - lo) > 0.6 or least(hi - depth, depth - lo) / depth > 0.4 as aliased from w
""")
def depth_edges(spark, sf_dir: str) -> DataFrame:
    return stencil.depth_edges(_pixels(spark, sf_dir), ["image"], 0.6, 0.4, tile=TILE)


def _cross(u: str, v: str) -> str:
    return f"[{u}[2] * {v}[3] - {u}[3] * {v}[2], {u}[3] * {v}[1] - {u}[1] * {v}[3], {u}[1] * {v}[2] - {u}[2] * {v}[1]]"


def _step(dx: int, dy: int, name: str) -> str:
    return f"left join pt {name} on {name}.image = p.image and {name}.x = p.x + {dx} and {name}.y = p.y + {dy}"


@query(f"""
with {_PX}, pt as (select image, x, y, [x * 0.5, y * 0.5, depth]::double[] as v from px where depth is not null),
n as (
  select p.image, p.x, p.y, {", ".join(f"list_transform([1, 2, 3], lambda i: {s}.v[i] - p.v[i]) as d{s}" for s in "uldr")}
  from pt p {_step(0, -1, "u")} {_step(-1, 0, "l")} {_step(0, 1, "d")} {_step(1, 0, "r")}),
c as (select image, x, y, unnest([{", ".join(_cross("d" + a, "d" + b) for a, b in ("ul", "ld", "dr", "ru"))}]) as c from n),
s as (
  select image, x, y, {", ".join(f"sum(c[{i}] / (sqrt(c[1] ** 2 + c[2] ** 2 + c[3] ** 2) + 1e-12)) as s{i}" for i in (1, 2, 3))} from c where c[1] is not null and c[2] is not null and c[3] is not null group by all)
select image, x, y, {", ".join(f"round(s{i} / (sqrt(s1 ** 2 + s2 ** 2 + s3 ** 2) + 1e-12), 6) + 0.0 as n{k}" for i, k in ((1, "x"), (2, "y"), (3, "z")))} from s
""")
def depth_normals(spark, sf_dir: str) -> DataFrame:
    """Normals of the points that a depth image stands for."""
    p = _pixels(spark, sf_dir).where("depth is not null").select("image", "x", "y", (F.col("x") * 0.5).alias("px"), (F.col("y") * 0.5).alias("py"), F.col("depth").alias("pz"))
    out = stencil.normals(p, ["image"], tile=TILE)
    return out.select("image", "x", "y", *[(F.round(c, 6) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


@query(f"""
with {_PX}, k as (select i, exp(-((i / 1.5) ** 2) / 2) / sum(exp(-((i / 1.5) ** 2) / 2)) over () as w from range(-5, 6) t(i)),
m as (
  select p.image, p.x, p.y, count(*) as n, sum(kx.w * ky.w * q.a) as ma, sum(kx.w * ky.w * q.b) as mb, sum(kx.w * ky.w * q.a * q.a) as aa, sum(kx.w * ky.w * q.b * q.b) as bb, sum(kx.w * ky.w * q.a * q.b) as ab
  from px p, k kx, k ky, px q where q.image = p.image and q.x = p.x + kx.i and q.y = p.y + ky.i group by all),
s as (select image, (2 * ma * mb + 1e-4) * (2 * (ab - ma * mb) + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (aa - ma * ma + bb - mb * mb + 9e-4)) as v from m where n = 121)
select image, round(avg(v), 6) as ssim, count(*) as windows from s group by image
""")
def image_ssim(spark, sf_dir: str) -> DataFrame:
    """Structural similarity of two images."""
    return stencil.structural_similarity(_pixels(spark, sf_dir), ["image"], tile=TILE).withColumn("ssim", F.round("ssim", 6))
