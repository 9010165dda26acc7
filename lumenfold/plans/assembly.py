"""Segments from colour masks and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assembly
from ..staging import staged
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


_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
_PHRASE = "p_name || case l_partkey % 4 when 0 then '-stuff' when 1 then '' else '-other' end || case when l_linenumber % 3 = 0 then '' else '-' || cast(l_suppkey % 3 as {text}) end"
_RGB = ("(40 + l_linenumber * 37) % 256", "l_partkey * 11 % 256", "l_suppkey * 29 % 256")


def _inputs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An order is an image, its items are the caption's phrases; one in five has no pixels. Parts meet items
    by a shuffle, once: their file is small for its rows, which all would go through the driver else."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    l = l.select(F.col("l_orderkey").alias("image"), *_ORDER, F.expr(_PHRASE.format(text="string")).alias("phrase"), *[F.expr(e).cast("int").alias(c) for e, c in zip(_RGB, "rgb", strict=True)])
    span = F.concat(F.lit("<p> "), "phrase", F.lit("<color>("), F.concat_ws(" , ", "r", "g", "b"), F.lit(")</color></p>"))
    colour = lambda r, g, b, n: F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"), n.cast("long").alias("n"))
    seen = F.when(F.expr("l_partkey % 5 <> 0"), colour(F.least(F.lit(255), F.col("r") + F.col("l_partkey") % 7), F.col("g"), F.col("b"), F.col("l_quantity")))
    n = F.count("*")
    images = l.groupBy("image").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*_ORDER, span.alias("span")))), lambda e: e["span"]), " beside ").alias("caption"),
        F.concat(F.collect_list(seen), F.array(*[colour(F.lit(v), F.lit(v), F.lit(v), n) for v in (0, 128)])).alias("colours"),
    )
    images = staged(images, "images")
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.format_string("<P>%s</P> or <p>x<color>(1,2,3)</color></p>", "o_orderpriority").alias("question")).hint("merge")
    colours = images.select("image", F.explode("colours").alias("c")).select("image", "c.*")
    return images.select("image", "caption").join(asked, "image", "left"), colours, table(spark, sf_dir, "part").where("p_partkey < 3").select((F.col("p_partkey") + 1).alias("id"), F.col("p_name").alias("name"))


def _key(name: str) -> str:
    return f"trim(lower(replace(replace(replace(replace(replace({name}, '-merged', ''), '-other', ''), '-stuff', ''), '-negative', ''), '-', ' ')))"


_SQL = f"""
with recursive phrases as (
  select l_orderkey as image, (row_number() over (partition by l_orderkey order by {", ".join(_ORDER)}) - 1)::int as place,
    {_PHRASE.format(text="varchar")} as phrase, {", ".join(f"{e} as {c}" for e, c in zip(_RGB, "rgb", strict=True))}, l_partkey, l_quantity
  from lineitem join part on l_partkey = p_partkey),
named as (
  select *, case when regexp_matches(phrase, '-[0-9]+$') then regexp_replace(phrase, '-[0-9]+$', '') else phrase end as base,
    case when regexp_matches(phrase, '-[0-9]+$') then regexp_extract(phrase, '([0-9]+)$', 1)::bigint end as local from phrases),
names as (
  select base as name, image, 1 as stage, place from named
  union all select o_orderpriority, o_orderkey, 0, 0 from orders where o_orderkey in (select image from phrases)),
known as (select {_key("p_name")} as key, max(p_partkey + 1) as id from part where p_partkey < 3 group by 1),
firsts as (select {_key("name")} as key, min((image, stage, place, name)) as f from names group by 1),
registry as (
  select key, id from known
  union all select key, (select max(id) from known) + row_number() over (order by f) from firsts where key not in (select key from known)),
cells as (
  select image, least(255, r + l_partkey % 7) as r, g, b, l_quantity::bigint as n from phrases where l_partkey % 5 <> 0
  union all select image, v, v, v, count(*) from phrases, (select unnest([0, 128]) as v) group by image, v),
gaps as (
  select c.image, c.r, c.g, c.b, c.n, p.place, (c.r - p.r) ** 2 + (c.g - p.g) ** 2 + (c.b - p.b) ** 2 as d, row_number() over (partition by c.image, c.rn order by (c.r - p.r) ** 2 + (c.g - p.g) ** 2 + (c.b - p.b) ** 2, place) as k
  from (select *, row_number() over (partition by image order by r, g, b, n) as rn from cells) c join phrases p using (image)),
pixels as (select image, place, sum(n)::bigint as n from gaps where k = 1 and r + g + b > 0 and d <= r ** 2 + g ** 2 + b ** 2 group by all),
"""


@query(_SQL + """
segs as (
  select m.image, m.place, phrase, id as cat, local, n, row_number() over (partition by m.image order by m.place) as j
  from named m join pixels using (image, place) join registry on key = """ + _key("base") + """),
walk as (
  select image, 0::bigint as j, []::struct(place int, phrase varchar, cat bigint, id bigint, n bigint)[] as done from segs group by image
  union all
  select image, j, list_append(done, {'place': place, 'phrase': phrase, 'cat': cat,
    'id': list_min(list_filter(range(start, start + len(done) + 1), lambda x: not list_contains(list_transform(done, lambda e: e.id), x))), 'n': n})
  from (select w.image, s.j, done, place, phrase, s.cat, n, s.cat * 1000 + coalesce(local, list_max(list_transform(list_filter(done, lambda e: e.cat = s.cat), lambda e: e.id - e.cat * 1000 + 1)), 0) as start
    from walk w join segs s on s.image = w.image and s.j = w.j + 1)),
ends as (select image, unnest(done) as e from walk where j = (select max(j) from segs s where s.image = walk.image))
select image, e.place as place, e.phrase as phrase, e.cat as category_id, e.id as id, e.id - e.cat * 1000 as local, e.n as n from ends
""")
def panoptic_assembly(spark, sf_dir: str) -> DataFrame:
    """Segments of every image, with ids of open categories."""
    return assembly.panoptic_segments(*_inputs(spark, sf_dir))[0]


@query(_SQL + "e as (select 1) select key, id::bigint as id from registry")
def open_categories(spark, sf_dir: str) -> DataFrame:
    """Known categories and those that captions and questions name, by first appearance."""
    return assembly.panoptic_segments(*_inputs(spark, sf_dir))[1].select("key", "id")


@query(_SQL + "e as (select 1) select image, place, phrase, r::int as r, g::int as g, b::int as b, n from named join pixels using (image, place)")
def grounded_phrases(spark, sf_dir: str) -> DataFrame:
    captions, colours, _ = _inputs(spark, sf_dir)
    return assembly.grounded_segments(captions, colours)
