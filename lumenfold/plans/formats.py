"""Rows written in the layouts of annotation files and read back, and functions of text on made answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..operators import joins, reports
from ..sources import arrays, layouts, records
from ..staging import folder
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


def _place(spark) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}"


def _boxes(spark, sf_dir: str) -> DataFrame:
    """Items with their place in the order's list."""
    key = F.struct("pos", "x", "y", "w", "h", "cat")
    r = box_rows(spark, sf_dir).groupBy("sample_id").agg(F.array_sort(F.collect_list(key)).alias("m")).select("sample_id", F.posexplode("m").alias("k", "m"))
    return r.select("sample_id", "k", "m.*")


def _docs(spark, sf_dir: str) -> DataFrame:
    """A document of each order: one image, its items as annotations, the last of three degenerate."""
    b = _boxes(spark, sf_dir)
    number = lambda c: F.when(F.col(c) == "A", 1).when(F.col(c) == "N", 2).otherwise(9)
    box = F.array(*[F.col(c).cast("double") for c in ("x", "y")], F.when(F.col("k") % 3 == 2, 0.0).otherwise(F.col("w").cast("double")), F.col("h").cast("double"))
    kpt = F.array(*[v.cast("double") for v in (F.col("x"), F.col("y"), F.col("pos") % 3, F.lit(0), F.lit(0), F.lit(2), F.col("w"), F.col("h"), F.lit(1))])
    ann = F.struct((F.col("sample_id") * 100 + F.col("k")).alias("id"), F.col("sample_id").alias("image_id"), number("cat").alias("category_id"), box.alias("bbox"), kpt.alias("keypoints"))
    d = b.groupBy("sample_id").agg(F.array_sort(F.collect_list(ann)).alias("annotations"))
    image = F.struct(F.col("sample_id").alias("id"), F.concat("sample_id", F.lit(".png")).alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    cats = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in ((1, "Big-Thing"), (2, "small-other"))])
    return d.select(F.array(image).alias("images"), "annotations", F.when(F.col("sample_id") % 1 == 0, cats).alias("categories"))


def _coco(spark, sf_dir: str) -> dict[str, DataFrame]:
    at = _place(spark)
    _docs(spark, sf_dir).write.json(at)
    t = records.coco_tables(records.read_lines(spark, at, records.COCO))
    return {**t, "categories": t["categories"].distinct()}


_K = f"{BOXES[: BOXES.index('pred as (')]} k as (select sample_id, gi - 1 as k, cat, x0, y0, x1, y1 from gt)"


@query(f"""
with {_K} select sample_id || '.png' as image_name, 640 as width, 480 as height, list([x0, y0, x1, y1] order by k) as boxes, list(case cat when 'A' then 'big thing' when 'N' then 'small' else '' end order by k) as phrases
from k where k % 3 <> 2 group by sample_id
""")
def coco_documents(spark, sf_dir: str) -> DataFrame:
    b = records.coco_boxes(_coco(spark, sf_dir))
    return b.select("image_name", "width", "height", F.transform("boxes", lambda x: x["bbox"]).alias("boxes"), F.transform("boxes", lambda x: x["phrase"]).alias("phrases"))


@query(f"""
with {_K}, a as (select sample_id, sample_id * 100 + k as id, x0, y0, x1 - x0 as w, y1 - y0 as h, row_number() over (partition by sample_id order by k) as r from k),
p as (select k.sample_id, sample_id * 100 + k as id, x0, y0, x1 - x0 as w, y1 - y0 as h, (h2.pos % 3) as v from k join (select sample_id as s, row_number() over (partition by sample_id order by pos, x, y, w, h, cat) - 1 as kk, pos from rows_) h2 on h2.s = sample_id and h2.kk = k)
select sample_id as image_id, id, 'a' as name, x0 as x, y0 as y from p where v > 0 and not (x0 <= 0 and y0 <= 0) union all select sample_id, id, 'c', w, h from p
""")
def coco_keypoint_documents(spark, sf_dir: str) -> DataFrame:
    """Visible keypoints; one is at the origin and never seen."""
    return records.coco_keypoints(_coco(spark, sf_dir), ("a", "b", "c"))


@query(f"with {_K} select sample_id * 100 + k as id, cat, [x0, y0, x1, y1] as box from k")
def huge_array(spark, sf_dir: str) -> DataFrame:
    """Annotations as one array of one JSON document, read by splits."""
    b = _boxes(spark, sf_dir)
    at = _place(spark)
    one = F.struct((F.col("sample_id") * 100 + F.col("k")).alias("id"), F.col("cat"), F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).cast("array<double>").alias("box"))
    # every part is a document of its own: an object with an array of the rows of a range of orders
    part = b.select(F.floor(F.col("sample_id") / 5000).alias("p"), F.to_json(one).alias("e")).groupBy("p").agg(F.array_join(F.collect_list("e"), ",\n").alias("e"))
    part.select(F.concat(F.lit('{"info": {"annotations": [0]}, "annotations": ['), "e", F.lit('], "licenses": [1]}')).alias("value")).write.option("lineSep", "\n").text(at)
    rows = arrays.read_array(spark, at, "annotations").where("not bad")
    return rows.select(F.from_json("value", "id long, cat string, box array<double>").alias("r")).select("r.*")


@query(f"with {_K} select sample_id || '.jpg' as image, k::int as pos, cat as phrase, [x0, y0, x1, y1] as bbox, 640 as width, 480 as height from k")
def unified_documents(spark, sf_dir: str) -> DataFrame:
    b, at = _boxes(spark, sf_dir), _place(spark)
    one = F.struct("k", F.struct(F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).cast("array<double>").alias("bbox"), F.col("cat").alias("phrase")).alias("b"))
    d = b.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda e: e["b"]).alias("boxes"))
    name = F.concat("sample_id", F.lit(".jpg"))
    d.select(F.when(F.col("sample_id") % 2 == 0, name).alias("image_name"), F.when(F.col("sample_id") % 2 == 1, name).alias("image_path"), F.struct(F.lit(640).alias("width"), F.lit(480).alias("height")).alias("image_info"), F.struct("boxes").alias("annotation")).write.json(at)
    return records.unified_boxes(records.read_json(spark, at, records.UNIFIED)).select("image", "pos", "phrase", "bbox", "width", "height")


@query(f"with {_K} select case cat when 'A' then 'cat' else 'dog' end as phrase, list_transform([(x0 + x1) / 2 - (x1 - x0) / 2, (y0 + y1) / 2 - (y1 - y0) / 2, (x0 + x1) / 2 + (x1 - x0) / 2, (y0 + y1) / 2 + (y1 - y0) / 2], lambda v: round(least(greatest(v / 200, 0), 0.999), 6)) as bbox from k where cat <> 'R'")
def yolo_lines(spark, sf_dir: str) -> DataFrame:
    """Lines of class, centre and size; one class has no name."""
    b, at = _boxes(spark, sf_dir), _place(spark)
    number = F.when(F.col("cat") == "A", 0).when(F.col("cat") == "N", 1).otherwise(7)
    part = [(F.col("x") + F.col("w") / 2) / 200, (F.col("y") + F.col("h") / 2) / 200, F.col("w") / 200, F.col("h") / 200]
    b.select(F.concat_ws(" ", number.cast("string"), *[p.cast("string") for p in part]).alias("value")).write.text(at)
    return records.yolo_boxes(spark, at, ("cat", "dog")).select("phrase", F.transform("bbox", lambda v: F.round(v, 6)).alias("bbox"))


@query("select c_name as name, c_custkey as id, [c_custkey, c_nationkey]::bigint[] as pair from customer")
def csv_payloads(spark, sf_dir: str) -> DataFrame:
    at = _place(spark)
    c = table(spark, sf_dir, "customer")
    c.select("c_name", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.array("c_custkey", "c_nationkey").alias("pair"), F.lit('say "x", y').alias("note"))).alias("p")).write.option("escape", '"').csv(at)
    return records.csv_with_json(spark, at, "id long, pair array<long>").select("name", "payload.id", "payload.pair")


@query(f"with {_K} select sample_id, [x0, y0, x1, y1] as bbox, cat as category from k")
def parquet_lists(spark, sf_dir: str) -> DataFrame:
    """Boxes and categories as lists side by side."""
    b, at = _boxes(spark, sf_dir), _place(spark)
    e = F.struct("k", F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).cast("array<double>").alias("b"), "cat")
    d = b.groupBy("sample_id").agg(F.array_sort(F.collect_list(e)).alias("e"))
    d.select("sample_id", F.transform("e", lambda x: x["b"]).alias("bbox"), F.transform("e", lambda x: x["cat"]).alias("category")).write.parquet(at)
    return records.parallel_lists(spark.read.parquet(at), ["sample_id"], "bbox", "category")


@query(f"with {_K} select sample_id, k::int as pos, cat as label, case when k % 2 = 0 then k else -1 end as score, 'none' as note from k")
def parquet_annotations(spark, sf_dir: str) -> DataFrame:
    """Lists of annotation structs, with defaults for what is null or lacking."""
    b, at = _boxes(spark, sf_dir), _place(spark)
    e = F.struct("k", F.col("cat").alias("label"), F.when(F.col("k") % 2 == 0, F.col("k").cast("long")).alias("score"))
    b.groupBy("sample_id").agg(F.array_sort(F.collect_list(e)).alias("e")).select("sample_id", F.transform("e", lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"))).alias("annotations")).write.parquet(at)
    return layouts.annotation_batches(spark, at, "annotations", {"score": -1, "note": "none"}).select("sample_id", "pos", "label", "score", "note")


@query(f"with {_K} select cat || ', with comma' as text, [x0, y0, x1, y0, x1, y1, x0, y1] as points, [x0, y0, x1, y1] as bbox from k where k % 4 <> 3")
def ocr_lines(spark, sf_dir: str) -> DataFrame:
    """Lines of four corners and a text; a quarter has a place that is no number."""
    b, at = _boxes(spark, sf_dir), _place(spark)
    x1, y1 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    first = F.when(F.col("k") % 4 == 3, "x").otherwise(F.col("x").cast("string"))
    b.select(F.concat_ws(",", first, *[c.cast("string") for c in (F.col("y"), x1, F.col("y"), x1, y1, F.col("x"), y1)], F.concat("cat", F.lit(", with comma"))).alias("value")).write.text(at)
    return layouts.text_boxes(spark, at, "quad_comma").select("text", "points", "bbox")


@query("select n_nationkey as id, n_name as name, n_regionkey as region from nation")
def gzipped_documents(spark, sf_dir: str) -> DataFrame:
    """Gzipped JSON arrays, one for each region."""
    at, n = _place(spark), table(spark, sf_dir, "nation")
    e = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    n.groupBy("n_regionkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(e), ","), F.lit("]")).alias("value")).select("value", "n_regionkey").repartition("n_regionkey").write.partitionBy("n_regionkey").option("compression", "gzip").text(at)
    return layouts.gzipped_json(spark, f"{at}/*", "id long, name string, region long").select("id", "name", "region")


@query(f"""
with {_K}, t as (select sample_id, cat, k, printf('<bbox>[%.3f, %.3f, %.3f, %.3f]</bbox>', least(x0 / 200, 0.999), least(y0 / 200, 0.999), least(x1 / 200, 0.999), least(y1 / 200, 0.999)) as b from k),
g as (select sample_id, cat, min(k) as f, '<p>' || cat || '</p>' || string_agg(b, '' order by k) as part from t group by sample_id, cat),
d as (select sample_id, string_agg(cat, ', ' order by f) as cats, string_agg(part, '' order by f) as answer from g group by 1)
select (row_number() over (order by lpad(sample_id::varchar, 9, '0')) - 1)::bigint as id, lpad(sample_id::varchar, 9, '0') as image, 'Find ' || cats as prompt, answer from d
""")
def instruction_records(spark, sf_dir: str) -> DataFrame:
    """Conversations with running ids, written, counted and read back."""
    b, at = _boxes(spark, sf_dir), _place(spark)
    flat = b.select(F.lpad(F.col("sample_id").cast("string"), 9, "0").alias("image"), F.lit(200).alias("width"), F.lit(200).alias("height"), F.col("k").alias("pos"), F.col("cat").alias("phrase"), F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).cast("array<double>").alias("bbox"))
    r = records.instructions(flat, F.lit("Find {categories}"))
    records.write_checked(r, at, box_rows(spark, sf_dir).select("sample_id").distinct().count())
    got = spark.read.schema(r.schema).json(at)
    return got.select("id", F.col("image")[0].alias("image"), F.col("conversations")[0]["value"].alias("prompt"), F.col("conversations")[1]["value"].alias("answer"))


@query("""
select o_orderkey, 'good' as side, null::bigint as id from orders where o_orderkey % 5 < 3 union all select o_orderkey, 'bad', null from orders where o_orderkey % 5 >= 3
union all select o_orderkey, 'numbered', row_number() over (order by o_orderkey % 2, o_orderkey) - 1 from orders
""")
def split_and_numbered(spark, sf_dir: str) -> DataFrame:
    """Accepted and rejected rows in two outputs, and ids that go on with the rows appended."""
    at, o = _place(spark), table(spark, sf_dir, "orders").select("o_orderkey")
    i = F.col("o_orderkey") % 5
    records.write_split(o, F.when(i != 4, i < 3), f"{at}/good", f"{at}/bad")
    for k in (0, 1):
        records.append_numbered(o.where(F.col("o_orderkey") % 2 == k), f"{at}/numbered", "o_orderkey")
    read = lambda n: spark.read.schema("o_orderkey long, id long").json(f"{at}/{n}").select("o_orderkey", F.lit(n).alias("side"), "id")
    return read("good").unionAll(read("bad")).unionAll(read("numbered"))


@query("select o_orderkey, 0 as same from orders")
def sharded_lines(spark, sf_dir: str) -> DataFrame:
    """JSON lines in numbered shards: every row once, equal keys in one shard."""
    at, o = _place(spark), table(spark, sf_dir, "orders").select("o_orderkey")
    layouts.write_shards(o.withColumn("k", F.col("o_orderkey") % 10), at, 4, "k")
    r = spark.read.schema("o_orderkey long, k long, shard string").json(at)
    spread = r.groupBy("k").agg((F.count_distinct("shard") - 1).cast("int").alias("same"))
    return r.join(spread, "k").select("o_orderkey", "same")


# ---- functions of text


_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _lines(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_ID.split(", "), "l_returnflag", "l_linestatus")


@query(f"""
select {_ID}, 'find ' || l_returnflag as bare, l_returnflag || ' and more' as untagged, [l_returnflag, l_linestatus, l_returnflag] as phrases, [l_partkey % 256, 7, 9]::bigint[] as reds,
  [l_linestatus, l_returnflag || '2'] as last_names, l_returnflag || '_' || l_linestatus || '__.png_' || substr(md5(l_returnflag || ' ' || l_linestatus || '/?.png'), 1, 8) as safe
from (select * from lineitem where l_partkey % 256 <> 7)
""")
def text_cleaning(spark, sf_dir: str) -> DataFrame:
    """Task marks, tags and colours, a colour's last phrase, file names."""
    l = _lines(spark, sf_dir).where("l_partkey % 256 <> 7")
    a, b, r = F.col("l_returnflag"), F.col("l_linestatus"), (F.col("l_partkey") % 256).cast("string")
    rich = F.concat(F.lit("<p>"), a, F.lit("</p> ("), r, F.lit(", 2,3) x <P> "), b, F.lit(" </P>(7 ,8,9) <p>"), a, F.lit("</p>(9,9,9)"))
    twice = F.concat(F.lit("<p>"), a, F.lit("1</p>(1,1,1)<p>"), b, F.lit("</p>(5,5,5)<p>"), a, F.lit("2</p>(1,1,1)"))
    c = text.colours(rich)
    return l.select(
        *_ID.split(", "), text.strip_task(F.concat(F.lit(" <task: det one>: find "), a)).alias("bare"), text.without_tags(F.concat(F.lit("<b>"), a, F.lit("</b> and more (1, 2,3)"))).alias("untagged"),
        F.transform(c, lambda e: e["phrase"]).alias("phrases"), F.transform(c, lambda e: e["r"].cast("long")).alias("reds"),
        F.transform(text.colour_map(twice), lambda e: e["phrase"]).alias("last_names"), text.safe_file_name(F.concat(a, F.lit(" "), b, F.lit("/?.png"))).alias("safe"),
    )


@query(f"""
select {_ID}, least(round(l_partkey % 1200 / 1000, 3), 0.999)::double as px, 0.25::double as py, [64.0, 48.0, 320.0, 240.0]::double[] as pixels, case when l_linenumber % 2 = 0 then -1.0 else 0.5 end::double as kx,
  [10.5, 20.0, 30.0, 40.0]::double[] as loose, l_linenumber % 3 > 0 and not (l_partkey % 2 = 0 and l_suppkey % 2 = 0) as visible
from lineitem
""")
def answer_parsers(spark, sf_dir: str) -> DataFrame:
    """Points, keypoints and loose boxes of answers, in pixels where asked."""
    l = _lines(spark, sf_dir)
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    pts = text.parse_points(F.concat(F.lit("<p>Cat-stuff</p><point>["), F.round(p % 1200 / 1000, 3).cast("string"), F.lit(", 0.25]</point>")))
    kpts = text.parse_keypoints(F.concat(F.lit("<p>man</p>left wrist<kpt>"), F.when(n % 2 == 0, "unvisible").otherwise("[0.5,0.5]"), F.lit("</kpt>")))
    rough = text.parse_loose_boxes(F.lit("so <BBOX> ( 10.5 20,30  40 ) </bbox>"))
    l = l.select(*_ID.split(", "), pts.alias("a"), kpts.alias("b"), rough.alias("c"))
    sized = boxes.pixels(F.array(*[F.lit(v) for v in (0.1, 0.1, 0.5, 0.5)]), F.lit(640.0), F.lit(480.0))
    return l.select(
        *_ID.split(", "), F.col("a")[0]["items"][0][0].alias("px"), F.col("a")[0]["items"][0][1].alias("py"), sized.alias("pixels"), F.col("b")[0]["x"].alias("kx"), F.col("c")[0].alias("loose"),
        boxes.keypoint_visible((p % 2).cast("double"), (s % 2).cast("double"), (n % 3).cast("double")).alias("visible"),
    )


@query("""
select c_custkey, case when c_custkey % 4 = 0 then null else c_acctbal::double end as number, map {'a': c_nationkey, 'b': c_custkey} as keys, case when c_custkey % 2 = 0 then 'val_bbox_ap' else 'val_ap' end as best from customer
""")
def table_values(spark, sf_dir: str) -> DataFrame:
    """Numbers of texts, keys in lower case (the last one stays), the best of several names."""
    c, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    shown = F.when(i % 4 == 0, F.element_at(F.array(*[F.lit(v) for v in ("nan", " None", "NULL ", "x1")]), (F.floor(i / 4) % 4 + 1).cast("int"))).otherwise(F.col("c_acctbal").cast("double").cast("string"))
    m = F.create_map(F.lit("A"), F.lit(-1).cast("long"), F.lit("b"), i, F.lit("a"), F.col("c_nationkey").cast("long"))
    names = F.when(i % 2 == 0, F.array(*[F.lit(v) for v in ("val_ap", "val_bbox_ap", "bbox")])).otherwise(F.array(F.lit("val_ap_long"), F.lit("val_ap"), F.lit("ap")))
    return c.select("c_custkey", reports.to_number(shown).alias("number"), text.lower_keys(m).alias("keys"), text.best_name(names, "val", ["bbox", "ap"]).alias("best"))


@query("select 'a/X' || o_orderkey || '.png' as image, case when o_orderkey % 3 = 0 then 'a/X' || o_orderkey || '.png' else 'm/x' || o_orderkey || '.PNG' end as mask from orders where o_orderkey % 5 <> 0")
def masks_by_name(spark, sf_dir: str) -> DataFrame:
    """Images and masks paired by path, else by a name that only they have; every fifth mask is missing."""
    o, i = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    image = o.select(F.concat(F.lit("a/X"), i, F.lit(".png")).alias("path"))
    mask = o.where(i % 5 != 0).select(F.when(i % 3 == 0, F.concat(F.lit("a/X"), i, F.lit(".png"))).otherwise(F.concat(F.lit("m/x"), i, F.lit(".PNG"))).alias("path"))
    return joins.paired_by_name(image, mask)
