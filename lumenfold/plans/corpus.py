"""Text, annotation, mixture, packing and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import mixture, packing, reports
from ..operators.numbering import dense_ids
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


# ---- conversations


@query("""
select conv_id, max_by(text, turn) filter (where role = 'assistant') as answer, max_by(text, turn) filter (where role = 'user') as prompt
from conversations group by conv_id
""")
def conv_last_turn(spark, sf_dir: str) -> DataFrame:
    """The last answer is the truth, the last question the prompt."""
    of = lambda r: F.max_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(of("assistant").alias("answer"), of("user").alias("prompt"))


@query("select case role when 'user' then 'human' when 'assistant' then 'gpt' else role end as \"from\", count(*) as turns, sum(length(text))::bigint as chars from conversations group by 1")
def conv_roles(spark, sf_dir: str) -> DataFrame:
    names = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.coalesce(names[F.col("role")], "role").alias("from")).agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("""
with m as (select conv_id, turn, replace(text, ' the ', ' <image> ') as t from conversations)
select conv_id, turn, (len(string_split(t, '<image>')) - 1)::int as marks, string_split(t, '<image>')[1] as head, length(repeat('<image>', greatest(3 - (len(string_split(t, '<image>')) - 1), 0)) || t)::int as padded from m
""")
def conv_split_placeholders(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("t", F.replace("text", F.lit(" the "), F.lit(" <image> ")))
    t = F.col("t")
    return c.select("conv_id", "turn", text.mark_count(t, "<image>").alias("marks"), text.split_marks(t, "<image>")[0].alias("head"), F.length(text.with_marks(t, "<image>", F.lit(3))).alias("padded"))


# ---- tags


def _tagged(spark, sf_dir: str) -> DataFrame:
    """Answers with one or two boxes of quarters and eighths; every third repeats its label."""
    l = table(spark, sf_dir, "lineitem")
    n = lambda c, k: ((F.col(c) % k) / k)
    box = F.concat(F.lit("<bbox>["), n("l_partkey", 8).cast("string"), F.lit(", "), n("l_suppkey", 8).cast("string"), F.lit(", 1.0, 0.5]</bbox>"))
    again = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("<p>Cat-"), F.col("l_returnflag"), F.lit("</p><bbox>[0.25,0.5,0.75,1.5]</bbox>"))).otherwise(F.lit(""))
    t = F.concat(F.lit("<p>Cat-"), F.col("l_returnflag"), F.lit("</p>"), box, F.lit("<bbox>[bad]</bbox>"), again)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", t.alias("t"))


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'cat ' || lower(l_returnflag) as label, 1 as boxes,
  case when l_linenumber % 3 = 0 then 0.25 else l_partkey % 8 / 8 end as x0, case when l_linenumber % 3 = 0 then 0.5 else l_suppkey % 8 / 8 end as y0,
  case when l_linenumber % 3 = 0 then 0.75 else 0.999 end::double as x1, case when l_linenumber % 3 = 0 then 0.999 else 0.5 end::double as y1 from lineitem
""")
def tag_parse_boxes(spark, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir).withColumn("e", F.explode(text.parse_boxes(F.col("t"))))
    b = F.col("e.items")[0]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("e.label").alias("label"), F.size("e.items").alias("boxes"), *[b[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber % 3 = 0 then 2 else 1 end as n, 'Cat-' || l_returnflag as first from lineitem
""")
def tag_phrases(spark, sf_dir: str) -> DataFrame:
    p = text.phrases(F.col("t"))
    return _tagged(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size(p).alias("n"), p[0].alias("first"))


@query("""
select p_partkey, '<p>x</p><bbox>[' || printf('%.3f', p_partkey % 16 / 16) || ', ' || printf('%.3f', p_partkey % 7 / 7) || ', ' || printf('%.3f', p_partkey % 1000 / 1000) || ', 0.500]</bbox>' as t from part
""")
def tag_render_boxes(spark, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    b = F.array(p % 16 / 16, p % 7 / 7, p % 1000 / 1000, F.lit(0.5))
    return table(spark, sf_dir, "part").select("p_partkey", text.render_boxes(F.array(F.struct(F.lit("x").alias("label"), F.array(b).alias("items")))).alias("t"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 1000 - 500) / 1000 as w, (l_suppkey % 1000) / 1000 as x from lineitem")
def pose_tokens(spark, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    t = F.concat(text.pose_token((F.col("l_partkey") % 1000 - 500) / 1000), text.pose_token((F.col("l_suppkey") % 1000) / 1000))
    v = text.parse_pose(t)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v[0].alias("w"), v[1].alias("x"))


# ---- names


@query("select p_partkey, trim(lower(replace(replace(replace(replace(replace(p_name || '-merged', '-merged', ''), '-other', ''), '-stuff', ''), '-negative', ''), '-', ' '))) as name, regexp_replace(lower(p_name), '[^\\p{L}]', '', 'g') as letters, replace(replace(lower(p_name), '_', ''), ' ', '') as joined from part")
def category_normalize(spark, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_category(F.concat(n, F.lit("-merged"))).alias("name"), text.letters_only(n).alias("letters"), text.without_separators(n).alias("joined"))


@query("select c_custkey, regexp_replace(c_name, '[0-9]+$', '') as stem from customer")
def trailing_digits(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.strip_digits(F.col("c_name")).alias("stem"))


@query(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents")
def whitespace_collapse(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse_space(F.col("text")).alias("t"))


@query(r"select doc_id, array_to_string(regexp_split_to_array(trim(text), '\s+')[1:200], ' ') as t from documents")
def caption_truncate(spark, sf_dir: str) -> DataFrame:
    """The first 200 words, the operator's own limit."""
    return table(spark, sf_dir, "documents").select("doc_id", text.first_words(F.col("text"), 200).alias("t"))


@query("select page_id, regexp_extract(url, '[^/]*$') as base, md5(url)[1:8] as tag, (('0x' || md5(url)[1:8])::bigint % 21)::int as colour from pages")
def path_basename(spark, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.base_name(u).alias("base"), F.substring(F.md5(u.cast("binary")), 1, 8).alias("tag"), text.palette_index(u, 21).alias("colour"))


# ---- joins of annotations


@query("""
select o_orderkey, count(*) as boxes, list(l_linenumber order by l_linenumber) as lines, list(distinct l_returnflag order by l_returnflag) as cats
from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey
""")
def coco_join_group(spark, sf_dir: str) -> DataFrame:
    """Images with their annotations; images without any are left out."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("boxes"), F.array_sort(F.collect_list("l_linenumber")).alias("lines"), F.array_sort(F.collect_set("l_returnflag")).alias("cats"))
    return table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "boxes", "lines", "cats")


@query("""
select r_name, n_name, count(distinct c_custkey) as customers, count(o_orderkey) as orders, coalesce(sum(floor(o_totalprice)), 0)::bigint as total from region join nation on n_regionkey = r_regionkey
left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by all
""")
def star_index(spark, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice")).alias("s"))
    c = t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("n").alias("orders"), F.sum("s").alias("total"))
    n = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return n.select("r_name", "n_name", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("customers", "orders", "total")])


@query("select c_custkey, 'no urgent order' as why from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_orderpriority = '1-URGENT') union all select s_suppkey, 'no item' from supplier where s_suppkey not in (select l_suppkey from lineitem where l_suppkey is not null)")
def anti_join_names(spark, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    a = t("customer").join(t("orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", F.lit("no urgent order").alias("why"))
    return a.unionAll(t("supplier").join(t("lineitem"), F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey", F.lit("no item")))


@query("with v as (select l_orderkey as video, list(l_quantity::int order by l_linenumber, l_quantity) as track from lineitem group by 1) select video, unnest(range(len(track)))::int as frame, unnest(track) as seg from v")
def track_explode(spark, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video"), F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")).alias("s"))
    return l.groupBy("video").agg(F.array_sort(F.collect_list("s")).alias("t")).select("video", F.posexplode(F.transform("t", lambda s: s["q"])).alias("frame", "seg"))


# ---- frames


@query("""
with f as (select user_id as seq, row_number() over (partition by user_id order by event_id) - 1 as frame from events),
c as (select a.seq, a.frame, b.frame as near, md5('7:' || a.seq || ':' || a.frame || ':' || b.frame) as h from f a join f b on a.seq = b.seq and a.frame <> b.frame and abs(a.frame - b.frame) <= 3)
select seq, frame::int as frame, (list(near::int order by h))[1:2] as near from c group by seq, frame
""")
def nearby_frames(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("frame"))
    return mixture.nearby(e, 3, 2, 7)


@query("""
select n, list_transform(range(8), lambda i: case when n < 8 then least(i, n - 1) else floor(i * (n - 1) / 7 + 0.5) end::int) as frames from (select user_id, count(*) as n from events group by 1) group by n
""")
def frame_sampling(spark, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("n").distinct()
    return n.select("n", mixture.frame_numbers(F.col("n"), 8).alias("frames"))


@query("select doc_id, source || '-' || (row_number() over (partition by source order by doc_id) - 1) as local from documents")
def id_collision(spark, sf_dir: str) -> DataFrame:
    return mixture.local_names(table(spark, sf_dir, "documents").select("doc_id", "source"), [], "source", ["doc_id"]).select("doc_id", "local")


# ---- sampling and shards


@query("select doc_id from documents order by md5('42:' || doc_id), doc_id limit 100")
def shuffle_limit(spark, sf_dir: str) -> DataFrame:
    """A seeded shuffle's first hundred, the operator's own limit."""
    return mixture.shuffled(table(spark, sf_dir, "documents").select("doc_id"), 42, "doc_id").limit(100)


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by md5('1:' || doc_id), doc_id) as r from documents) where r <= 5")
def bucket_cap_sample(spark, sf_dir: str) -> DataFrame:
    return mixture.capped(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", 5, 1, "doc_id")


@query("select source, min(doc_id) as doc_id from documents group by source")
def stratified_first(spark, sf_dir: str) -> DataFrame:
    return mixture.first_of_each(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])


_WEIGHTS = (("a", 1.0), ("b", 2.5), ("c", 0.5))


@query("""
select doc_id, case when u < 0.25 then 'a' when u < 0.875 then 'b' else 'c' end as grp from (select doc_id, ('0x' || md5('9:' || doc_id)[1:8])::bigint / 4294967296 as u from documents)
""")
def mixture_weighted(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", mixture.weighted(9, _WEIGHTS, "doc_id").alias("grp"))


@query("""
select doc_id, source, round(r / w, 6) as turn from (
  select doc_id, source, case source when 'src0' then 1.0 when 'src1' then 4.0 when 'src2' then 2.0 end as w, row_number() over (partition by source order by md5('3:' || doc_id), doc_id) as r from documents) where w > 0
""")
def mixture_interleave(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixture.interleaved(d, "source", {"src0": 1.0, "src1": 4.0, "src2": 2.0}, 3, "doc_id").select("doc_id", "source", F.round("turn", 6).alias("turn"))


def _ranked(spark, sf_dir: str) -> DataFrame:
    """Orders numbered from 0 in order of their id, as file readers number lines."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return dense_ids(o, "o_orderkey", name="r").withColumn("n", F.lit(o.count()))


@query("with r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as r, count(*) over () as n from orders) select o_orderkey, floor(r / ceil(n / 7))::int as shard from r")
def shard_ceil(spark, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("o_orderkey", mixture.ceil_shard(F.col("r"), F.col("n"), 7).alias("shard"))


@query("""
with r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as r, count(*) over () as n from orders)
select o_orderkey, least(floor(r / floor(n / 7)), 6)::int as rank, case when r < n % 7 * (floor(n / 7) + 1) then floor(r / (floor(n / 7) + 1)) else n % 7 + floor((r - n % 7 * (floor(n / 7) + 1)) / floor(n / 7)) end::int as even from r
""")
def shard_floor_rank_worker(spark, sf_dir: str) -> DataFrame:
    r, n = F.col("r"), F.col("n")
    return _ranked(spark, sf_dir).select("o_orderkey", mixture.floor_shard(r, n, 7).alias("rank"), mixture.even_shard(r, n, 7).alias("even"))


@query("select n_nationkey, copy::int as copy from nation, range(3) t(copy) where copy * (select count(*) from nation) + (select count(*) from nation m where m.n_nationkey < nation.n_nationkey) < 60")
def repeat_to_n(spark, sf_dir: str) -> DataFrame:
    return mixture.repeated_to(table(spark, sf_dir, "nation").select("n_nationkey"), 60, ["n_nationkey"]).select("n_nationkey", "copy")


@query("select coalesce(o_orderpriority, 'merged') as subset, count(*) as n, round(avg(o_totalprice), 4) as score from orders group by grouping sets ((o_orderpriority), ())")
def union_subsets(spark, sf_dir: str) -> DataFrame:
    """Each subset and all of them together, from one scan."""
    return table(spark, sf_dir, "orders").rollup("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("score")).select(F.coalesce("o_orderpriority", F.lit("merged")).alias("subset"), "n", "score")


# ---- packing


def _samples(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("tokens"), F.col("source").alias("grp"))


@query()
def pack_tokens(spark, sf_dir: str) -> DataFrame:
    return packing.assembled(packing.pack(_samples(spark, sf_dir), None, 5, mandatory=("src3",)))


@query()
def pack_lineage(spark, sf_dir: str) -> DataFrame:
    return packing.lineage(packing.pack(_samples(spark, sf_dir), None, 5, mandatory=("src3",)))


@query("select doc_id as key, n_chars as tokens, source as grp from documents where coalesce(n_chars, 0) <= 24064")
def pack_keys(spark, sf_dir: str) -> DataFrame:
    """Every sample lies in exactly one pack."""
    return packing.pack(_samples(spark, sf_dir), None, 5, mandatory=("src3",)).select("key", "tokens", "grp")


@query("select doc_id, n_chars from documents where n_chars <= 24064")
def length_filter(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").where(F.col("n_chars") <= packing.Limits().sample)


# ---- reports


def _facts(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count("*").alias("samples"))
    return reports.facts(o, "m 1", "Seg", "o_orderpriority", ("mean", "samples"))


_FACTS = """
w as (select o_orderpriority as "Dataset", round(avg(o_totalprice), 4) as mean, count(*)::double as samples from orders group by 1),
f as (select 'm 1' as "ModelName", 'Seg' as "Task", "Dataset", 'mean' as "Metric", mean as "Value" from w union all select 'm 1', 'Seg', "Dataset", 'samples', samples from w)
"""


@query(f"""with {_FACTS} select 'm_1__Seg__' || replace(replace(trim("Dataset"), '/', '-'), ' ', '_') || '__' || "Metric" as "Key", * from f""")
def fact_table(spark, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir)


@query(f"""with {_FACTS} select "ModelName", "Task", "Dataset", max(case when "Metric" = 'mean' then "Value" end) as mean, max(case when "Metric" = 'samples' then "Value" end) as samples from f group by 1, 2, 3""")
def fact_pivot(spark, sf_dir: str) -> DataFrame:
    return reports.pivoted(_facts(spark, sf_dir), ("mean", "samples"))


@query("select event_type, max_by(event_id, event_id) as event_id, max_by(value, event_id) as value from events group by event_type")
def fact_dedup_last(spark, sf_dir: str) -> DataFrame:
    return reports.latest(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", "event_id")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, regexp_replace(regexp_replace(round(case when l_discount::double <= 1 then l_discount::double * 100 else l_discount::double end, 2)::decimal(20,2)::varchar, '0+$', ''), '\\.$', '') as score from lineitem")
def score_format(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reports.shown_score(F.col("l_discount").cast("double")).alias("score"))


@query("""
with p as (select event_id, case when event_id % 10 = 0 then '{' || props else props end as j from events)
select json_valid(j) as valid, count(*) as n, sum(case when json_valid(j) then json_extract(j, '$.k')::bigint end)::bigint as k from p group by 1
""")
def quarantine_bad_json(spark, sf_dir: str) -> DataFrame:
    """Rows that can't be read are counted apart and the rest goes on."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("j"))
    v = F.try_parse_json("j")
    return e.groupBy(v.isNotNull().alias("valid")).agg(F.count("*").alias("n"), F.sum(F.try_variant_get(v, "$.k", "long")).alias("k"))
