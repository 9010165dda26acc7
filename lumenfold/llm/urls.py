"""URL filter: host and path rules first, link-graph propagation for the rest.

Both walks are personalised PageRank over host edges, as each host sees it: how much of what a walk
from the host comes to, is a seed. For distrust the walk follows links, seeds being the hosts that
block rules name; so distrust runs against the links, from blocked hosts to those that link to
them, and each hands on its distrust in the share that it has in the other's links. For trust the
walk goes back along links, seeds being the hosts that allow rules name; so trust runs along the
links, in the share that a host has in what points to the other. Shares are the receiving host's
own: a host's standing doesn't depend on how many others link to the same blocked host, nor on
seeds that it has nothing to do with. A page without a rule is blocked if its host's distrust
passes the threshold and exceeds its trust.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the production query.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: A seed's score is 1 at least; with 0.2, a quarter of a host's links to blocked hosts block it.
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.2
#: Edges of a host from which its score is dealt to several keys; such hosts that are broadcast at most.
HUB, FEW = 100_000, 100_000


def host_of(url: Column) -> Column:
    """Behind the first :// up to / ? # or the end, A-Z lower-cased; empty if null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ? # or the end; empty if null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (ties: the smaller text); null if none."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): absolute links of the pages between different hosts, counted."""
    links = F.expr(r"""regexp_extract_all(html, '(?i)href\\s*=\\s*["\']?\\s*([a-z][a-z0-9+.-]*://[^"\'\\s>]*)', 1)""")
    return (
        pages.select("src", F.explode(links).alias("link"))
        .select("src", host_of(F.col("link")).alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def walk_edges(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (kind, src, part, dst, share) on which trust (allow) and distrust (block) move from src
    to dst, the shares of a dst's edges summing to 1, and (kind, src, parts) of the hubs, whose edges
    are in several parts. raw: src, dst, weight of links."""
    walk = raw.select(F.lit("allow").alias("kind"), "src", "dst", "weight").unionAll(
        raw.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    total = walk.groupBy("kind", "dst").agg(F.sum("weight").alias("total"))
    hubs = walk.groupBy("kind", "src").agg(F.count("*").alias("n")).where(F.col("n") > HUB)
    hubs = materialize(hubs.select("kind", "src", F.ceil(F.col("n") / HUB).cast("int").alias("parts")), "hubs")
    shared = walk.join(total, ["kind", "dst"]).join(_known(hubs), ["kind", "src"], "left")
    part = F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")
    return materialize(shared.select("kind", "src", part.alias("part"), "dst", (F.col("weight") / F.col("total")).alias("share")), "shares"), hubs


def _known(hubs: DataFrame) -> DataFrame:
    """To be broadcast, unless they are many."""
    return F.broadcast(hubs) if hubs.limit(FEW + 1).count() <= FEW else hubs


def personalised_pagerank(edges: DataFrame, hubs: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score) after a fixed number of rounds: 1 for a seed, and for every host damping
    times the scores of the hosts its edges come from, by their shares.

    edges, hubs: as of walk_edges(); seeds: (kind, host). Kinds are walked together, a round being
    one join and one aggregate; a hub's score meets its edges in parts; each round is written out.
    """
    start = seeds.select("kind", "host", F.lit(1.0).alias("score"))
    if edges.isEmpty():  # what every round would give
        return start
    score, known = materialize(start, "ppr"), _known(hubs.withColumnRenamed("src", "host"))
    for _ in range(rounds):
        dealt = score.join(known, ["kind", "host"], "left").select("kind", F.col("host").alias("src"), "score", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        moved = (
            dealt.join(edges, ["kind", "src", "part"])
            .select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("x"))
            .unionAll(start.withColumnRenamed("score", "x"))
            .groupBy("kind", "host")
            .agg(F.sum("x").alias("score"))
        )
        nxt = materialize(moved, "ppr")
        discard(score)
        score = nxt
    return score


def judge_urls(
    pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    pages: page_id, url, html. A null url, or one without ://, has empty host and path, no rule and
    verdict allow; null html has no links, html of any length is searched whole; repeated pages give
    repeated rows and their links count as often. Hosts that both allow and block rules name seed
    both walks. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    based = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("ruled", ruled)
    seen = based.where("ruled is not null and host <> ''").groupBy(F.col("ruled").alias("kind"), "host").agg(F.lit(1.0).alias("one"))
    seeds = materialize(seen.select("kind", "host"), "seeds")
    raw = materialize(host_edges(pages.select(host.alias("src"), "html")), "edges")
    edges, hubs = walk_edges(raw)
    score = personalised_pagerank(edges, hubs, seeds, damping, rounds)
    if hasattr(score, "_lumenfold_path"):  # written out, so what it came from is read no more
        for used in (raw, edges, hubs, seeds):
            discard(used)
    hosts = score.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "allow", F.col("score"))).alias("trust"),
        F.sum(F.when(F.col("kind") == "block", F.col("score"))).alias("distrust"),
    )
    out = based.join(hosts, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    spread = F.when((distrust >= threshold) & (distrust > trust), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", spread).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Judge every page by the production rules, and by its host's standing where none fits."""
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def _sql() -> str:
    host = f"translate(regexp_extract({{}}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    rules = ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
    rounds = "".join(
        f""", s{k + 1} as (select kind, host, sum(x) as score from (
  select e.kind, e.dst as host, s.score * e.share * {DAMPING} as x from s{k} s join shares e on e.kind = s.kind and e.src = s.host
  union all select kind, host, 1.0 from seeds) group by all)"""
        for k in range(ROUNDS)
    )
    return f"""
with rules(rule, rhost, rpath, rverdict) as (values {rules}),
p as (select page_id, html, coalesce({host.format("url")}, '') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
fit as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(rverdict, length(rule)) as ruled
  from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id),
seen as (select distinct ruled as kind, host from p join fit using (page_id) where host <> ''),
seeds as (select kind, host, 1.0::double as mass from seen),
links as (select host as src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*([a-z][a-z0-9+.-]*://[^"''\\s>]*)', 1)) as link from p),
raw as (select src, dst, count(*) as w from (select src, {host.format("link")} as dst from links) where src <> '' and dst <> '' and src <> dst group by all),
walk as (select 'allow' as kind, src, dst, w from raw union all select 'block', dst, src, w from raw),
shares as (select kind, src, dst, w / sum(w) over (partition by kind, dst) as share from walk),
s0 as (select kind, host, mass as score from seeds){rounds},
h as (select host, coalesce(max(score) filter (where kind = 'allow'), 0.0) as t, coalesce(max(score) filter (where kind = 'block'), 0.0) as d from s{ROUNDS} group by host)
select page_id, p.host, path, rule, coalesce(ruled, case when coalesce(d, 0) >= {THRESHOLD} and coalesce(d, 0) > coalesce(t, 0) then 'block' else 'allow' end) as verdict,
  round(coalesce(t, 0.0), 9) as trust, round(coalesce(d, 0.0), 9) as distrust
from p left join fit using (page_id) left join h on h.host = p.host
"""


OP5_SQL = _sql()
