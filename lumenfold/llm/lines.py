"""Line dedup by a log-template tree.

A line's leaf in a tree of fixed depth is its token count and its leading tokens, tokens with a
digit being variable fields. In a leaf, a word at a place may be a fixed word of a template if
enough different texts have it there. A line whose places are mostly such words goes on: by each of
its rarest ones to a node of the lines that share it, where places are counted anew, LEVELS times.
So a template is told apart by its own words, however many others share its leaf, and a field's
values, even if they are frequent in the leaf, are rare in its node. In a node, words with enough
texts are fixed and all others are variable fields; that is a template of the line if its places
are still mostly fixed. Besides, every line is a template of its own. Lines of templates that recur
across documents are dropped, but for the template's first line (smallest doc_id, then text hash,
then position), so that no wording is lost altogether.

All of this is counting: a node is never gathered in one task, and one rule holds for every size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ship, sifted, small_batches, table

#: Leading tokens of a leaf; share of fixed places that makes a template; different texts in which a
#: template recurs; levels below the leaf; words by which a line goes on from a node.
DEPTH, SIMILARITY, RECURS, LEVELS, WAYS = 3, 0.75, 20, 2, 2
#: (tokens, texts): lines of so many tokens or more don't recur by chance, so fewer texts than
#: RECURS are enough.
FLOORS = ((50, 2), (8, 3))
FIELD = "<*>"
#: Distinct lines of a node that meet one copy of its fixed words, so that no word is a hot key.
PART = 2000

_SPACE = r"[\x20\x09-\x0D]+"


def _parsed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, masked, tokens, leaf) of each line with a token; th: hash of the whole text."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # most lines have neither digits nor odd white space: one look, and no array of tokens
    odd = F.col("line").rlike(r"[0-9\x09-\x0D]|\x20\x20")
    plain = F.regexp_replace(F.regexp_replace("line", _SPACE, " "), r"[^\x20]*[0-9][^\x20]*", FIELD)
    lines = lines.withColumn("masked", F.trim(F.when(odd, plain).otherwise(F.col("line")))).where("masked <> ''")
    gaps = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit("")))
    return lines.withColumn("tokens", gaps + 1).withColumn("leaf", F.xxhash64(gaps, F.substring_index("masked", " ", DEPTH)))


def _floor(recurs: int):
    """Different texts from which a line of so many `tokens` recurs."""
    out = F.lit(recurs)
    for tokens, texts in sorted(FLOORS):
        out = F.when(F.col("tokens") >= tokens, min(texts, recurs)).otherwise(out)
    return out


def _counted(lines: DataFrame) -> DataFrame:
    """Of lines at nodes of the tree (leaf, node, floor, mh, w, masked): tokens n, fixed ones k,
    template, and ways, (support, token) of the rarest fixed words unless all the node's lines share
    them. A node with one line is left out, as it can't generalise."""
    many = lines.groupBy("node").agg(F.count("*").alias("lines"), F.sum("w").alias("total")).where("lines > 1")
    many = many.select("node", "total", F.ceil(F.col("lines") / PART).cast("int").alias("parts"))
    words = lines.join(many, "node").select("leaf", "node", "floor", "total", "parts", "mh", "w", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    words = materialize(words.withColumn("token", F.xxhash64("at", "token")), "places")
    inner = F.col("at") >= DEPTH  # the leaf's own words are fixed
    support = words.where(inner).groupBy("node", "token").agg(F.sum("w").alias("s"), *[F.max(c).alias(c) for c in ("floor", "parts")])
    fixed = support.where(F.col("s") >= F.col("floor"))
    fixed = fixed.select("node", "token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "s")
    parted = words.where(inner).withColumn("part", F.pmod("mh", "parts").cast("int"))
    columns = ["leaf", "node", "floor", "total", "mh", "at", "token", "s"]
    known = parted.join(fixed, ["node", "token", "part"], "left").select(*columns)
    known = known.unionAll(words.where(~inner).withColumn("s", F.col("total")).select(*columns))
    # places are part of the hashes, so that these need no order
    shown = F.when(F.col("s").isNotNull(), F.col("token")).otherwise(F.xxhash64("at", F.lit(FIELD)))
    mixed = F.xxhash64(F.bit_xor(shown), F.bit_xor(F.xxhash64(shown)))
    apart = F.when(F.col("s") < F.col("total"), F.struct("s", "token"))
    rare = F.slice(F.array_sort(F.collect_list(apart)), 1, WAYS).alias("ways")
    found = known.groupBy("leaf", "node", "floor", "mh").agg(mixed.alias("template"), F.count("s").alias("k"), F.count("*").alias("n"), rare)
    out = materialize(found, "counted")
    discard(words)
    return out


def templates(lines: DataFrame, similarity: float = SIMILARITY, levels: int = LEVELS) -> DataFrame:
    """(leaf, mh, template) of the lines that belong to templates which are not their own texts, a
    row for each template.

    lines: leaf, floor, mh, masked, w: the distinct lines and in how many different texts each
    stands. template is a hash of the text with its variable fields.
    """
    at, found, used = lines.withColumn("node", F.col("leaf")), None, []
    columns = ["leaf", "node", "floor", "mh", "w", "masked"]
    for level in range(levels + 1):
        every = _counted(at.select(*columns))
        used += [every, at]
        counted = every.where(F.col("k") >= similarity * F.col("n"))
        some = counted.where(F.col("k") < F.col("n")).select("leaf", "mh", "template")
        found = some if found is None else found.unionAll(some)
        if level < levels:
            below = counted.select("leaf", "node", "mh", F.explode("ways").alias("way")).select("leaf", "mh", F.xxhash64("node", "way.token").alias("node"))
            at = materialize(lines.join(below.distinct(), ["leaf", "mh"]).select(*columns), "nodes")
    out = materialize(found.distinct(), "general")
    for table_ in used:
        discard(table_)
    return out


def dedup_lines(docs: DataFrame, recurs: int = RECURS) -> DataFrame:
    """Drop recurring lines; text is replaced, and n_lines and n_dropped are added.

    A line recurs if one of its templates does in `recurs` different texts, or in fewer by FLOORS
    where it is longer, and it isn't that template's first line. A line that recurs itself always goes.

    docs: doc_id, text and any other columns, kept as they are; columns named n_lines or
    n_dropped are replaced. A null text stays null (0 lines). Texts count once however many rows
    have them, and repeated rows are treated alike. Empty lines are never dropped; a text may lose
    all its lines and is then empty.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    parsed = _parsed(docs).withColumn("mh", F.xxhash64("masked")).withColumn("floor", _floor(recurs).cast("int"))
    slim = materialize(parsed.select("doc_id", "th", "pos", "leaf", "mh", "floor", "masked"), "lines")
    common = slim.groupBy("leaf", "floor", "th").agg(F.lit(1).alias("one")).groupBy("leaf", "floor").agg(F.count("*").alias("n"))
    common = materialize(common.where(F.col("n") >= F.col("floor")).select("leaf"), "leaves")
    near = materialize(sifted(slim, common, "leaf"), "candidates")
    lines = near.groupBy("leaf", "floor", "mh", "th").agg(F.min("masked").alias("masked")).groupBy("leaf", "floor", "mh").agg(F.count("*").alias("w"), F.min("masked").alias("masked"))
    lines = materialize(lines, "distinct")
    general = templates(lines)
    slim_near = near.drop("masked")
    named = slim_near.withColumn("template", F.col("mh")).unionByName(slim_near.join(general, ["leaf", "mh"]))
    counts = named.groupBy("leaf", "template", "floor", "th").agg(F.min(F.struct("doc_id", "th", "pos")).alias("at"))
    counts = counts.groupBy("leaf", "template", "floor").agg(F.count("*").alias("n"), F.min("at").alias("first")).where(F.col("n") >= F.col("floor"))
    counts = materialize(counts.select("leaf", "template", "first"), "templates")
    repeated = named.join(counts, ["leaf", "template"]).where(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first")))
    drops = repeated.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("__drop"))
    drops = materialize(drops.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "__drop"), "drops")
    for used in (slim, common, near, lines, general, counts):
        discard(used)
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    out = keyed.join(drops, keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__th")), "left")

    @F.pandas_udf("string")
    def without(texts: pd.Series, drop: pd.Series) -> pd.Series:
        def cut(text: str | None, d: np.ndarray | None) -> str | None:
            if text is None:
                return None
            gone = set(d.tolist())
            return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

        return pd.Series([cut(t, d) for t, d in zip(texts, drop, strict=True)], dtype=object)

    hit = F.col("__drop").isNotNull()
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))))
    out = out.withColumn("n_dropped", F.when(hit, F.size("__drop")).otherwise(0))
    out = out.withColumn("text", F.when(hit, without(F.when(hit, F.col("text")), "__drop")).otherwise(F.col("text")))
    return out.drop("__key", "__id", "__th", "__drop")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Drop the lines of recurring templates from all documents."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_dropped")
