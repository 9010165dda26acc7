"""Segments out of colour masks and captions: grounded phrases and panoptic annotations.

A mask arrives as its colours' pixel counts, the caption names a colour for each phrase. A pixel
belongs to the phrase of the nearest colour. Categories that no list knows are registered by their
first appearance over the whole corpus: distinct names are numbered by ranges, and phrases find
their numbers by a join, so neither the names nor the numbering pass through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.binding import let
from ..staging import staged
from .numbering import dense_ids

#: Fixed value: ids of a category's segments start at its id times this.
ID_STEP = 1000
#: Categories that are sent to all tasks; more are shuffled.
NAMES = 100_000


def coloured_phrases(captions: DataFrame) -> DataFrame:
    """(image, place, phrase, r, g, b) of the caption's coloured phrases, in order, repeats kept.
    captions: image, caption; a null caption has none."""
    found = captions.select("image", F.posexplode(text.coloured_spans(F.col("caption"))).alias("place", "c"))
    return found.select("image", "place", "c.phrase", "c.r", "c.g", "c.b")


def grounded_segments(captions: DataFrame, colours: DataFrame) -> DataFrame:
    """(image, place, phrase, r, g, b, n) of the phrases that have pixels.

    captions: image, caption; colours: image, r, g, b, n, the mask's pixels by colour."""
    return _grounded(coloured_phrases(captions), colours)


def _grounded(phrases: DataFrame, colours: DataFrame, needed: str = "place") -> DataFrame:
    """The phrases (image, place, r, g, b and whatever they have) whose `needed` isn't null, with their
    pixels n. A pixel is the phrase's of the nearest colour (the first of equals); black, which always
    is background, and what is nearer to it belong to none. Palette and colours meet once, by image."""
    have = ["place", *[c for c in phrases.columns if c not in ("image", "place")]]
    palette = phrases.groupBy("image").agg(F.collect_list(F.struct(*have)).alias("palette"))
    gap = lambda c: sum((((F.col(x) - c[x]) * (F.col(x) - c[x])).cast("long") for x in "rgb"), F.lit(0).cast("long"))
    near = F.array_min(F.transform("palette", lambda c: F.struct(gap(c).alias("d"), *[c[x].alias(x) for x in have])))
    black = sum((F.col(x).cast("long") * F.col(x) for x in "rgb"), F.lit(0).cast("long"))
    rows = colours.join(palette, "image").select("image", "n", let(near, lambda m: F.when((black > 0) & (m["d"] <= black), m)).alias("m"))
    # a count instead of a filter, which Spark would put before, where it looks for the nearest once more
    pixels = rows.groupBy("image", *[F.col(f"m.{c}").alias(c) for c in have]).agg(F.sum("n").cast("long").alias("n"), F.count(f"m.{needed}").alias("__found"))
    return pixels.where("__found > 0").select(*phrases.columns, "n")


def named_base(phrase: Column) -> tuple[Column, Column]:
    """Category and number of `name-3`; the whole phrase and null where no number ends it."""
    numbered = phrase.rlike(r"(?s)^.*-[0-9]{1,15}$")
    at = F.regexp_extract(phrase, r"(?s)^(.*)-[0-9]{1,15}$", 1)
    return F.when(numbered, at).otherwise(phrase), F.when(numbered, F.regexp_extract(phrase, r"([0-9]{1,15})$", 1).cast("long"))


def register_categories(known: DataFrame, names: DataFrame, order: Sequence[str]) -> DataFrame:
    """(key, id, name) of the known categories (id, name) and of all further names, numbered on from the
    largest known id by first appearance in `order`; key is the normalised name. A key that several
    known categories have keeps the last one's id."""
    keyed = known.groupBy(text.normalize_category(F.col("name")).alias("key")).agg(F.max(F.struct("id", "name")).alias("k"))
    keyed = keyed.select("key", F.col("k.id").cast("long").alias("id"), F.col("k.name").alias("name"))
    first = names.groupBy(text.normalize_category(F.col("name")).alias("key")).agg(F.min(F.struct(*order, "name")).alias("first"))
    new = first.where("key is not null").join(keyed.select("key"), "key", "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    ids = dense_ids(new.select("key", "first"), "first", start=top + 1)
    return keyed.unionByName(ids.select("key", "id", F.col("first.name").alias("name")))


def _placed(segments: Column) -> Column:
    """Ids of an image's segments (place, category_id, local, n, phrase) in order: the number that the
    phrase gives, else the next of its category, shifted to the next free id."""

    def step(done: Column, s: Column) -> Column:
        own = F.transform(F.filter(done, lambda e: e["category_id"] == s["category_id"]), lambda e: e["local"] + 1)
        start = s["category_id"] * ID_STEP + F.coalesce(s["local"], F.array_max(own), F.lit(0).cast("long"))
        free = lambda at: F.array_min(F.filter(F.sequence(at, at + F.size(done)), lambda x: ~F.exists(done, lambda e: e["id"] == x)))
        number = lambda i: F.named_struct(
            F.lit("place"), s["place"], F.lit("phrase"), s["phrase"], F.lit("category_id"), s["category_id"],
            F.lit("id"), i, F.lit("local"), i - s["category_id"] * ID_STEP, F.lit("n"), s["n"],
        )
        return F.array_append(done, let(let(start, free), number))

    kind = "array<struct<place:int,phrase:string,category_id:bigint,id:bigint,local:bigint,n:bigint>>"
    return F.aggregate(segments, F.array().cast(kind), step)


def panoptic_segments(captions: DataFrame, colours: DataFrame, known: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Segments (image, place, phrase, category_id, id, local, n) and the categories (key, id, name).

    captions: image, caption, question; phrases of the question that have no colour register their
    categories before the caption's do. strict: phrases of unknown categories are skipped, and none
    is registered. Phrases without pixels register their category but make no segment.
    """
    # all phrases of an image in one pass over its texts, written, as three steps read them
    empty = F.array().cast("array<struct<stage:int,place:int,phrase:string,r:int,g:int,b:int>>")
    found = F.transform(text.coloured_spans(F.col("caption")), lambda c, i: F.struct(F.lit(1).alias("stage"), i.alias("place"), c["phrase"].alias("phrase"), *[c[x].alias(x) for x in "rgb"]))
    asked = F.transform(text.tagged_phrases(F.col("question")), lambda p, i: F.struct(F.lit(0).alias("stage"), i.alias("place"), p.alias("phrase"), *[F.lit(None).cast("int").alias(x) for x in "rgb"]))
    every = F.coalesce(found, empty) if strict else F.concat(F.coalesce(asked, empty), F.coalesce(found, empty))
    base, local = named_base(F.col("phrase"))
    named = captions.select("image", F.explode(every).alias("p")).select("image", "p.*").withColumns({"name": base, "local": local})
    named = staged(named.withColumn("key", text.normalize_category(F.col("name"))), "phrases")
    names = named.where("false" if strict else "true").select("name", "image", "stage", "place")
    registry = register_categories(known, names, ("image", "stage", "place"))
    spans = named.where("stage = 1").select("image", "place", "phrase", "r", "g", "b", "local", "key")
    ids = staged(registry.select("key", F.col("id").alias("category_id")), "registry")
    # by rows, as a file of names is small for what it holds: many don't go through the driver
    ids = ids.hint("broadcast" if ids.count() <= NAMES else "merge")
    spans = spans.join(ids, "key", "left").drop("key")
    rows = _grounded(spans, colours, "category_id")
    one = F.struct("place", "phrase", "category_id", "local", "n")
    images = rows.groupBy("image").agg(F.array_sort(F.collect_list(one)).alias("s"))
    out = images.select("image", F.explode(_placed(F.col("s"))).alias("s")).select("image", "s.*")
    return out, registry
