"""Filters, lookups and small reductions of annotation and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .mixture import digest, uniform
from .numbering import dense_ids

#: How loaders compare scores with their threshold.
SCORE_RULES = {"standard": lambda s, t: s >= t, "federated": lambda s, t: s > t, "document": lambda s, t: s.isNotNull()}


def above_score(rows: DataFrame, rule: str, threshold: float) -> DataFrame:
    return rows.where(SCORE_RULES[rule](F.col("score"), F.lit(threshold)))


def aliased(category: Column, aliases: dict[str, str]) -> Column:
    """A category's other name, itself where it has none."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[category], category) if aliases else category


def bears_loss(plan: Column) -> Column:
    """Whether any element of a sequence plan is trained on."""
    return F.coalesce(F.exists(plan, lambda e: e["loss"] == 1), F.lit(False))


def usable_sequences(frames: DataFrame, quality: float, shift: float, images: int, scale: tuple[float, float] = (0.01, 10.0)) -> DataFrame:
    """Sequences of more than `quality`, with `images` frames or more whose translations all stay within
    `shift`, and all of whose scales lie in range. frames: seq, quality, t (array), scale."""
    norm = F.sqrt(F.aggregate("t", F.lit(0.0), lambda s, v: s + v * v))
    s = frames.groupBy("seq").agg(F.count("*").alias("n"), F.max(norm).alias("far"), F.min("quality").alias("q"), F.min("scale").alias("lo"), F.max("scale").alias("hi"))
    return s.where((F.col("q") > quality) & (F.col("n") >= images) & (F.col("far") <= shift) & (F.col("lo") >= scale[0]) & (F.col("hi") <= scale[1])).select("seq", "n")


def only_ones(rows: DataFrame, key: str) -> DataFrame:
    """rows with their key's number of rows checked: a key in several rows raises."""
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("several rows of "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("__n")


def paired_sequences(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """(seq, status, n): predicted sequences against true ones (seq, frames): used, missing, or mismatch
    where the numbers of frames differ."""
    p, t = predictions.select("seq", F.col("frames").alias("n")), truths.select("seq", F.col("frames").alias("m"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") != F.col("m"), "mismatch").otherwise("used")
    return t.join(p, "seq", "left").select("seq", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


def by_any_key(rows: DataFrame, table: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """rows with the value that the first of several keys finds in table (name, value)."""
    out, found = rows, []
    for i, k in enumerate(keys):
        t = table.select(F.col(name).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        out = out.join(t, F.col(k) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        found.append(f"__v{i}")
    return out.withColumn(value, F.coalesce(*found)).drop(*found)


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def emitted(rows: DataFrame, kept: Column, n: int, order: str | list[str]) -> DataFrame:
    """The first n of the rows that are given out, in order; rows that a filter drops don't count."""
    return rows.where(kept).orderBy(order).limit(n)


def by_corner(found: Column) -> Column:
    """Boxes in order of (x0, y0)."""
    return F.array_sort(found)


def reference_boxes(found: Column, seed: str | int, *key: str) -> Column:
    """One box of one; of two either; of more one of all in three fifths of cases, else 1 to a third of
    them; all choices by hash of the key."""
    n = F.size(found)
    order = F.transform(F.array_sort(F.transform(found, lambda b, i: F.struct(digest(f"{seed}", *key, i).alias("h"), b.alias("b")))), lambda x: x["b"])
    most = F.greatest(F.floor(n / 3).cast("int"), F.lit(1))
    k = F.when((n <= 2) | (uniform(f"{seed}-one", *key) < 0.6), 1).otherwise(1 + F.floor(uniform(f"{seed}-k", *key) * most).cast("int"))
    return F.slice(order, 1, F.least(k, n))


def without_first_batches(rows: DataFrame, order: str, size: int, skipped: int) -> DataFrame:
    """Rows behind the first `skipped` batches of `size`, with their batch."""
    return dense_ids(rows, order, name="__at").withColumn("batch", F.floor(F.col("__at") / size)).where(F.col("batch") >= skipped).drop("__at")


def padded(values: Column, length: Column, fill: Column) -> Column:
    """A list filled up to a length."""
    return F.concat(values, F.array_repeat(fill, F.greatest(length - F.size(values), F.lit(0)).cast("int")))


def attends(q: dict[str, Column], k: dict[str, Column]) -> Column:
    """Whether place q of a pack sees place k. Each has doc, at (place), full (number of the block that
    sees itself in both directions, -1: none) and noise (number of its noised block, -1: none):
    earlier places and one's own full block, never another document, never another noised block."""
    seen = (k["at"] <= q["at"]) | ((q["full"] == k["full"]) & (q["full"] >= 0))
    return (q["doc"] == k["doc"]) & seen & ~((k["noise"] >= 0) & (k["noise"] != q["noise"]))


def visible_counts(places: DataFrame) -> DataFrame:
    """places (doc, at, full, noise as for attends()) with sees, the number of places that each one sees, by
    running counts and no pairs: all clean places up to the end of its own full block, or up to itself
    without one, and those of its own noised block. Blocks are without gaps, at is distinct in a document."""
    up = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    noised = Window.partitionBy("doc", "noise").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = places.withColumn("__c", F.sum((F.col("noise") < 0).cast("long")).over(up)).withColumn("__n", F.when(F.col("noise") >= 0, F.count("*").over(noised)).otherwise(0))
    block, own = Window.partitionBy("doc", "full"), Window.partitionBy("doc", "full", "noise")
    whole = F.col("full") >= 0
    rows = rows.withColumn("__c", F.when(whole, F.max("__c").over(block)).otherwise(F.col("__c"))).withColumn("__n", F.when(whole, F.max("__n").over(own)).otherwise(F.col("__n")))
    return rows.withColumn("sees", F.col("__c") + F.col("__n")).drop("__c", "__n")
