"""Joins of annotation tables that need more than one equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import base_name


def first_existing(rows: DataFrame, key: str, candidates: str, listing: DataFrame, path: str = "path") -> DataFrame:
    """(key, path): of each row's candidate paths in order the first that is listed."""
    c = rows.select(key, F.posexplode(candidates).alias("rank", path))
    return c.join(listing.select(path).distinct(), path).groupBy(key).agg(F.min_by(path, "rank").alias(path))


def paired_by_name(images: DataFrame, masks: DataFrame, path: str = "path") -> DataFrame:
    """(image, mask): equal paths first; else equal lower-case stems, if the stem is the only one of its
    kind on both sides."""
    a, b = images.select(F.col(path).alias("image")), masks.select(F.col(path).alias("mask"))
    exact = a.join(b, F.col("image") == F.col("mask"))
    stem = lambda c: F.lower(F.regexp_replace(base_name(F.col(c)), r"\.[^.]*$", ""))
    only = lambda d, c: d.withColumn("stem", stem(c)).groupBy("stem").agg(F.count("*").alias("n"), F.min(c).alias(c)).where("n = 1").drop("n")
    rest = only(a.join(exact, "image", "left_anti"), "image").join(only(b.join(exact.select("mask"), "mask", "left_anti"), "mask"), "stem")
    return exact.unionAll(rest.select("image", "mask"))


def by_base_name(rows: DataFrame, path: str, images: DataFrame, name: str) -> DataFrame:
    """rows with the images' columns, joined on the file name; a row without an image raises."""
    i = images.withColumn("__b", base_name(F.col(name)))
    out = rows.withColumn("__b", base_name(F.col(path))).join(i, "__b", "left")
    checked = F.when(F.col(name).isNull(), F.raise_error(F.concat(F.lit("no image for "), F.col(path)))).otherwise(F.col(name))
    return out.withColumn(name, checked).drop("__b")


def unordered(rows: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """Rows whose key is smaller than the one before them in the file: breaches of the order that a
    streaming merge relies on."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("__p", F.lag(key).over(w)).where(F.col(key) < F.col("__p")).drop("__p")


def both_ways_missing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has."""
    left = a.select(key).distinct().join(b, key, "left_anti").select(key, F.lit("left").alias("side"))
    return left.unionAll(b.select(key).distinct().join(a, key, "left_anti").select(key, F.lit("right").alias("side")))


def pruned(tables: dict[str, DataFrame], annotations: int, order: str = "id") -> dict[str, DataFrame]:
    """The first `annotations` annotations, and only the images and categories that they use."""
    a = tables["annotations"].orderBy(order).limit(annotations)
    keep = lambda t, c: tables[t].join(a.select(F.col(c).alias("id")).distinct(), "id", "left_semi")
    return {**tables, "annotations": a, "images": keep("images", "image_id"), "categories": keep("categories", "category_id")}
