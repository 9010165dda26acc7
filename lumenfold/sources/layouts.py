"""Readers of further layouts: generic records, delimited text, compressed sequences, cameras."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.binding import let

#: Fields of a line of text by layout: names of the columns in order; "*" takes the rest of the line.
TEXT_LAYOUTS = {
    "quad_comma": (",", ("x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3", "*text")),
    "box_comma": (",", ("x0", "y0", "x1", "y1", "*text")),
    "box_tab": ("\t", ("x0", "y0", "x1", "y1", "*text")),
}
_NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def record_boxes(rows: DataFrame, keep: Sequence[str], found: str, width: str, height: str) -> DataFrame:
    """(keep..., pos, phrase, bbox) of records whose list `found` has (bbox, phrase): a bbox of four
    numbers or of two points, in pixels or normalised (at most 1.5); boxes without extent go."""
    r = rows.select(*keep, width, height, F.posexplode(found).alias("pos", "b"))
    box = boxes.auto_scaled(F.col("b.bbox"), F.col(width).cast("double"), F.col(height).cast("double"))
    box = F.when(F.size("b.bbox") == 4, box)
    return r.select(*keep, "pos", F.col("b.phrase").alias("phrase"), box.alias("bbox")).where("bbox is not null")


def nested_boxes(found: Column) -> Column:
    """[[x0, y0], [x1, y1]] to [x0, y0, x1, y1], for each element."""
    return F.transform(found, F.flatten)


def annotation_batches(spark: SparkSession, path: str | list[str], annotations: str, defaults: dict[str, object]) -> DataFrame:
    """Parquet rows with a list of annotation structs to a row per annotation (src, pos, fields...); a field
    that the files lack gets its default, a null one too."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path))
    out = rows.withColumn("src", F.col("_metadata.file_path")).select("src", *[c for c in rows.columns if c != annotations], F.posexplode(annotations).alias("pos", "a"))
    have = rows.schema[annotations].dataType.elementType.fieldNames()
    fields = [F.coalesce(F.col(f"a.{f}"), F.lit(defaults.get(f))).alias(f) if f in have else F.lit(defaults[f]).alias(f) for f in [*have, *[d for d in defaults if d not in have]]]
    return out.select("src", "pos", *[c for c in rows.columns if c != annotations], *fields)


def text_boxes(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """(src, text, points, bbox) of lines of a delimited layout; what has too few fields, or a place that is
    no number, is skipped, and so is a byte order mark."""
    mark, names = TEXT_LAYOUTS[layout]
    n = len(names) - 1
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("src"), F.regexp_replace("value", "^﻿", "").alias("v"))
    rows = rows.withColumn("f", F.split("v", mark, n + 1)).where(F.size("f") == n + 1)
    rows = rows.withColumn("points", F.transform(F.slice("f", 1, n), lambda v: F.trim(v).try_cast("double"))).where(F.forall("points", lambda v: v.isNotNull()))
    edge = lambda f, k: f(F.filter("points", lambda v, i: i % 2 == k))
    box = F.array(edge(F.array_min, 0), edge(F.array_min, 1), edge(F.array_max, 0), edge(F.array_max, 1))
    return rows.select("src", F.trim(F.col("f")[n]).alias("text"), "points", box.alias("bbox"))


def gzipped_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of gzipped JSON documents whatever their ending: a row for each element of an array at the top."""

    @F.pandas_udf("string")
    def unzip(content: pd.Series) -> pd.Series:
        import gzip

        return pd.Series([gzip.decompress(c).decode() for c in content])

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("src"), unzip("content").alias("t"))
    rows = files.withColumn("t", F.when(F.ltrim("t").startswith("["), F.col("t")).otherwise(F.concat(F.lit("["), "t", F.lit("]"))))
    return rows.select("src", F.posexplode(F.from_json("t", f"array<struct<{schema}>>")).alias("pos", "r")).select("src", "pos", "r.*")


def point_annotations(points: DataFrame, splits: DataFrame, lines: DataFrame, split: str) -> DataFrame:
    """(image, label, points) of one split: points (image, id, x, y), splits (image, split), lines (id, label);
    a point without a label is left out."""
    p = points.join(splits.where(F.col("split") == split).select("image").distinct(), "image", "left_semi").join(lines, "id")
    return p.groupBy("image", "label").agg(F.array_sort(F.collect_list(F.struct("id", F.array("x", "y").alias("p")))).alias("ps")).select("image", "label", F.transform("ps", lambda x: x["p"]).alias("points"))


def camera_files(spark: SparkSession, path: str) -> DataFrame:
    """(src, extrinsic 16 numbers, intrinsic 9 numbers, depth_min, depth_step) of text files that name an
    extrinsic and an intrinsic matrix; files that lack one are skipped."""
    t = spark.read.text(path, wholetext=True).withColumn("src", F.col("_metadata.file_path"))
    numbers = lambda part: F.transform(F.regexp_extract_all(part, F.lit(f"({_NUMBER})"), F.lit(1)), lambda v: v.cast("double"))
    low = F.lower("value")
    e = numbers(F.substring_index(F.substring_index(low, "extrinsic", -1), "intrinsic", 1))
    rows = t.select("src", F.contains(low, F.lit("extrinsic")).alias("ok"), e.alias("e"), numbers(F.substring_index(low, "intrinsic", -1)).alias("i"))
    rows = rows.where(F.col("ok") & (F.size("e") >= 16) & (F.size("i") >= 9))
    return rows.select("src", F.slice("e", 1, 16).alias("extrinsic"), F.slice("i", 1, 9).alias("intrinsic"), F.get("i", F.lit(9)).alias("depth_min"), F.get("i", F.lit(10)).alias("depth_step"))


def colmap_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, q, t, camera_id, name) of the pose lines of an images text file: `id qw qx qy qz tx ty tz
    camera name`; comments and lines of points are skipped."""
    f = F.split(F.trim("value"), r"\s+", 10)
    rows = spark.read.text(path).select(f.alias("f"), F.col("value").startswith("#").alias("c")).where("not c and size(f) = 10")
    d = lambda i: F.get("f", F.lit(i)).try_cast("double")
    rows = rows.select(F.get("f", F.lit(0)).try_cast("long").alias("image_id"), F.array(*[d(i) for i in range(1, 5)]).alias("q"), F.array(*[d(i) for i in range(5, 8)]).alias("t"), F.get("f", F.lit(8)).try_cast("long").alias("camera_id"), F.get("f", F.lit(9)).alias("name"))
    return rows.where(F.col("image_id").isNotNull() & F.col("camera_id").isNotNull() & ~F.col("name").rlike(rf"^{_NUMBER}(\s|$)"))


def trajectory_lines(spark: SparkSession, path: str) -> DataFrame:
    """(src, stamp, k, m) of lines `stamp fx fy cx cy 0 0 m00 ... m23`: normalised intrinsics and the 12 numbers
    of a camera's pose."""
    n = let(F.split(F.trim("value"), r"\s+"), lambda f: F.transform(f, lambda v: v.try_cast("double")))
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("src"), n.alias("n")).where(F.size("n") == 19)
    return rows.select("src", F.col("n")[0].cast("long").alias("stamp"), F.slice("n", 2, 4).alias("k"), F.slice("n", 8, 12).alias("m"))


def rows_behind(spark: SparkSession, path: str | list[str], cursor: tuple[str, int] | None) -> DataFrame:
    """Parquet rows with their place (src, row), those behind a cursor in order of file and row only: what a
    reader that stopped there has still to read. Files before the cursor's are not opened."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path))
    rows = rows.select("*", F.col("_metadata.file_path").alias("src"), F.col("_metadata.row_index").alias("row"))
    return rows if cursor is None else rows.where((F.col("src") > cursor[0]) | ((F.col("src") == cursor[0]) & (F.col("row") > cursor[1])))


def write_shards(rows: DataFrame, path: str, shards: int, key: str) -> None:
    """JSON lines in one folder per shard, shard=000 and on, dealt by the hash of the key."""
    shard = F.format_string("%03d", F.pmod(F.xxhash64(key), F.lit(shards)))
    rows.withColumn("shard", shard).repartition(shards, "shard").write.partitionBy("shard").mode("overwrite").json(path)


def free_name(spark: SparkSession, path: str) -> str:
    """path, or the first of path_v2, path_v3, ... that isn't there yet."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    n, at = 1, path
    while fs.exists(of(at)):
        n += 1
        at = f"{path}_v{n}"
    return at
