"""Camera poses of sequences from text and JSON files: rows (seq, frame, image, pose).

pose is camera to world, 16 numbers by rows, x right, y down, z forward. A layout is where the files
lie, how their paths tell sequence and frame, and how their numbers become a pose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.binding import let

Pose = Callable[[Column], Column]

#: Changes of axes, by rows.
FLIP_YZ = (1, 0, 0, 0, 0, -1, 0, 0, 0, 0, -1, 0, 0, 0, 0, 1)
GAME_AXES = (-1, 0, 0, 0, 0, 0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1)
SWAPPED_XY_Z = (0, 1, 0, 0, 1, 0, 0, 0, 0, 0, -1, 0, 0, 0, 0, 1)


def constant(values: tuple) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def times(a: Column, b: Column, n: int = 4) -> Column:
    of = lambda a, b: F.array(*[sum((a[n * i + k] * b[n * k + j] for k in range(1, n)), a[n * i] * b[j]) for i in range(n) for j in range(n)])
    return let(a, lambda a: let(b, lambda b: of(a, b)))


def turned(m: Column, n: int = 4) -> Column:
    """The transpose."""
    return F.array(*[m[n * j + i] for i in range(n) for j in range(n)])


def whole(m: Column, t: Column) -> Column:
    """16 numbers of a rotation (9) and a shift (3)."""
    of = lambda m, t: F.array(*[x for i in range(3) for x in (m[3 * i], m[3 * i + 1], m[3 * i + 2], t[i])], *[F.lit(float(v)) for v in (0, 0, 0, 1)])
    return let(m, lambda m: let(t, lambda t: of(m, t)))


def inverted(m: Column) -> Column:
    """The inverse of an affine map (last row 0 0 0 1); null if it has none."""

    def of(m: Column) -> Column:
        c = lambda i, j: m[4 * i + j]
        minor = lambda i, j: c((i + 1) % 3, (j + 1) % 3) * c((i + 2) % 3, (j + 2) % 3) - c((i + 1) % 3, (j + 2) % 3) * c((i + 2) % 3, (j + 1) % 3)
        det = c(0, 0) * minor(0, 0) + c(0, 1) * minor(0, 1) + c(0, 2) * minor(0, 2)
        back = F.array(*[F.try_divide(minor(j, i), det) for i in range(3) for j in range(3)])
        return F.when(det != 0, let(back, lambda b: whole(b, F.transform(geo.rotate(b, F.array(c(0, 3), c(1, 3), c(2, 3))), lambda v: -v))))

    return let(m, of)


def flat(rows: Column) -> Column:
    """By rows, of an array of rows."""
    return F.flatten(rows)


def _numbers(c: Column) -> Column:
    return F.transform(F.split(F.trim(F.regexp_replace(c, r"[\s,]+", " ")), " "), lambda v: v.try_cast("double"))


def _named(files: DataFrame, where: str) -> DataFrame:
    """seq, and the file's own number if there is one, by a pattern of groups (seq, number) on the path."""
    groups = 2 if where.count("(") - where.count("(?") > 1 else 1
    frame = F.regexp_extract("src", where, 2).try_cast("long") if groups == 2 else F.lit(None).cast("long")
    return files.where(F.col("src").rlike(where)).withColumns({"seq": F.regexp_extract("src", where, 1), "number": frame})


def _texts(spark: SparkSession, path: str, where: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select("value", F.regexp_replace(F.col("_metadata.file_path"), "%20", " ").alias("src"))
    return _named(files, where)


def _rows(frames: DataFrame, pose: Column, image: str) -> DataFrame:
    out = frames.select("seq", "frame", F.format_string(image, "seq", "frame").alias("image"), pose.alias("pose"))
    return out.where((F.size("pose") == 16) & F.forall("pose", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def matrix_files(spark: SparkSession, path: str, where: str, image: str, pose: Pose = lambda m: m) -> DataFrame:
    """A text file of 16 numbers for each frame; where: (sequence), (frame) on the path. image is a format of
    sequence and frame. Files without 16 finite numbers are left out."""
    files = _texts(spark, path, where).withColumn("frame", F.col("number")).withColumn("n", _numbers(F.col("value")))
    return _rows(files, F.when(F.size("n") == 16, pose(F.col("n"))), image)


def pose_lines(spark: SparkSession, path: str, where: str, image: str, pose: Pose, width: int, least: bool = True) -> DataFrame:
    """A text file for each sequence, a frame for each line that isn't empty or a comment; lines of fewer
    than width numbers (least), or of another number, are frames without a pose, and left out."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    rows = _texts(spark, path, where).select("seq", F.posexplode(lines).alias("frame", "line")).withColumn("n", _numbers(F.col("line")))
    fits = F.size("n") >= width if least else F.size("n") == width
    return _rows(rows.withColumn("frame", F.col("frame").cast("long")), F.when(fits, pose(F.col("n"))), image)


def cycled_pose(n: Column) -> Column:
    """Of x y z qx qy qz qw, x forward and z down."""
    q, t = geo.axes_cycled(n)
    return whole(geo.matrix(geo.unit(q)), t)


def engine_pose(n: Column) -> Column:
    """Of x y z qx qy qz qw in a game engine's axes and centimetres."""
    return let(F.concat(F.slice(n, 1, 3), geo.unit(F.slice(n, 4, 4))), lambda p: whole(*geo.engine_camera(p)))


def frame_documents(spark: SparkSession, path: str, where: str, schema: str, image: str, frame: Column, pose: Column) -> DataFrame:
    """JSON documents with an array `frames`, of the schema given; frame and pose are expressions of its
    elements' fields, of `at` (their place) and of the document's src."""
    docs = spark.read.schema(f"frames array<struct<{schema}>>").option("multiLine", True).json(path).withColumn("src", F.col("_metadata.file_path"))
    rows = _named(docs, where).select("seq", F.posexplode("frames").alias("at", "f")).select("seq", "at", "f.*")
    return _rows(rows.withColumn("frame", frame.cast("long")), pose, image)


def scaled_transforms(spark: SparkSession, path: str, where: str, image: str) -> DataFrame:
    """Documents of frames with colmap_im_id and transform_matrix, x and y of the world swapped and z turned."""
    m = flat(F.col("transform_matrix"))
    return frame_documents(spark, path, where, "colmap_im_id long, transform_matrix array<array<double>>", image, F.col("colmap_im_id"), times(times(constant(SWAPPED_XY_Z), m), constant(FLIP_YZ)))


def rendered_transforms(spark: SparkSession, path: str, where: str, image: str) -> DataFrame:
    """Documents of frames with file_path r_<n>, transform_matrix (y up, z backward) and the object's scale,
    by whose thousandfold lengths are divided."""
    m = let(flat(F.col("transform_matrix")), lambda m: times(m, constant(FLIP_YZ)))
    sized = let(m, lambda m: F.transform(m, lambda v, i: F.when(i.isin(3, 7, 11), F.try_divide(v, F.col("scale") * 1000)).otherwise(v)))
    number = F.regexp_extract("file_path", r"_(\d+)$", 1).try_cast("long")
    return frame_documents(spark, path, where, "file_path string, transform_matrix array<array<double>>, scale double", image, number, sized)


def world_to_camera_documents(spark: SparkSession, path: str, where: str, image: str) -> DataFrame:
    """Documents of frames with w2c, in order."""
    return frame_documents(spark, path, where, "w2c array<array<double>>", image, F.col("at"), inverted(flat(F.col("w2c"))))


def extrinsic_documents(spark: SparkSession, path: str, where: str, image: str, axes: tuple | None = None) -> DataFrame:
    """A JSON document with extrinsic (world to camera) for each frame; axes: a change of the world's axes."""
    docs = spark.read.schema("extrinsic array<array<double>>").option("multiLine", True).json(path).withColumn("src", F.col("_metadata.file_path"))
    m = flat(F.col("extrinsic"))
    m = times(m, turned(constant(axes))) if axes else m
    return _rows(_named(docs, where).withColumn("frame", F.col("number")), inverted(m), image)


def depth_ranged_files(spark: SparkSession, path: str, where: str) -> DataFrame:
    """(seq, frame, pose, intrinsic 9, depth_min, depth_max) of files with an extrinsic and an intrinsic matrix
    and a line of depths: least, step, and, if they are given, number and largest."""
    t = _texts(spark, path, where)
    low = F.lower("value")
    e = _numbers(F.trim(F.regexp_extract(low, r"(?s)extrinsic\s+(.*?)intrinsic", 1)))
    rest = _numbers(F.trim(F.regexp_extract(low, r"(?s)intrinsic\s+(.*)$", 1)))
    rows = t.select("seq", F.col("number").alias("frame"), e.alias("e"), rest.alias("i")).where((F.size("e") == 16) & (F.size("i") >= 11))
    step, number = F.get("i", F.lit(10)), F.get("i", F.lit(11))
    far = F.coalesce(F.get("i", F.lit(12)), F.col("i")[9] + step * F.coalesce(number - 1, F.lit(191.0)))
    return rows.select("seq", "frame", inverted(F.col("e")).alias("pose"), F.slice("i", 1, 9).alias("intrinsic"), F.col("i")[9].alias("depth_min"), far.alias("depth_max"))


def colmap_cameras(spark: SparkSession, path: str) -> DataFrame:
    """(camera_id, model, width, height, fx, fy, cx, cy) of a cameras text file: `id model width height
    parameters`; models with one focal length have it twice. Other models are left out."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("not startswith(value, '#') and trim(value) <> ''").select(f.alias("f"))
    d = lambda i: F.get("f", F.lit(i)).try_cast("double")
    one, two = F.col("model").isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL"), F.col("model").isin("PINHOLE", "OPENCV", "FULL_OPENCV", "OPENCV_FISHEYE")
    rows = rows.select(d(0).cast("long").alias("camera_id"), F.get("f", F.lit(1)).alias("model"), d(2).cast("int").alias("width"), d(3).cast("int").alias("height"), *[d(i).alias(f"p{i}") for i in range(4, 8)])
    pick = lambda a, b: F.when(one, F.col(f"p{a}")).when(two, F.col(f"p{b}"))
    out = rows.select("camera_id", "model", "width", "height", pick(4, 4).alias("fx"), pick(4, 5).alias("fy"), pick(5, 6).alias("cx"), pick(6, 7).alias("cy"))
    return out.where("camera_id is not null and cy is not null")
