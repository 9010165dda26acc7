"""Readers and writers of annotation records. Every reader carries src (the file) where order or
origin matters, and schemas are declared, not inferred."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..operators.numbering import dense_ids

#: Record families.
INSTRUCTION = "id bigint, image array<string>, conversations array<struct<`from`:string,value:string>>, seg array<string>, category string"
UNIFIED = (
    "image_name string, image_path string, image_info struct<width:int,height:int>, annotation struct<boxes:array<struct<bbox:array<double>,phrase:string>>,"
    "ocr:array<struct<granularity:string,text:string,bbox:array<double>,polygon:array<double>>>,keypoints:array<struct<keypoint:array<double>,phrase:string>>>"
)
COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,"
    "iscrowd:int,keypoints:array<double>>>, categories array<struct<id:int,name:string,isthing:int>>, videos array<struct<id:bigint,file_names:array<string>,width:int,height:int>>"
)
LABELME = "imagePath string, imageWidth int, imageHeight int, shapes array<struct<label:string,points:array<array<double>>>>"
DETECTION = "image_path string, task_name string, dataset_name string, category string, question string, raw_response string, gt string, extracted_predictions map<string,array<array<double>>>"


def read_lines(spark: SparkSession, path: str | list[str], schema: str, bad: str = "_corrupt_record") -> DataFrame:
    """One JSON object per line; a line that can't be read keeps its text in `bad`."""
    return spark.read.schema(f"{schema}, {bad} string").option("columnNameOfCorruptRecord", bad).json(path).withColumn("src", F.col("_metadata.file_path"))


def read_document(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Whole JSON documents: a row per object, or per element of an array at the top."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_document(spark, path, schema) if path.rstrip("/").endswith(".json") else read_lines(spark, path, schema)


def quarantined(rows: DataFrame, bad: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """Good rows, and those that couldn't be read."""
    return rows.where(F.col(bad).isNull()).drop(bad), rows.where(F.col(bad).isNotNull())


def coco_tables(doc: DataFrame) -> dict[str, DataFrame]:
    """The four tables of COCO documents."""
    return {t: doc.select(F.explode(t).alias("r")).select("r.*") for t in ("images", "annotations", "categories", "videos")}


def coco_boxes(tables: dict[str, DataFrame], excluded: Sequence[str] = ()) -> DataFrame:
    """Unified records: (image_name, width, height, boxes of (bbox, phrase)); boxes without extent and
    images without boxes are left out; boxes keep the annotations' order."""
    c = tables["categories"].select(F.col("id").alias("category_id"), text.normalize_category(F.col("name")).alias("phrase"))
    a = tables["annotations"].where((F.col("bbox")[2] > 0) & (F.col("bbox")[3] > 0)).join(c, "category_id", "left")
    a = a.withColumn("phrase", F.coalesce("phrase", F.lit(""))).where(~F.col("phrase").isin(*excluded) if excluded else F.lit(True))
    b = F.struct("id", boxes.xyxy(*[F.col("bbox")[i] for i in range(4)]).alias("bbox"), "phrase")
    g = a.groupBy("image_id").agg(F.array_sort(F.collect_list(b)).alias("b"))
    rows = tables["images"].join(g, F.col("id") == F.col("image_id"))
    return rows.select(F.col("file_name").alias("image_name"), "width", "height", F.transform("b", lambda x: F.struct(x["bbox"].alias("bbox"), x["phrase"].alias("phrase"))).alias("boxes"))


def coco_keypoints(tables: dict[str, DataFrame], names: Sequence[str]) -> DataFrame:
    """(image_id, id, name, x, y) of visible keypoints; an annotation id counts once."""
    a = tables["annotations"].where(F.col("keypoints").isNotNull()).dropDuplicates(["id", "image_id", "keypoints"]).groupBy("id").agg(F.min(F.struct("image_id", "keypoints")).alias("a"))
    at = F.posexplode(F.array(*[F.lit(n) for n in names])).alias("i", "name")
    k = a.select("id", "a.image_id", "a.keypoints", at)
    v = [F.get("keypoints", F.col("i") * 3 + j) for j in range(3)]
    return k.where(boxes.keypoint_visible(*v)).select("image_id", "id", "name", v[0].alias("x"), v[1].alias("y"))


def all_have_keypoints(doc: DataFrame, annotations: str, field: str) -> DataFrame:
    """Records all of whose annotations have the field."""
    return doc.where(F.forall(annotations, lambda a: a[field].isNotNull()))


def yolo_boxes(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """(src, pos-free) normalised boxes of `class cx cy w h` lines with their class names."""
    t = spark.read.text(path).withColumn("src", F.col("_metadata.file_path"))
    p = F.split(F.trim("value"), r"\s+")
    n = [p[i].try_cast("double") for i in range(5)]
    named = F.get(F.array(*[F.lit(x) for x in names]), n[0].cast("int"))
    box = F.array(*[boxes.clamp(x) for x in (n[1] - n[3] / 2, n[2] - n[4] / 2, n[1] + n[3] / 2, n[2] + n[4] / 2)])
    return t.where(F.size(p) >= 5).select("src", named.alias("phrase"), box.alias("bbox")).where("phrase is not null")


def labelme_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(image_name, width, height, phrase, bbox) around each shape's points."""
    r = read_document(spark, path, LABELME).select("imagePath", "imageWidth", "imageHeight", F.explode("shapes").alias("s"))
    edge = lambda f, i: f(F.transform("s.points", lambda q: q[i]))
    b = F.array(edge(F.array_min, 0), edge(F.array_min, 1), edge(F.array_max, 0), edge(F.array_max, 1))
    return r.select(F.col("imagePath").alias("image_name"), F.col("imageWidth").alias("width"), F.col("imageHeight").alias("height"), F.col("s.label").alias("phrase"), b.alias("bbox")).where("bbox[2] > bbox[0] and bbox[3] > bbox[1]")


def parallel_lists(rows: DataFrame, keep: Sequence[str], boxes_: str, labels: str) -> DataFrame:
    """Rows of two lists side by side to a row per element."""
    z = F.explode(F.arrays_zip(F.col(boxes_).alias("bbox"), F.col(labels).alias("category")))
    return rows.select(*keep, z.alias("z")).select(*keep, "z.bbox", "z.category")


def csv_with_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose second column is JSON."""
    return spark.read.schema("name string, payload string").option("escape", '"').csv(path).withColumn("payload", F.from_json("payload", schema))


def unified_boxes(rows: DataFrame) -> DataFrame:
    """(image, width, height, pos, phrase, bbox) of unified records, malformed ones skipped."""
    r = rows.select(F.coalesce("image_name", "image_path").alias("image"), "image_info.width", "image_info.height", F.posexplode("annotation.boxes").alias("pos", "b"))
    return r.where("image is not null and size(b.bbox) = 4").select("image", "width", "height", "pos", "b.phrase", "b.bbox")


def instructions(flat: DataFrame, template: Column, start: int = 0) -> DataFrame:
    """Conversations from (image, width, height, pos, phrase, bbox): phrases in order of first sight,
    boxes normalised, clipped and rendered with three places; ids from `start` in order of image."""
    b = F.struct("pos", F.transform(F.array("bbox"), lambda x: F.array(x[0] / F.col("width"), x[1] / F.col("height"), x[2] / F.col("width"), x[3] / F.col("height")))[0].alias("box"))
    # dealt by image, for both groupings
    g = flat.repartition("image").groupBy("image", "phrase").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(b)).alias("bs"))
    e = F.struct("first", F.col("phrase").alias("label"), F.transform("bs", lambda x: F.transform(x["box"], boxes.clamp)).alias("items"))
    r = g.groupBy("image").agg(F.array_sort(F.collect_list(e)).alias("es"))
    phrases = F.array_join(F.transform("es", lambda x: x["label"]), ", ")
    talk = F.array(F.struct(F.lit("human").alias("from"), F.replace(template, F.lit("{categories}"), phrases).alias("value")), F.struct(F.lit("gpt").alias("from"), text.render_boxes(F.col("es")).alias("value")))
    return dense_ids(r.select(F.array("image").alias("image"), talk.alias("conversations")), "image", start)


def write_checked(rows: DataFrame, path: str, expected: int | None = None, form: str = "json") -> int:
    """Write beside the target and rename only if the count is as expected; gives the count."""
    spark = rows.sparkSession
    staged = f"{path.rstrip('/')}.staging"
    rows.write.mode("overwrite").format(form).save(staged)
    got = spark.read.schema(rows.schema).format(form).load(staged).count()
    if expected is not None and got != expected:
        raise ValueError(f"{got} rows instead of {expected}; {staged} is kept, {path} untouched")
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    aside = f"{path.rstrip('/')}.replaced"
    fs.delete(of(aside), True)
    # the old output stays beside the new one until that one is in place
    held = fs.exists(of(path))
    if held and not fs.rename(of(path), of(aside)):
        raise OSError(f"could not move {path} aside; {staged} is kept")
    if not fs.rename(of(staged), of(path)):
        if held:
            fs.rename(of(aside), of(path))
        raise OSError(f"could not put {staged} in place; {path} is as it was")
    fs.delete(of(aside), True)
    return got


def write_split(rows: DataFrame, accepted: Column, good: str, bad: str) -> None:
    """Two outputs by a predicate; null counts as rejected."""
    ok = F.coalesce(accepted, F.lit(False))
    rows.where(ok).write.mode("overwrite").json(good)
    rows.where(~ok).write.mode("overwrite").json(bad)


def append_numbered(rows: DataFrame, path: str, order: str) -> None:
    """Append JSON lines whose ids go on from the rows already there."""
    spark = rows.sparkSession
    try:
        start = spark.read.text(path).count()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        start = 0
    dense_ids(rows, order, start).write.mode("append").json(path)


#: Box sources by name.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "coco": lambda spark, path: coco_boxes(coco_tables(read_document(spark, path, COCO))),
    "unified": lambda spark, path: unified_boxes(read_json(spark, path, UNIFIED)),
    "labelme": labelme_boxes,
    "yolo": yolo_boxes,
}
