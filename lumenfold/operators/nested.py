"""Values of any shape and depth: a frontier of rows that opens containers until none is left.

A value is JSON text. Each round every row of the frontier is a leaf, which is given out, or a
container, whose members are the next frontier; so depth costs rounds and nothing else, and no
value is walked through in one call. Members of an object come in order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, loose, text
from ..functions.binding import let
from ..staging import dropped, staged

_NUMBERS = r"^ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))>$"


def _kind(v: Column) -> Column:
    """Of a variant: object, numbers, array, string or other."""
    s = F.schema_of_variant(v)
    listed = F.try_variant_get(v, "$", "array<double>")
    numbers = s.rlike(_NUMBERS) & F.forall(listed, lambda x: x.isNotNull())
    return F.when(s.startswith("OBJECT"), "object").when(numbers, "numbers").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").otherwise("other")


def _member(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _members(v: Column, kind: Column) -> Column:
    """(at, key, v) of a container's members; key is null in an array."""
    member = lambda opened: lambda k, i: F.named_struct(F.lit("at"), i, F.lit("key"), k, F.lit("v"), F.element_at(opened, k))
    # opened once, not for each name
    named = let(F.try_variant_get(v, "$", "map<string,variant>"), lambda opened: F.transform(F.array_sort(F.map_keys(opened)), member(opened)))
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.named_struct(F.lit("at"), i, F.lit("key"), F.lit(None).cast("string"), F.lit("v"), x))
    return F.when(kind == "object", named).otherwise(listed)


def _start(values: DataFrame) -> DataFrame:
    """Texts that aren't JSON are strings."""
    parsed = F.try_parse_json("value")
    quoted = F.try_parse_json(F.to_json(F.struct(F.col("value").alias("t"))))
    return values.withColumn("v", F.coalesce(parsed, F.try_variant_get(quoted, "$.t", "variant")))


def walk(values: DataFrame) -> DataFrame:
    """(id, path, key, value): every member of every container, path its keys and places, value its JSON
    text. values: id, value; null values have no members."""
    kind = values.schema["id"].dataType.simpleString()
    frontier = staged(_start(values).where("v is not null").select("id", F.array().cast("array<string>").alias("path"), "v"), "frontier")
    found, used = values.sparkSession.createDataFrame([], f"id {kind}, path array<string>, key string, value string"), [frontier]
    while True:
        opened = frontier.withColumn("k", _kind(F.col("v"))).where("k in ('object', 'array', 'numbers')")
        m = opened.select("id", "path", F.explode(_members(F.col("v"), F.col("k"))).alias("m"))
        nxt = m.select("id", F.array_append("path", F.coalesce("m.key", F.col("m.at").cast("string"))).alias("path"), F.col("m.key").alias("key"), F.col("m.v").alias("v"))
        nxt = staged(nxt, "frontier")
        used.append(nxt)
        if nxt.isEmpty():
            break
        found = found.unionByName(nxt.select("id", "path", "key", F.to_json("v").alias("value")))
        frontier = nxt.select("id", "path", "v")
    out = staged(found, "members")
    for t in used:
        dropped(t)
    return out


def find_key(values: DataFrame, key: str) -> DataFrame:
    """(id, path, value) of the members of the name `key`, at any depth."""
    return walk(values).where(F.col("key") == key).select("id", "path", "value")


def categories(values: DataFrame) -> DataFrame:
    """(id, place, category_id, name, isthing) of category metadata: a list of objects or names, or an
    object of either by id. An object's own id counts before its key or place; a name that is missing
    is the id; isthing is 1 for plain names. values: id, value; null has none."""
    rows = _start(values).where("v is not null").withColumn("k", _kind(F.col("v"))).where("k in ('object', 'array', 'numbers')")
    rows = rows.select("id", F.explode(_members(F.col("v"), F.col("k"))).alias("m")).select("id", "m.*").withColumn("k", _kind(F.col("v")))
    outer = F.coalesce(F.col("key").try_cast("long"), F.col("at").cast("long"))
    inside = F.col("k") == "object"
    cid = F.when(inside, F.coalesce(_member(F.col("v"), "id", "bigint"), outer)).otherwise(outer)
    name = F.when(inside, F.coalesce(_member(F.col("v"), "name", "string"), cid.cast("string"))).otherwise(F.try_variant_get("v", "$", "string"))
    return rows.select("id", F.col("at").alias("place"), cid.alias("category_id"), name.alias("name"), F.when(inside, _member(F.col("v"), "isthing", "int")).otherwise(1).alias("isthing"))


def _texts(c: Column) -> Column:
    """(label, color, coords) of a tagged text: the boxes of a label, then its points, numbered."""
    pick = lambda rest, tag: F.transform(F.regexp_extract_all(rest, F.lit(rf"(?i)<{tag}>\s*\[([^\]]+)\]\s*</{tag}>"), F.lit(1)), loose.numbers)
    both = lambda e: F.concat(pick(e["rest"], "bbox"), pick(e["rest"], "point"))
    rows = F.transform(text._labelled(c), lambda e: F.transform(both(e), lambda v, i: F.named_struct(F.lit("label"), e["label"], F.lit("color"), i, F.lit("coords"), v)))
    return F.flatten(rows)


def _polygon(v: Column, width: Column, height: Column) -> Column:
    small = F.array_max(F.transform(v, F.abs)) <= 1.5
    side = lambda x, i: F.when(i % 2 == 0, width).otherwise(height)
    scaled = F.transform(v, lambda x, i: F.least(F.greatest(F.when(small, x * side(x, i)).otherwise(x), F.lit(0.0)), (side(x, i) - 1).cast("double")))
    return F.when((F.size(v) >= 6) & (F.size(v) % 2 == 0), scaled)


def primitives(values: DataFrame, fallback: str = "object") -> DataFrame:
    """(id, path, kind, label, color, coords, keypoints, rle): the points, boxes, polygons, keypoint
    instances and masks that a value holds, in pixels.

    values: id, value, width, height. Two numbers are a point, four a box, six or more a polygon;
    objects with bbox or keypoints are instances, with size and counts masks (rle, their JSON);
    objects with type and coords stand for their coords; texts are searched for tags. A member's
    name is its label, its place its color; what is malformed or has no extent is left out. A null
    value has none.
    """
    w, h = F.col("width"), F.col("height")
    kept = ["id", "width", "height"]
    first = _start(values).where("v is not null").select(*kept, F.array().cast("array<string>").alias("path"), F.lit(fallback).alias("label"), F.lit(0).alias("color"), "v")

    def told_apart(rows: DataFrame) -> DataFrame:
        """The rows written with their kind, k, which each step of a round filters by: else it would be found out for each."""
        has = lambda *names: sum(((F.try_variant_get("v", f"$.{n}", "variant").isNotNull()).cast("int") for n in names), F.lit(0))
        object_ = F.when(has("type", "coords") == 2, "typed").when(has("bbox", "keypoints") > 0, "instance").when(has("size", "counts") == 2, "mask").otherwise("object")
        return staged(rows.withColumn("k", _kind(F.col("v"))).withColumn("k", F.when(F.col("k") == "object", object_).otherwise(F.col("k"))), "frontier")

    frontier = told_apart(first)
    leaves, used = None, [frontier]
    number = lambda name: F.try_variant_get(F.col("v"), f"$.{name}", "array<double>")
    none = {c.split()[0]: F.lit(None).cast(" ".join(c.split()[1:])) for c in ("coords array<double>", "keypoints map<string,array<double>>", "rle string")}

    def leaf(rows: DataFrame, kind: Column, **have: Column) -> DataFrame:
        cols = {**none, **have}
        return rows.select("id", "path", kind.alias("kind"), F.col("label"), F.col("color"), cols["coords"].alias("coords"), cols["keypoints"].alias("keypoints"), cols["rle"].alias("rle"))

    while True:
        rows = frontier
        told = rows.where("k = 'string'").select(*kept, "path", F.posexplode(_texts(F.try_variant_get("v", "$", "string"))).alias("at", "t"))
        told = told.select(*kept, F.array_append("path", F.col("at").cast("string")).alias("path"), F.col("t.label").alias("label"), F.col("t.color").alias("color"), F.col("t.coords").alias("c"))
        plain = rows.where("k = 'numbers'").select(*kept, "path", "label", "color", F.try_variant_get("v", "$", "array<double>").alias("c"))
        n = F.size("c")
        lists = told.unionByName(plain).withColumn("kind", F.when(n == 2, "point").when(n == 4, "bbox").otherwise("polygon"))
        coords = F.when(n == 2, loose.pixel_point(F.col("c"), w, h)).when(n == 4, loose._box(F.col("c"), w, h)).otherwise(_polygon(F.col("c"), w, h))
        out = leaf(lists.withColumn("xy", coords).where("xy is not null"), F.col("kind"), coords=F.col("xy"))
        inst = rows.where("k = 'instance'").withColumn("box", let(number("bbox"), lambda v: loose._box(v, w, h)))
        points = F.map_entries(F.try_variant_get("v", "$.keypoints", "map<string,variant>"))
        placed = F.filter(F.transform(points, lambda e: F.named_struct(F.lit("k"), F.translate(e["key"], "_", " "), F.lit("v"), let(F.try_variant_get(e["value"], "$", "array<double>"), lambda v: loose.pixel_point(v, w, h)))), lambda e: e["v"].isNotNull())
        inst = inst.withColumn("kp", F.coalesce(F.map_from_entries(placed), F.create_map().cast("map<string,array<double>>"))).withColumn("label", F.coalesce(_member(F.col("v"), "phrase", "string"), "label"))
        out = out.unionByName(leaf(inst.where(F.col("box").isNotNull() | (F.size("kp") > 0)), F.lit("keypoint"), coords=F.col("box"), keypoints=F.col("kp")))
        out = out.unionByName(leaf(rows.where("k = 'mask'"), F.lit("mask"), rle=F.to_json("v")))
        out = staged(out, "leaves")
        leaves = out if leaves is None else leaves.unionByName(out)
        used.append(out)
        inner = rows.where("k in ('object', 'array')").select(*kept, "path", "label", F.explode(_members(F.col("v"), F.col("k"))).alias("m"))
        inner = inner.select(*kept, F.array_append("path", F.coalesce("m.key", F.col("m.at").cast("string"))).alias("path"), F.coalesce("m.key", "label").alias("label"), F.col("m.at").alias("color"), F.col("m.v").alias("v"))
        typed = rows.where("k = 'typed'").select(*kept, F.array_append("path", F.lit("coords")).alias("path"), F.coalesce(F.nullif("label", F.lit("")), F.lower(_member(F.col("v"), "type", "string"))).alias("label"), "color", F.try_variant_get("v", "$.coords", "variant").alias("v"))
        frontier = told_apart(inner.unionByName(typed))
        used.append(frontier)
        if frontier.isEmpty():
            break
    result = staged(leaves, "primitives")
    for t in used:
        dropped(t)
    return result
