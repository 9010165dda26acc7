"""Loose parsers: keypoints by a vocabulary of names, visual prompts, categories of a prompt."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import boxes, text
from .binding import let

# Names of the keypoints of two public data sets.
PERSON = (
    "nose", "left eye", "right eye", "left ear", "right ear", "left shoulder", "right shoulder", "left elbow", "right elbow", "left wrist", "right wrist",
    "left hip", "right hip", "left knee", "right knee", "left ankle", "right ankle",
)
ANIMAL = (
    "left eye", "right eye", "nose", "neck", "root of tail", "left shoulder", "left elbow", "left front paw", "right shoulder", "right elbow", "right front paw",
    "left hip", "left knee", "left back paw", "right hip", "right knee", "right back paw",
)
# What a context says of the skeleton, and names that only one of them has.
CONTEXTS = (("animal", "animal"), ("ap-10k", "animal"), ("ap10k", "animal"), ("human", "human"), ("person", "human"), ("coco", "human"))
TELLING = (
    ("animal", ("root of tail", "left front paw", "right front paw", "left back paw", "right back paw")),
    ("human", ("left wrist", "right wrist", "left ankle", "right ankle", "left ear", "right ear")),
)

_NAMES = tuple(sorted({*PERSON, *ANIMAL}, key=lambda n: (-len(n), n)))


def numbers(c: Column) -> Column:
    """A comma-separated list as doubles; null if any part isn't a number."""
    values = F.transform(F.split(c, ","), lambda v: F.trim(v).try_cast("double"))
    return let(values, lambda v: F.when(F.forall(v, lambda x: x.isNotNull()), v))


def pixel_point(v: Column, width: Column, height: Column) -> Column:
    """[x, y] in the image: numbers of at most 1.5 are shares of it; null unless there are two."""
    small = F.array_max(F.transform(v, F.abs)) <= 1.5
    side = lambda i, size: F.least(F.greatest(F.when(small, v[i] * size).otherwise(v[i]), F.lit(0.0)), (size - 1).cast("double"))
    return F.when(F.size(v) == 2, F.array(side(0, width), side(1, height)))


def known_name(name: Column, names: Sequence[str] = _NAMES) -> Column:
    """The longest of the names that a cleaned text ends with; null if none."""
    every = F.array(*[F.lit(n) for n in sorted(names, key=lambda n: (-len(n), n))])
    return let(name, lambda c: F.get(F.filter(every, lambda n: c.endswith(n)), F.lit(0)))  # else it would be cleaned for each name


def _clean(c: Column) -> Column:
    bare = F.translate(F.regexp_replace(c, r"(?s)<.*?>", " "), ":=", "  ")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ ,;.\-]+|[ ,;.\-]+$", ""))


def _entries(names: Column, coords: Column) -> Column:
    """(name, xy) of parallel lists, xy null unless there are two numbers."""
    rows = F.transform(F.arrays_zip(names.alias("n"), coords.alias("c")), lambda z: F.struct(z["n"].alias("name"), numbers(z["c"]).alias("xy")))
    return F.transform(rows, lambda e: e.withField("xy", F.when(F.size(e["xy"]) == 2, e["xy"])))


def _box(v: Column, width: Column, height: Column) -> Column:
    return F.when(F.size(v) == 4, boxes.auto_scaled(v, width.cast("double"), height.cast("double")))


def segment_keypoints(segment: Column, names: Sequence[str] = _NAMES) -> Column:
    """(name, xy) of one instance's text, a row for each name: `left wrist<kpt>[x, y]</kpt>`, where text
    before the name doesn't matter and the last of a name counts, else the first `left wrist: [x, y]`."""
    bare = F.regexp_replace(segment, r"(?i)<bbox>\s*\[[^\]]+\]\s*</bbox>", " ")
    tagged = r"(?is)([^<>]*?)<kpt>\s*\[([^\]]+)\]\s*</kpt>"
    one = F.transform(F.regexp_extract_all(bare, F.lit(tagged), F.lit(1)), lambda n: known_name(_clean(n), names))
    first = F.filter(_entries(one, F.regexp_extract_all(bare, F.lit(tagged), F.lit(2))), lambda e: e["name"].isNotNull() & e["xy"].isNotNull())
    choice = "|".join(re.escape(n).replace(r"\ ", " ") for n in sorted(names, key=lambda n: (-len(n), n)))
    written = rf"(?i)\b({choice})\b\s*[:=]?\s*\[([^\]]+)\]"
    plain = F.transform(F.regexp_extract_all(bare, F.lit(written), F.lit(1)), F.lower)
    other = _entries(plain, F.regexp_extract_all(bare, F.lit(written), F.lit(2)))

    def join(a: Column) -> Column:
        last = F.filter(a, lambda e, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda f: f["name"] == e["name"]))
        return let(other, lambda o: F.concat(last, F.filter(o, lambda e, i: e["xy"].isNotNull() & ~F.exists(a, lambda f: f["name"] == e["name"]) & ~F.exists(F.slice(o, 1, i), lambda f: f["name"] == e["name"]))))

    return let(first, join)


def skeleton(names: Column, context: Column) -> Column:
    """Kind of skeleton by the context, else by names that one alone has; else the context, in lower case."""
    told = F.coalesce(F.lower(context), F.lit(""))
    out = told
    for kind, some in reversed(TELLING):
        out = F.when(F.arrays_overlap(names, F.array(*[F.lit(n) for n in some])), F.lit(kind)).otherwise(out)
    for part, kind in reversed(CONTEXTS):
        out = F.when(F.contains(told, F.lit(part)), F.lit(kind)).otherwise(out)
    return out


def parse_loose_keypoints(c: Column, width: Column, height: Column, context: Column) -> Column:
    """(label, bbox, keypoints of (name, xy), kind) of each instance: <ins> spans of a label, or all of
    its text where there are none; coordinates in pixels, what is malformed left out."""
    label = lambda e: F.trim(F.regexp_replace(e["label"], r"\s+", " "))
    spans = lambda e: let(F.regexp_extract_all(e["rest"], F.lit(r"(?is)<ins>(.*?)</ins>"), F.lit(1)), lambda s: F.when(F.size(s) > 0, s).when(e["rest"].rlike(r"(?i)<kpt>|<bbox>"), F.array(e["rest"])).otherwise(F.array().cast("array<string>")))

    def instance(name: Column, s: Column) -> Column:
        box = let(numbers(F.regexp_extract(s, r"(?i)<bbox>\s*\[([^\]]+)\]\s*</bbox>", 1)), lambda v: _box(v, width, height))
        points = F.transform(segment_keypoints(s), lambda e: F.struct(e["name"].alias("name"), pixel_point(e["xy"], width, height).alias("xy")))
        kind = lambda p: skeleton(F.transform(p, lambda e: e["name"]), context)
        return let(points, lambda p: F.named_struct(F.lit("label"), name, F.lit("bbox"), box, F.lit("keypoints"), p, F.lit("kind"), kind(p)))

    every = F.flatten(F.transform(text._labelled(c), lambda e: F.transform(spans(e), lambda s: instance(label(e), s))))
    return F.filter(every, lambda i: i["bbox"].isNotNull() | (F.size(i["keypoints"]) > 0))


def visual_prompts(c: Column, width: Column, height: Column) -> Column:
    """(kind, coords) of <bbox>[...]</bbox> and <point>[...]</point> in a question, in pixels, in order."""
    pattern = r"(?i)<(bbox|point)>\s*\[([^\]]+)\]\s*</\1>"
    kinds, values = (F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in (1, 2))
    rows = F.transform(F.arrays_zip(F.transform(kinds, F.lower).alias("k"), F.transform(values, numbers).alias("v")), lambda z: F.named_struct(
        F.lit("kind"), z["k"], F.lit("coords"), F.when(z["k"] == "bbox", _box(z["v"], width, height)).otherwise(pixel_point(z["v"], width, height))
    ))
    return F.filter(rows, lambda r: r["coords"].isNotNull())


def prompt_categories(c: Column, marks: Sequence[str] = ("point", "box", "scribble", "mask")) -> Column:
    """Texts of <p>...</p> as they are, then the marks (fixed values) that the prompt has as tags."""
    found = F.regexp_extract_all(c, F.lit("<p>(.*?)</p>"), F.lit(1))
    return F.concat(found, *[F.when(F.contains(c, F.lit(f"<{m}>")), F.array(F.lit(m))).otherwise(F.array().cast("array<string>")) for m in marks])


def parse_as(kind: str, c: Column, normalize: bool = True) -> Column:
    """The strict parser of a kind: bbox, point or keypoint."""
    parsers = {"bbox": lambda: text.parse_boxes(c, normalize), "point": lambda: text.parse_points(c), "keypoint": lambda: text.parse_keypoints(c)}
    if kind not in parsers:
        raise ValueError(f"no parser for {kind}")
    return parsers[kind]()
