"""Boxes, points and polygons as Column expressions. A box is an array [x0, y0, x1, y1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Upper end of normalised coordinates; limits of small and medium areas.
TOP, SMALL, MEDIUM = 0.999, 32.0**2, 96.0**2


def clamp(x: Column) -> Column:
    """To [0, 0.999]."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(TOP))


def xyxy(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(x, y, x + w, y + h).cast("array<double>")


def xywh(b: Column) -> Column:
    return F.array(b[0], b[1], b[2] - b[0], b[3] - b[1])


def area(b: Column) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap(a: Column, b: Column) -> Column:
    """Shared area; 0 where the boxes only touch or lie apart."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    inter = overlap(a, b)
    return F.when(inter > 0, inter / (area(a) + area(b) - inter)).otherwise(F.lit(0.0))


def crowd_iou(detection: Column, truth: Column, crowd: Column) -> Column:
    """As iou(), over the detection's own area where the truth is a crowd."""
    inter = overlap(detection, truth)
    union = F.when(crowd, area(detection)).otherwise(area(detection) + area(truth) - inter)
    return F.when(inter > 0, F.try_divide(inter, union)).otherwise(F.lit(0.0))


def size_bucket(a: Column) -> Column:
    return F.when(a < SMALL, "small").when(a < MEDIUM, "medium").otherwise("large")


def count_bucket(n: Column) -> Column:
    """Buckets of a sample's number of true boxes."""
    return F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 5, "4-5").when(n <= 10, "6-10").otherwise("11+")


def centre(b: Column) -> Column:
    return F.array((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)


def point_in_box(p: Column, b: Column) -> Column:
    """Edges count as inside."""
    return (p[0] >= b[0]) & (p[0] <= b[2]) & (p[1] >= b[1]) & (p[1] <= b[3])


def points_of(flat: Column) -> Column:
    """[x0, y0, x1, y1, ...] to an array of (x, y)."""
    at = F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1)
    return F.when(F.size(flat) >= 2, F.transform(at, lambda i: F.struct(F.get(flat, i * 2).alias("x"), F.get(flat, i * 2 + 1).alias("y"))))


def polygon_box(flat: Column) -> Column:
    """Smallest box around at least three points with extent in both directions; else null."""
    edge = lambda p, c, f: f(F.transform(p, lambda q: q[c]))
    box = let(points_of(flat), lambda p: F.array(edge(p, "x", F.array_min), edge(p, "y", F.array_min), edge(p, "x", F.array_max), edge(p, "y", F.array_max)))
    return let(box, lambda b: F.when((F.size(flat) >= 6) & (b[2] > b[0]) & (b[3] > b[1]), b))


def box_polygon(b: Column) -> Column:
    return F.array(b[0], b[1], b[2], b[1], b[2], b[3], b[0], b[3])


def polygon_area(flat: Column) -> Column:
    """Shoelace area; 0 with fewer than three points."""

    def twice(p: Column) -> Column:
        after = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
        return F.aggregate(F.zip_with(p, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)

    return F.when(F.size(flat) >= 6, F.abs(let(points_of(flat), twice)) / 2).otherwise(F.lit(0.0))


def pixels(b: Column, w: Column, h: Column) -> Column:
    """Normalised box to pixels."""
    return F.array(b[0] * w, b[1] * h, b[2] * w, b[3] * h)


def auto_scaled(b: Column, w: Column, h: Column) -> Column:
    """Numbers of at most 1.5 are normalised and are scaled to pixels; all are clipped to the image;
    null for a box without extent."""
    normal = F.array_max(F.transform(b, F.abs)) <= 1.5
    p = F.when(normal, pixels(b, w, h)).otherwise(b)
    side = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    c = F.array(side(p[0], w), side(p[1], h), side(p[2], w), side(p[3], h))
    return F.when((c[2] > c[0]) & (c[3] > c[1]), c)


def keypoint_visible(x: Column, y: Column, v: Column) -> Column:
    return ~((v <= 0) | ((x <= 0) & (y <= 0)))


def resize_plan(w: Column, h: Column, longest: int, stride: int) -> Column:
    """(width, height): long side scaled down to `longest`, both to multiples of the stride, at least one."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(w, h))
    side = lambda v: F.greatest(F.bround(v * scale / stride).cast("long"), F.lit(1)) * stride
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def image_tokens(w: Column, h: Column, stride: int) -> Column:
    return F.floor(w * h / (stride * stride))


def patch_positions(width: Column, height: Column, patch: int, side: int, interpolated: bool = False) -> Column:
    """Position ids of an image's patches, line by line, on a square of `side` patches: by their own places,
    or, interpolated, by the share of the image that lies before them."""
    rows, cols = F.floor(height / patch).cast("int"), F.floor(width / patch).cast("int")
    place = lambda i, n: F.least(F.floor(i / n * side + 1e-9), F.lit(side - 1)).cast("int") if interpolated else i
    lines = F.transform(F.sequence(F.lit(0), rows - 1), lambda y: F.transform(F.sequence(F.lit(0), cols - 1), lambda x: place(y, rows) * side + place(x, cols)))
    return F.when((rows > 0) & (cols > 0), F.flatten(lines)).otherwise(F.array().cast("array<int>"))
