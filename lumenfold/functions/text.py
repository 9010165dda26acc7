"""Names, tags, templates and parsers of model output as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .boxes import clamp

#: Endings that category names lose.
SUFFIXES = ("-merged", "-other", "-stuff", "-negative")
_PLAIN = r"\s*[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?\s*"
_NUMBER = r"\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)\s*"


def _behind(a: Column, i: Column) -> Column:
    """The elements behind place i. (A length beyond the array's would overflow behind its first place.)"""
    return F.slice(a, i + 2, F.size(a))


def normalize_category(c: Column) -> Column:
    for s in SUFFIXES:
        c = F.replace(c, F.lit(s), F.lit(""))
    return F.trim(F.lower(F.replace(c, F.lit("-"), F.lit(" "))))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}]", "")


def without_separators(c: Column) -> Column:
    return F.translate(F.lower(c), "_ ", "")


def strip_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[0-9]+$", "")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("﻿"), F.lit("")), r"\s+", " "))


def strip_task(c: Column) -> Column:
    """Without a leading <task: ...>: mark."""
    return F.regexp_replace(c, r"^\s*<task:[^>]*>:?\s*", "")


def phrases(c: Column) -> Column:
    """Texts between <p> and </p>, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<p>(.*?)</p>"), F.lit(1)), F.trim)


def without_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"\(\s*[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+\s*\)", ""))


def colours(c: Column) -> Column:
    """(phrase, r, g, b) of each `<p>phrase</p> (r, g, b)`, in order, repeats kept."""
    pattern = r"(?is)<p>(.*?)</p>\s*\(\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*\)"
    part = [F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in range(1, 5)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(part, "prgb", strict=True)])
    return F.transform(zipped, lambda z: F.struct(F.trim(z["p"]).alias("phrase"), *[z[n].cast("int").alias(n) for n in "rgb"]))


def coloured_spans(c: Column) -> Column:
    """(phrase, r, g, b) of each `<p>phrase<color>(r, g, b)</color></p>`, in order, repeats kept."""
    colour = ",".join([r"\s*([0-9]+)\s*"] * 3)
    pattern = rf"(?is)<p>(.*?)<color>\s*\({colour}\)\s*</color>\s*</p>"
    bare = lambda p: F.regexp_replace(F.regexp_replace(p, r"(?s)<.*?>", ""), r"^\s+|\s+$", "")
    # the text is searched once; the parts of what was found follow, the phrase as the last
    parts = lambda f: F.split(F.regexp_replace(f, pattern, "$2,$3,$4,$1"), ",", 4)
    span = lambda p: F.struct(bare(p[3]).alias("phrase"), *[p[i].cast("int").alias(n) for i, n in enumerate("rgb")])
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda f: let(parts(f), span))


def tagged_phrases(c: Column) -> Column:
    """Phrases of <p>...</p> without a colour, tags gone and white space collapsed, in order."""
    found = F.filter(F.regexp_extract_all(c, F.lit(r"(?is)<p>(.*?)</p>"), F.lit(1)), lambda p: ~F.contains(F.lower(p), F.lit("<color>")))
    return F.transform(found, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"(?s)<.*?>", ""), r"\s+", " ")))


def id_of_rgb(r: Column, g: Column, b: Column) -> Column:
    return r.cast("long") + 256 * g + 65536 * b


def rgb_of_id(i: Column) -> Column:
    return F.array(i % 256, F.floor(i / 256) % 256, F.floor(i / 65536) % 256)


def split_marks(c: Column, mark: str) -> Column:
    """Pieces around a literal mark such as <image>; their number less one is the marks' number."""
    return F.split(c, "\\Q" + mark + "\\E")


def mark_count(c: Column, mark: str) -> Column:
    return F.size(split_marks(c, mark)) - 1


def with_marks(c: Column, mark: str, n: Column) -> Column:
    """Marks put in front until there are n."""
    return F.concat(F.repeat(F.lit(mark), F.greatest(n - mark_count(c, mark), F.lit(0)).cast("int")), c)


def name_index(c: Column) -> Column:
    """(name, index) of `name-3`, split at the last hyphen; index null without one."""
    return F.struct(F.regexp_replace(c, r"-[0-9]+$", "").alias("name"), F.regexp_extract(c, r"-([0-9]+)$", 1).try_cast("int").alias("index"))


def frame_number(c: Column) -> Column:
    return F.regexp_extract(c, r"frame[-_]?([0-9]+)", 1).try_cast("int")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_path(path: Column) -> Column:
    """Relative, without .. steps and without a scheme."""
    return ~path.rlike(r"^/|(^|/)\.\.(/|$)|://") & (path != "")


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(c), r"\s+"), 1, n), " ")


def safe_file_name(c: Column) -> Column:
    """Letters, digits, dot and dash kept, others _, with eight digits of the MD5."""
    return F.concat(F.substring(F.regexp_replace(c, r"[^A-Za-z0-9.-]", "_"), 1, 80), F.lit("_"), F.substring(F.md5(c.cast("binary")), 1, 8))


def palette_index(c: Column, n: int) -> Column:
    return (F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def three_places(v: Column) -> Column:
    """Text with three places, rounding the exact binary value, ties to even, as printf does.

    With n the whole thousandths, v * 2000 - (2n + 1) tells up from down. v is split into two parts
    of half its digits each, whose products with 2000 are exact, so the sign is exact too.
    """

    def rounded(a: Column, n: Column) -> Column:
        high = lambda c: c - (c - a)
        side = lambda h: (h * 2000 - (n * 2 + 1)) + (a - h) * 2000
        up = lambda s: n + F.when((s > 0) | ((s == 0) & (n % 2 == 1)), 1).otherwise(0)
        return let(let(side(high(a * 134217729.0)), up), lambda k: F.lpad(k.cast("string"), F.greatest(F.length(k.cast("string")), F.lit(4)), F.lit("0")))

    digits = let(F.abs(v), lambda a: let(F.floor(a * 1000), lambda n: rounded(a, n)))
    return let(digits, lambda d: F.concat(F.when(v < 0, "-").otherwise(""), F.substr(d, F.lit(1), F.length(d) - 3), F.lit("."), F.right(d, F.lit(3))))


def _labelled(c: Column) -> Column:
    """(label, rest) of each part behind <p> that has an end tag."""
    parts = F.slice(F.split(F.rtrim(F.trim(c)), "<p>"), 2, 2147483646)
    cut = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("</p>"))), lambda p: F.struct(F.trim(F.substring_index(p, "</p>", 1)).alias("label"), F.substring(p, F.instr(p, "</p>") + 4, F.length(p)).alias("rest")))
    return cut


def _tuples(rest: Column, tag: str, n: int) -> Column:
    """Clipped number lists of <tag>[a, b, ...]</tag> with exactly n numbers, in order."""
    pattern = rf"<{tag}>\[(" + ",".join([_PLAIN] * n) + rf")\]</{tag}>"
    found = F.regexp_extract_all(rest, F.lit(pattern), F.lit(1))
    return F.transform(found, lambda t: F.transform(F.split(t, ","), lambda v: clamp(F.trim(v).cast("double"))))


def _parsed(c: Column, tag: str, n: int, normalize: bool) -> Column:
    name = normalize_category if normalize else (lambda x: x)
    entries = F.transform(_labelled(c), lambda e: F.struct(name(e["label"]).alias("label"), _tuples(e["rest"], tag, n).alias("items")))
    # a repeated label replaces the earlier one's items
    later = lambda es: lambda e, i: ~F.exists(_behind(es, i), lambda f: f["label"] == e["label"])
    return let(let(entries, lambda es: F.filter(es, lambda e: F.size(e["items"]) > 0)), lambda es: F.filter(es, later(es)))


def parse_boxes(c: Column, normalize: bool = True) -> Column:
    """(label, items) of `<p>label</p><bbox>[x0, y0, x1, y1]</bbox>...`; a repeated label keeps its last
    items; what is malformed is skipped."""
    return _parsed(c, "bbox", 4, normalize)


def parse_points(c: Column) -> Column:
    return _parsed(c, "point", 2, True)


def parse_keypoints(c: Column) -> Column:
    """(label, name, x, y) of `<p>label</p>...name<kpt>[x, y]</kpt>`, `unvisible` giving (-1, -1);
    repeated labels add up."""
    item = r"([A-Za-z][A-Za-z_ ]*?)\s*<kpt>(?:\[" + _NUMBER + "," + _NUMBER + r"\]|(unvisible))</kpt>"
    def of(e: Column) -> Column:
        names, xs, ys = (F.regexp_extract_all(e["rest"], F.lit(item), F.lit(i)) for i in (1, 2, 3))
        z = F.arrays_zip(names.alias("n"), xs.alias("x"), ys.alias("y"))
        return F.transform(z, lambda k: F.struct(normalize_category(e["label"]).alias("label"), F.trim(k["n"]).alias("name"), *[F.when(k[a] == "", -1.0).otherwise(clamp(k[a].try_cast("double"))).alias(a) for a in ("x", "y")]))

    return F.flatten(F.transform(_labelled(c), of))


def parse_loose_boxes(c: Column) -> Column:
    """Four numbers of each <bbox>, any case, brackets and spaces as they come."""
    pattern = r"(?i)<bbox>[\s\[\(]*" + r"[\s,]+".join([r"([-+]?[0-9]*\.?[0-9]+)"] * 4) + r"[\s\]\)]*</bbox>"
    cols = [F.regexp_extract_all(c, F.lit(pattern), F.lit(i + 1)) for i in range(4)]
    z = F.arrays_zip(*[x.alias(n) for x, n in zip(cols, "abcd", strict=True)])
    return F.transform(z, lambda v: F.array(*[v[n].cast("double") for n in "abcd"]))


def parse_pose(c: Column) -> Column:
    """Numbers of `<123>` tokens over 1000."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"<(-?[0-9]+)>"), F.lit(1)), lambda v: v.cast("double") / 1000)


def pose_token(v: Column) -> Column:
    n = F.bround(v * 1000).cast("long")
    return F.concat(F.lit("<"), n.cast("string"), F.lit(">"))


def render_boxes(entries: Column) -> Column:
    """The inverse of parse_boxes, three places."""
    box = lambda b: F.concat(F.lit("<bbox>["), F.array_join(F.transform(b, three_places), ", "), F.lit("]</bbox>"))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit("<p>"), e["label"], F.lit("</p>"), F.array_join(F.transform(e["items"], box), ""))), "")


def fill(template: Column, **values: Column) -> Column:
    """PHRASE, KEYPOINTS or {name} in a template replaced by texts."""
    for name, v in values.items():
        template = F.replace(F.replace(template, F.lit("{" + name + "}"), v), F.lit(name.upper()), v) if name.isupper() else F.replace(template, F.lit("{" + name + "}"), v)
    return template


def run_area(runs: Column) -> Column:
    """Pixels of a mask given by run lengths, background first."""
    return F.aggregate(F.transform(runs, lambda v, i: F.when(i % 2 == 1, v).otherwise(F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)


def run_spans(runs: Column) -> Column:
    """(start, end) of the foreground runs."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"), F.lit(0).alias("i"))

    def step(a: Column, v: Column) -> Column:
        end = a["at"] + v
        span = F.named_struct(F.lit("start"), a["at"], F.lit("end"), end)
        out = F.when((a["i"] % 2 == 1) & (v > 0), F.array_append(a["out"], span)).otherwise(a["out"])
        return F.named_struct(F.lit("at"), end, F.lit("out"), out, F.lit("i"), a["i"] + 1)

    return F.aggregate(runs, start, step, lambda a: a["out"])


def run_overlap(a: Column, b: Column) -> Column:
    """Shared pixels of two masks given by run lengths."""
    common = lambda x, y: F.greatest(F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]), F.lit(0).cast("long"))
    each = F.transform(run_spans(a), lambda x: F.aggregate(F.transform(run_spans(b), lambda y: common(x, y)), F.lit(0).cast("long"), lambda s, v: s + v))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, v: s + v)


def colour_map(c: Column) -> Column:
    """(r, g, b, phrase) of the coloured phrases, a repeated colour keeping its last phrase."""
    same = lambda e, f: (e["r"] == f["r"]) & (e["g"] == f["g"]) & (e["b"] == f["b"])
    return let(colours(c), lambda cs: F.filter(cs, lambda e, i: ~F.exists(_behind(cs, i), lambda f: same(e, f))))


def plain_caption(c: Column) -> Column:
    """A caption without tags and colours, white space collapsed, outer quotes gone."""
    bare = F.regexp_replace(F.regexp_replace(c, r"<.*?>", ""), r"\(\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\)", "")
    return F.trim(F.regexp_replace(collapse_space(bare), r"^'+|'+$", ""))


def lower_keys(m: Column) -> Column:
    """A map with lower-case keys; of keys that become equal the last one's value stays, at the first one's place."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    keys = lambda es: F.array_distinct(F.transform(es, lambda e: e["key"]))
    last = lambda es, k: F.element_at(F.filter(es, lambda e: e["key"] == k), -1)
    return F.map_from_entries(let(entries, lambda es: F.transform(keys(es), lambda k: last(es, k))))


def resolved(name: Column, aliases: dict[str, str]) -> Column:
    """The alias of an equal name, else of the first key (in order) that the name contains; else the name."""
    out = name
    for key, value in reversed(aliases.items()):
        out = F.when(F.contains(F.lower(name), F.lit(key.lower())), F.lit(value)).otherwise(out)
    for key, value in aliases.items():
        out = F.when(F.lower(name) == key.lower(), F.lit(value)).otherwise(out)
    return out


def dataset_kind(name: Column) -> Column:
    """Kind of benchmark by the prefix of its file name."""
    # fixed values: prefixes and kinds
    kinds = (("point.", "pointing"), ("visual.", "visual_prompting"), ("gui.", "gui"), ("keypoint.", "keypoint"))
    out = F.lit("Detection")
    for prefix, kind in kinds:
        out = F.when(name.startswith(prefix), F.lit(kind)).otherwise(out)
    return out


def best_name(names: Column, required: str, wanted: list[str]) -> Column:
    """Of the names that contain `required` the one with most of the wanted parts, then the shortest,
    then the first in order of text; null if none."""
    score = lambda x: sum((F.contains(x, F.lit(w)).cast("int") for w in wanted), F.lit(0))
    ranked = F.transform(F.filter(names, lambda x: F.contains(x, F.lit(required))), lambda x: F.struct((-score(x)).alias("s"), F.length(x).alias("n"), x.alias("x")))
    return F.get(F.array_sort(ranked), F.lit(0))["x"]


def media_path(path: Column, role: Column, roots: dict[str, str | None]) -> Column:
    """A path under its role's root; absolute paths and those with a scheme stay. An unknown role, or one
    without a root, is an error for a relative path, naming both."""
    own = F.lit(None).cast("string")
    for name, root in roots.items():
        if root:
            own = F.when(role == name, F.lit(root.rstrip("/") + "/")).otherwise(own)
    explicit = path.startswith("/") | F.contains(path, F.lit("://"))
    missing = F.raise_error(F.concat(F.lit("no root for role "), F.coalesce(role, F.lit("null")), F.lit(" of "), path)).cast("string")
    return F.when(path.isNull() | explicit, path).otherwise(F.concat(F.coalesce(own, missing), path))
