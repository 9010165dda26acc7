"""Elements of one array in huge JSON files, each file read by many tasks.

Spark's text reader cuts a file into splits, and these at a closing brace, so a task has pieces of
text and doesn't know where in the document it stands. Two scans settle that. The first tells what
a split does to either state, inside a string or outside: the state behind it, and by how many
brackets it goes deeper. Composed over a file's splits, in order, these give every split its
start. The second cuts the elements; what a split holds of an element that began before it or goes
on behind it is put together again. A file's skeleton, its text without what the containers of the
top level hold, names the containers.

Nothing is lost in silence: elements that aren't JSON are marked, and so is the rest of a file that
ends within one. Paths are those of any file system that Spark reads.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from ..staging import staged

_ESCAPE = re.compile(r"\\.", re.DOTALL)
_TOKEN = re.compile(r'"|[{}\[\],:]')
_CLOSE = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
SKELETON, WHOLE, HEAD, MIDDLE, TAIL = range(5)


def effect(text: str, inside: bool) -> tuple[bool, int]:
    """(inside a string behind the text, brackets it goes deeper) from a state before it."""
    parts = _ESCAPE.sub("", text).split('"')
    out = "".join(parts[1 if inside else 0 :: 2])
    return inside ^ (len(parts) % 2 == 0), out.count("{") + out.count("[") - out.count("}") - out.count("]")


class Cutter:
    """Cuts a split's pieces of text from a known state: inside a string, depth of brackets. level is
    the depth of the elements."""

    def __init__(self, inside: bool, depth: int, level: int) -> None:
        self.inside, self.depth, self.level = inside, depth, level
        self.held: list[str] = []
        self.skeleton: list[str] = []
        # inherited: what comes first belongs to an element that may have begun before
        self.opened, self.inherited, self.brace = 0, depth >= level, False

    def _keep(self, text: str) -> None:
        (self.held if self.depth >= self.level else self.skeleton).append(text)

    def _end(self) -> Iterator[tuple[int, int, str]]:
        """The element that ends here; nothing between the brackets of an empty container is none."""
        text, self.held = "".join(self.held), []
        kind, self.inherited, self.brace = HEAD if self.inherited else WHOLE, False, False
        if kind == HEAD or text.strip():
            yield kind, self.opened, text

    def feed(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(kind, container, text): containers are numbered by their opening in the split, 0 being the
        one that the split begins in. text ends with its brace or is a file's last."""
        at = 0
        while at < len(text):
            if self.inside:
                m = _CLOSE.match(text, at)
                self._keep(text[at : m.end()] if m else text[at:])
                if m is None:
                    return
                self.inside, at = False, m.end()
                continue
            if self.depth > self.level and self.brace:  # only the text's last brace can close the object
                rest = text[at:]
                self.inside, more = effect(rest, False)
                self.held.append(rest)
                self.depth += more
                return
            m = _TOKEN.search(text, at)
            if m is None:
                self._keep(text[at:])
                return
            sign, before = m.group(), text[at : m.start()]
            at = m.end()
            if sign in "{[":
                if self.depth == self.level and not "".join(self.held).strip() and not before.strip():
                    self.brace = sign == "{" and not self.inherited
                self._keep(before + sign)
                self.depth += 1
                if self.depth == self.level:
                    self.opened += 1
                    self.inherited = False
            elif sign in "}]":
                if self.depth == self.level:
                    self.held.append(before)
                    yield from self._end()
                    before = ""
                self.depth -= 1
                self._keep(before + sign)
            elif sign == "," and self.depth == self.level:
                self.held.append(before)
                yield from self._end()
            else:
                self._keep(before + sign)
                self.inside = sign == '"'

    def rest(self) -> Iterator[tuple[int, int, str]]:
        """What the split's end leaves."""
        if self.depth >= self.level:
            text = "".join(self.held)
            if self.inherited:
                yield MIDDLE, self.opened, text
            else:
                yield TAIL, self.opened, text
        yield SKELETON, self.opened, "".join(self.skeleton)


def named_containers(skeleton: str, key: str | None) -> list[int]:
    """Numbers, from 1, of the containers that are arrays of the name `key` (None: the document)."""
    depth, number, last, colon, out = 0, 0, None, False, []
    level = 1 if key is None else 2
    for m in re.finditer(r'"((?:[^"\\]|\\.)*)"|[{}\[\],:]', skeleton, re.DOTALL):
        sign = m.group()
        if sign in "{[":
            depth += 1
            if depth == level:
                number += 1
                if sign == "[" and (key is None or colon and last == key):
                    out.append(number)
        elif sign in "}]":
            depth -= 1
        elif sign == ":":
            colon = True
        elif sign == ",":
            last, colon = None, False
        elif depth == 1 and not colon:
            last = json.loads(sign)
    return out


def read_array(spark: SparkSession, path: str | list[str], key: str | None = None) -> DataFrame:
    """(src, pos, value, bad): the elements of the top-level array `key` of JSON objects (None: of
    documents that are arrays), as texts, pos from 0 in each file.

    bad: the text isn't JSON, or the file ends within it. Arrays of that name further down don't
    count; a file without the array, or with another kind of value there, gives no rows; an empty
    array neither. A file with one bracket or quote too many can't be told apart behind that place.
    """
    ship(spark)
    text = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size"))
    level = 1 if key is None else 2

    def split_runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int, int], Iterator[str]]]:
        """Pieces of one split after another, a frame at a time."""
        for b in batches:
            change = (b["src"] != b["src"].shift()) | (b["at"] != b["at"].shift())
            for _, g in b.groupby(change.cumsum(), sort=False):
                yield (g["src"].iloc[0], int(g["at"].iloc[0]), int(g["size"].iloc[0])), iter(g["value"])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: dict[tuple, list] = {}
        for name, pieces in split_runs(batches):
            r = rows.setdefault(name, [False, 0, True, 0, 0, 0])
            for p in pieces:
                t = p + "}"
                (r[0], a), (r[2], b) = effect(t, r[0]), effect(t, r[2])
                r[1], r[3], r[4], r[5] = r[1] + a, r[3] + b, r[4] + len(p.encode()), r[5] + 1
        yield pd.DataFrame([(*k, *v) for k, v in rows.items()], columns=["src", "at", "size", "out_in", "out_more", "in_in", "in_more", "bytes", "pieces"])

    kinds = "src string, at long, size long, out_in boolean, out_more long, in_in boolean, in_more long, bytes long, pieces long"
    splits = staged(text.mapInPandas(look, kinds), "splits")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one file: where each split starts, and whether its last piece has its brace."""
        pdf = pdf.sort_values("at").reset_index(drop=True)
        inside, depth, out = False, 0, []
        for r in pdf.itertuples():
            out.append((r.src, r.at, inside, depth))
            inside, depth = (r.in_in, depth + r.in_more) if inside else (r.out_in, depth + r.out_more)
        spare = int(pdf["size"].iloc[0] - pdf["bytes"].sum() - (pdf["pieces"].sum() - 1))
        res = pd.DataFrame(out, columns=["src", "at", "inside", "depth"])
        res["open"] = False
        res.loc[res.index[-1], "open"] = spare != 1
        return res

    # one row for each split: a file's are few, whatever its size
    starts = splits.groupBy("src").applyInPandas(compose, "src string, at long, inside boolean, depth long, open boolean")
    starts = staged(starts, "starts")
    begun = {(r["src"], r["at"]): (r["inside"], r["depth"], r["open"]) for r in starts.toLocalIterator()}
    shared = spark.sparkContext.broadcast(begun)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, cutter, held, seq, last_open = None, None, None, 0, False

        def frame(found: list) -> pd.DataFrame:
            nonlocal seq
            out = pd.DataFrame([(name[0], name[1], seq + i, *f) for i, f in enumerate(found)], columns=["src", "at", "seq", "kind", "container", "value"])
            seq += len(found)
            return out

        def close() -> list:
            return [*cutter.feed(held + ("" if last_open else "}")), *cutter.rest()]

        for key_, pieces in split_runs(batches):
            found: list = []
            if key_ != name:
                if cutter is not None:
                    yield frame(close())
                name, seq, held = key_, 0, None
                inside, depth, last_open = shared.value[key_[0], key_[1]]
                cutter = Cutter(inside, depth, level)
            for p in pieces:
                if held is not None:
                    found += cutter.feed(held + "}")
                held = p
            yield frame(found)
        if cutter is not None:
            yield frame(close())

    pieces = staged(text.mapInPandas(cut, "src string, at long, seq long, kind int, container int, value string"), "pieces")
    order = Window.partitionBy("src").orderBy("at")
    opened = pieces.where(F.col("kind") == SKELETON).groupBy("src", "at").agg(F.max("container").alias("n"), F.max("value").alias("skeleton"))
    bases = opened.select("src", "at", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(s, n) for s, t in zip(b["src"], b["skeleton"], strict=True) for n in named_containers(t, key)], columns=["src", "number"])

    skeletons = opened.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "skeleton"))), lambda x: x["skeleton"]), "").alias("skeleton"))
    numbers = skeletons.mapInPandas(wanted, "src string, number long")
    mine = pieces.where(F.col("kind") != SKELETON).join(bases, ["src", "at"]).withColumn("number", F.col("base") + F.col("container")).join(numbers, ["src", "number"])
    # pieces of an element that spans splits: its tail, what lies between, its head
    partial = mine.where(F.col("kind") >= HEAD)
    run = Window.partitionBy("src", "number").orderBy("at", "seq")
    partial = partial.withColumn("g", F.sum((F.col("kind") == TAIL).cast("int")).over(run))
    joined = partial.groupBy("src", "number", "g").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq", "value"))), lambda x: x["value"]), "").alias("value"),
        F.max(F.col("kind") == HEAD).alias("ended"), F.max("at").alias("at"), F.min_by("seq", F.struct(-F.col("at"), "seq")).alias("seq"),
    )
    whole = mine.where(F.col("kind") == WHOLE).select("src", "number", "at", "seq", "value", F.lit(True).alias("ended"))
    every = whole.unionByName(joined.select("src", "number", "at", "seq", "value", "ended")).where(F.trim(F.translate("value", "\r\n\t", "   ")) != "")
    # places: counts by split, which are few, and numbers within a split
    counts = every.groupBy("src", "number", "at").agg(F.count("*").alias("n"))
    before = counts.select("src", "number", "at", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("number", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("src", "number", "at").orderBy("seq"))
    out = every.withColumn("k", at).join(before, ["src", "number", "at"])
    value = F.regexp_replace("value", r"^\s+|\s+$", "")
    sound = F.try_parse_json(value).isNotNull() | (value == "null")
    return out.select("src", (F.col("before") + F.col("k") - 1).alias("pos"), value.alias("value"), (~F.col("ended") | ~F.coalesce(sound, F.lit(False))).alias("bad"))
