"""Frames of sequences: subsets by lists, and draws that are made anew until all frames will do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import dropped, staged
from .mixture import uniform


def listed_frames(frames: DataFrame, wanted: DataFrame, good: DataFrame) -> DataFrame:
    """Frames that a list names, of sequences that are good. frames, wanted: seq, frame and any other
    columns, those of both kept; good: seq. A frame that is listed twice comes twice."""
    named = wanted.join(good.select("seq").distinct(), "seq", "left_semi")
    return frames.join(named, ["seq", "frame"])


def drawn_frames(sequences: DataFrame, usable: DataFrame, length: int, attempts: int, seed: str | int) -> DataFrame:
    """(seq, attempt, frames): the first of at most `attempts` draws whose frames are all usable; both
    null for a sequence that none of its draws suits.

    sequences: seq, n (its frames are 0 to n - 1); usable: seq, frame. A draw is `length` neighbouring
    frames from a start that is a hash of seed, sequence and attempt, so draws repeat on any cluster.
    A round draws for the sequences that are still open and settles those whose frames will do, so
    rounds get smaller and there are `attempts` at most. Shorter sequences can't be drawn.
    """
    kind = sequences.schema["seq"].dataType.simpleString()
    settled = sequences.sparkSession.createDataFrame([], f"seq {kind}, attempt int, frames array<long>")
    open_, used = sequences.where(F.col("n") >= length).select("seq", "n"), []
    good = usable.select("seq", F.col("frame").cast("long").alias("frame")).distinct()
    for attempt in range(attempts):
        start = F.floor(uniform(f"{seed}-{attempt}", "seq") * (F.col("n") - length + 1))
        draw = open_.select("seq", F.posexplode(F.sequence(start, start + length - 1)).alias("k", "frame"))
        kept = draw.join(good, ["seq", "frame"]).groupBy("seq").agg(F.count("*").alias("c"), F.array_sort(F.collect_list("frame")).alias("frames"))
        won = staged(kept.where(F.col("c") == length).select("seq", F.lit(attempt).alias("attempt"), "frames"), "settled")
        rest = staged(open_.join(won, "seq", "left_anti"), "open")
        used += [won, rest]
        settled, open_ = settled.unionByName(won), rest
        if open_.isEmpty():
            break
    out = staged(sequences.select("seq").distinct().join(settled, "seq", "left").select("seq", "attempt", "frames"), "drawn")
    for t in used:
        dropped(t)
    return out
