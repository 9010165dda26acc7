"""Token-budget packing of weighted groups, shard by shard.

A pack closes when it reaches the soft limit; a sample that would pass the hard limit waits in a
first-in first-out buffer, which is preferred while the pack is below a threshold; samples above
their own limit are dropped. Each pack starts with one sample of every mandatory group. The order
within a shard is inherent, so a shard is the unit of work; shards become more with the samples, not larger.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .mixture import digest

#: Samples of a shard, about: key, tokens and group of one fit in a task's memory many times over.
SHARD_ROWS = 200_000


@dataclass(frozen=True)
class Limits:
    """Published defaults of the packing stream."""

    soft: int = 32768
    hard: int = 36864
    sample: int = 24064
    prefer_buffer: int = 15360
    buffer: int = 50


class Packer:
    """State of one shard: the open pack and the waiting samples."""

    def __init__(self, limits: Limits, mandatory: Iterable[str] = ()) -> None:
        self.limits, self.mandatory = limits, tuple(mandatory)
        self.open: list[tuple] = []
        self.tokens = 0
        self.waiting: deque = deque()
        self.owed: dict[str, deque] = {g: deque() for g in self.mandatory}

    def _close(self) -> list[tuple]:
        out, self.open, self.tokens = self.open, [], 0
        return out

    def _put(self, s: tuple) -> None:
        self.open.append(s)
        self.tokens += s[1]

    def _start(self) -> None:
        if not self.open:
            for q in self.owed.values():
                if q and self.tokens + q[0][1] < self.limits.hard:
                    self._put(q.popleft())

    def feed(self, samples: Iterable[tuple]) -> Iterator[list[tuple]]:
        """samples: (key, tokens, group); gives packs as lists of them."""
        for s in samples:
            if s[2] in self.owed:
                if s[1] <= self.limits.sample:
                    self.owed[s[2]].append(s)
                continue
            if s[1] > self.limits.sample:
                continue
            self._start()
            while self.waiting and self.tokens < self.limits.prefer_buffer and self.tokens + self.waiting[0][1] <= self.limits.hard:
                self._put(self.waiting.popleft())
            if self.tokens + s[1] > self.limits.hard:
                if len(self.waiting) < self.limits.buffer:
                    self.waiting.append(s)
                    continue
                yield self._close()
                self._start()
                if self.tokens + s[1] > self.limits.hard:  # the mandatory samples left no room
                    self.waiting.append(s)
                    continue
            self._put(s)
            if self.tokens >= self.limits.soft:
                yield self._close()

    def rest(self) -> Iterator[list[tuple]]:
        """What is still open or waiting, at the end."""
        while self.waiting or any(self.owed.values()):
            self._start()
            while self.waiting and self.tokens + self.waiting[0][1] <= self.limits.hard:
                self._put(self.waiting.popleft())
            yield self._close()
        if self.open:
            yield self._close()


def shards_for(samples: DataFrame, least: int = 8) -> int:
    """Shards of about SHARD_ROWS samples, so that their number, not their size, grows with the data."""
    return max(least, -(-samples.count() // SHARD_ROWS))


def pack(samples: DataFrame, shards: int | None, seed: str | int, limits: Limits = Limits(), mandatory: Iterable[str] = ()) -> DataFrame:
    """Rows (shard, pack, at, key, tokens, grp): the samples of each pack in order.

    samples: key, tokens, grp. Nothing is lost but samples above the limit of one sample. Without
    a number of shards it follows from the samples.
    """
    import pandas as pd

    shards = shards_for(samples) if shards is None else shards
    ship(samples.sparkSession)
    wanted = tuple(mandatory)
    rows = samples.select("key", "tokens", "grp", digest(seed, "key").alias("h"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "key"])
        p = Packer(limits, wanted)
        stream = zip(pdf["key"].tolist(), pdf["tokens"].tolist(), pdf["grp"].tolist(), strict=True)
        packs = [*p.feed(stream), *p.rest()]
        out = [(int(pdf["shard"].iloc[0]), n, i, *s) for n, q in enumerate(packs) for i, s in enumerate(q)]
        return pd.DataFrame(out, columns=["shard", "pack", "at", "key", "tokens", "grp"])

    kind = samples.schema["key"].dataType.simpleString()
    return rows.groupBy("shard").applyInPandas(run, f"shard int, pack int, at int, key {kind}, tokens long, grp string")


def assembled(packs: DataFrame) -> DataFrame:
    """One row per pack: keys, groups and lengths in order, each sample's offset, and position ids that
    start anew with each sample."""
    w = Window.partitionBy("shard", "pack").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = packs.withColumn("offset", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    items = F.array_sort(F.collect_list(F.struct("at", "key", "grp", "tokens", "offset")))
    return rows.groupBy("shard", "pack").agg(items.alias("items"), F.sum("tokens").alias("tokens")).select(
        "shard", "pack", "tokens",
        F.transform("items", lambda x: x["key"]).alias("keys"), F.transform("items", lambda x: x["grp"]).alias("groups"),
        F.transform("items", lambda x: x["offset"]).alias("offsets"), F.transform("items", lambda x: x["tokens"]).alias("lengths"),
    )


def lineage(packs: DataFrame) -> DataFrame:
    """Samples and tokens of each group in each pack."""
    return packs.groupBy("shard", "pack", "grp").agg(F.count("*").alias("samples"), F.sum("tokens").alias("tokens"))


def loss_weight(n, mode: str):
    """1, 1/n or 1/sqrt(n) for n trained tokens."""
    return {"token": F.lit(1.0), "sample": F.try_divide(F.lit(1.0), n), "square": F.try_divide(F.lit(1.0), F.sqrt(n))}[mode]
