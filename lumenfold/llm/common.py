"""Shared plumbing: tables, the shared work folder, batches for Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..staging import dropped, folder, staged

__all__ = ["Generations", "crc_mod", "discard", "hash_unit", "materialize", "regrouped", "relax", "ship", "sifted", "small_batches", "table", "work_dir"]

#: Bits of the bitmap that sifts rows before a join, as a power of two: 2 MB, in 262,144 rows.
BITMAP = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return folder(spark)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, so a lost
    executor costs a reread and not a recomputation. Deleted by discard(), or as the driver ends."""
    return staged(df, label)


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that no later step reads."""
    dropped(df)


def small_batches(spark: SparkSession) -> None:
    """Fewer rows of long texts to a Python worker at a time, unless the session has its own number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "250")


def relax() -> None:
    """At the end of a Python task: give back what its batches took, as workers live on."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def regrouped(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of the column, or a single larger row."""
    import numpy as np
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        if not whole.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column(column)), 0), dtype=np.int64))
        start = 0
        while start < whole.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, base + limit - size, side="right"))
            if stop <= start and not held:
                stop = start + 1
            if stop > start:
                held.append(whole.slice(start, stop - start))
                size += int(ends[stop - 1]) - base
                start = stop
            if start < whole.num_rows or size >= limit:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def sifted(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose long `column` is among that of keys, by a join that moves few others: a bitmap of
    the keys, of fixed size, goes to all tasks first. Where it is too small for the keys it sifts
    less; the join behind it decides."""
    slot = F.pmod(F.col(column), F.lit(1 << BITMAP))
    words = keys.select((slot / 64).cast("int").alias("__word"), (slot % 64).cast("int").alias("bit")).groupBy("__word")
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("__bits"))  # 2^BITMAP / 64 rows at most
    held = rows.withColumn("__word", (slot / 64).cast("int")).join(F.broadcast(words), "__word")
    held = held.where(F.getbit(F.col("__bits"), (slot % 64).cast("int")) == 1).drop("__word", "__bits")
    # not a semi join: Spark would move that one below the sifting
    return held.join(keys.select(column).distinct(), column)


class Generations:
    """A bounded memo of two generations: what was used lately is kept, the rest forgotten."""

    def __init__(self, limit: int) -> None:
        self.half, self.fresh, self.stale = limit // 2, {}, {}

    def turn(self) -> None:
        """Between batches: start a new generation if the current one is full."""
        if len(self.fresh) > self.half:
            self.fresh, self.stale = {}, self.fresh

    def get(self, key):
        got = self.fresh.get(key)
        if got is None:
            got = self.stale.get(key)
            if got is not None:
                self.fresh[key] = got
        return got

    def put(self, key, value) -> None:
        self.fresh[key] = value


def crc_mod(column: str, n: int):
    """crc32 of the decimal text of an id, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def hash_unit(*columns: str):
    """A keyed uniform number in [0, 1) for deterministic bounded samples."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))
