"""The packing stream: a file stream of samples, packs as they fill, state kept by shard.

The open pack and the waiting samples of a shard are its state, so the checkpoint takes the place
of a cursor: a query that starts again from it goes on with the next sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.packing import Limits, Packer
from ..shipping import ship

_STATE = "tokens long, open_key array<long>, open_tokens array<long>, open_grp array<string>, wait_key array<long>, wait_tokens array<long>, wait_grp array<string>, packs long"
_OUT = "shard int, pack long, keys array<long>, tokens long"


def packed_stream(samples: DataFrame, shards: int, limits: Limits = Limits()) -> DataFrame:
    """Packs (shard, pack, keys, tokens) of a stream of (key long, tokens long, grp string)."""

    ship(samples.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p, n = Packer(limits), 0
        if state.exists:
            tokens, ok, ot, og, wk, wt, wg, n = state.get
            p.tokens, p.open = tokens, list(zip(ok, ot, og, strict=True))
            p.waiting.extend(zip(wk, wt, wg, strict=True))
        rows = pd.concat(batches).sort_values("key")
        out = []
        for q in p.feed(zip(rows["key"].tolist(), rows["tokens"].tolist(), rows["grp"].tolist(), strict=True)):
            out.append((key[0], n, [s[0] for s in q], sum(s[1] for s in q)))
            n += 1
        part = lambda ss, i: [s[i] for s in ss]
        state.update((p.tokens, part(p.open, 0), part(p.open, 1), part(p.open, 2), part(p.waiting, 0), part(p.waiting, 1), part(p.waiting, 2), n))
        yield pd.DataFrame(out, columns=["shard", "pack", "keys", "tokens"])

    rows = samples.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return rows.groupBy("shard").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def rest_packs(spark: SparkSession, checkpoint: str, limits: Limits = Limits()) -> DataFrame:
    """Packs of what the shards still held open or waiting when the stream ended, read from its state.

    For the end of the input: packs go on in number behind those that the stream gave.
    """
    ship(spark)
    held = spark.read.format("statestore").load(checkpoint).select(F.col("key.*"), F.col("value.groupState.*"))
    held = held.toDF("shard", *[f.split()[0] for f in _STATE.split(", ")])

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                p = Packer(limits)
                p.tokens, p.open = int(r.tokens), list(zip(r.open_key, r.open_tokens, r.open_grp, strict=True))
                p.waiting.extend(zip(r.wait_key, r.wait_tokens, r.wait_grp, strict=True))
                for n, q in enumerate(p.rest(), int(r.packs)):
                    out.append((int(r.shard), n, [int(s[0]) for s in q], int(sum(s[1] for s in q))))
            yield pd.DataFrame(out, columns=["shard", "pack", "keys", "tokens"])

    return held.mapInPandas(rest, _OUT)


def resumed(rows: DataFrame, cursor: int, order: str) -> DataFrame:
    """Rows behind the last one seen."""
    return rows.where(F.col(order) > cursor)


def epochs(rows: DataFrame, n: int) -> DataFrame:
    """The list n times over, with its number `epoch`, for sources that don't loop."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
