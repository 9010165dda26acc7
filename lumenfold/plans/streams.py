"""Streaming queries, run to completion over the tables' files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import folder
from ..streaming import packer, rowgroups
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def stream_pack_resume(spark, sf_dir: str) -> DataFrame:
    """Events as samples of 100 to 1099 tokens, packed as a stream whose checkpoint is its cursor: it is
    started again from it, finds nothing new, and then gives out what is still open."""
    schema = table(spark, sf_dir, "events").schema
    at = f"{folder(spark)}/{uuid.uuid4().hex}"
    for _ in range(2):
        e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
        s = e.select(F.col("event_id").alias("key"), (F.lit(100) + F.col("user_id") % 1000).cast("long").alias("tokens"), F.col("event_type").alias("grp"))
        q = packer.packed_stream(s, 8).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cursor").trigger(availableNow=True).start()
        q.awaitTermination()
    packs = spark.read.schema("shard int, pack long, keys array<long>, tokens long").parquet(f"{at}/out")
    return packs.unionByName(packer.rest_packs(spark, f"{at}/cursor"))


def stream_pack_keys(spark, sf_dir: str) -> DataFrame:
    """Every event lies in exactly one pack of the stream."""
    return stream_pack_resume(spark, sf_dir).select(F.explode("keys").alias("event_id"))


QUERIES["stream_pack_resume"] = stream_pack_resume
QUERIES["stream_pack_keys"] = stream_pack_keys
ORACLES["stream_pack_keys"] = "select event_id from events"


def row_group_stream(spark, sf_dir: str) -> DataFrame:
    """Events read as a stream of row-group slices: one small batch, which ends within a row group, then a
    restart from the checkpoint for the rest, in batches of the stream's own size."""
    schema = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").schema
    at = f"{folder(spark)}/{uuid.uuid4().hex}"
    for once in (True, False):
        rows = rowgroups.row_stream(spark, f"{sf_dir}/events.parquet", schema, *((7000, 1000) if once else ()))
        w = rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cursor")
        q = (w.trigger(once=True) if once else w).start()
        q.awaitTermination() if once else q.processAllAvailable()
        q.stop()
    return spark.read.schema(schema).parquet(f"{at}/out")


QUERIES["row_group_stream"] = row_group_stream
ORACLES["row_group_stream"] = "select event_id, user_id, event_type from events"


def epoch_replay(spark, sf_dir: str) -> DataFrame:
    d = packer.epochs(table(spark, sf_dir, "documents").select("doc_id"), 3)
    return packer.resumed(d, 10, "doc_id")


QUERIES["epoch_replay"] = epoch_replay
ORACLES["epoch_replay"] = "select doc_id, e::int as epoch from documents, range(3) t(e) where doc_id > 10"
