"""The corpus pipeline: language ID, quality, line dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each stage's rows as
Parquet to the shared folder and reads them again as the next one's docs. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import langid, lines, packing, quality, simhash
from lumenfold.llm.common import crc_mod, discard, materialize, table

#: A document whose language is less sure than this, or that has no letter, is rejected.
LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the profiles know; und and unsure ones go."""
    profiles = langid.learn(docs, crc_mod("doc_id", 3) == 1)
    judged = langid.predict(docs.select(F.struct("*").alias("doc"), "text"), profiles)
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select("doc.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier scores at its threshold or above."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.learn(docs, labels, crc_mod("doc_id", 5) == 0)
    judged = quality.score(docs.select(F.struct("*").alias("doc"), "text"), model)
    return judged.where(F.col("score") >= quality.THRESHOLD).select("doc.*")


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop recurring lines from the texts; n_chars, where there, follows the text."""
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")])  # whatever their names
    out = lines.dedup_lines(docs.select(kept.alias("doc"), "doc_id", "text"))
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*[F.col("text") if c == "text" else length.alias(c) if c == "n_chars" else F.col("doc").getField(c).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group (five-word shingles, Jaccard 0.8 or more), that of the smallest doc_id."""
    return simhash.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 2048 tokens."""
    import public_tokenizers

    return packing.piece_rows(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("quality_classifier", good),
    ("line_dedup", without_common_lines),
    ("simhash_dedup", one_of_each),
    ("packing", packed),
]

#: Learned models can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # of a table that no stage wrote nothing is deleted
    return STAGES[-1][1](spark, docs, sf_dir)
