"""Metric facts: long tables of (Key, ModelName, Task, Dataset, Metric, Value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("ModelName", "Task", "Dataset", "Metric")


def fact_key(*parts: Column | str) -> Column:
    """Parts trimmed, tabs and spaces to _, / to -, joined by two underscores."""
    clean = lambda c: F.replace(F.replace(F.replace(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("\t"), F.lit(" ")), F.lit("/"), F.lit("-")), F.lit(" "), F.lit("_"))
    return F.concat_ws("__", *[clean(p) for p in parts])


def facts(wide: DataFrame, model: str, task: str, dataset: str, metrics: Sequence[str]) -> DataFrame:
    """One fact per dataset and metric; null values give none."""
    out = wide.select(F.lit(model).alias("ModelName"), F.lit(task).alias("Task"), F.col(dataset).cast("string").alias("Dataset"), *[F.col(m).cast("double") for m in metrics])
    long = out.unpivot(["ModelName", "Task", "Dataset"], list(metrics), "Metric", "Value").where("Value is not null")
    return long.select(fact_key(*FIELDS).alias("Key"), *FIELDS, "Value")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; of rows of equal order the largest by its columns in turn."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(whole, F.struct(F.col(order), whole)).alias("__r")).select("__r.*")


def pivoted(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return rows.groupBy("ModelName", "Task", "Dataset").pivot("Metric", list(metrics)).agg(F.max("Value"))


def shown_score(v: Column) -> Column:
    """Text of a score: values up to 1 are shares and become percents; two places, no trailing zeros."""
    text = F.round(F.when(v <= 1.0, v * 100).otherwise(v), 2).cast("decimal(20,2)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def to_number(text: Column) -> Column:
    """Double of a text; null for nan, none, null and what is no number."""
    t = F.lower(F.trim(text))
    return F.when(~t.isin("nan", "none", "null", ""), t.try_cast("double"))


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A table for reading. It is a report, so more than `limit` rows raise and none is dropped."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows for a report; aggregate them, or raise the limit")
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    return "\n".join([head, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got]])


def widened(old: DataFrame, new: DataFrame) -> DataFrame:
    """Appended rows whose columns may have grown; missing ones are null."""
    return old.unionByName(new, allowMissingColumns=True)


def append_rows(new: DataFrame, path: str) -> None:
    """Add rows to a CSV table with a header, as they are, repeats too. Columns may have grown; all are
    texts then, and the table is written anew beside the old one before it takes its place."""
    from ..staging import dropped, staged

    spark = new.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    texts = new.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in new.columns])
    if files.exists(target):
        texts = widened(spark.read.option("header", True).csv(path), texts)
    whole = staged(texts, "appended")
    whole.write.mode("overwrite").option("header", True).csv(path)
    dropped(whole)
