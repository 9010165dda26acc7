"""Running numbers over all rows without gathering them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import dropped, staged


def in_ranges(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Add __p, the number of a row's range in the order of `by`, then `order`: a group lies in
    neighbouring ranges, so that a large one is spread. Written before, so that sampling for the
    ranges doesn't compute the rows once more, and after, as ranges are sampled; the first is
    deleted then."""
    rows = staged(rows, "rows")
    out = staged(rows.repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    dropped(rows)
    return out


def number_within(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Add each row's number in its group from 1, in order: numbers within ranges and the sums of the
    ranges before, so that a group of any size isn't one task's. Null is a group like any other."""
    ranged = in_ranges(rows, by, order)
    sizes = ranged.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    same = F.col("__p") == F.col("__q")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{i}"))
    at = F.row_number().over(Window.partitionBy(*by, "__p").orderBy(*order))
    return ranged.join(sizes, same).withColumn(name, F.col("__base") + at).select(*rows.columns, name)


def dense_ids(rows: DataFrame, order: str | list[str], start: int = 0, name: str = "id") -> DataFrame:
    """Running ids from `start` in order: rows are dealt out by range and the partitions counted, whose
    sums (one number each) give every partition its first id. The rows are written before, so that
    sampling for the ranges doesn't compute them once more, and the dealt rows after, as rows of
    equal order could be dealt otherwise by a task that runs again."""
    rows = staged(rows, "rows")
    sorted_ = staged(rows.sort(order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    dropped(rows)
    n = sorted_.groupBy("__p").agg(F.count("*").alias("n")).collect()
    upto, bases = start, {}
    for r in sorted(n, key=lambda r: r["__p"]):
        bases[r["__p"]] = upto
        upto += r["n"]
    base = F.create_map(*[F.lit(x) for kv in bases.items() for x in kv]) if bases else F.create_map(F.lit(0), F.lit(0))
    within = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.withColumn(name, (base[F.col("__p")] + within).cast("long")).drop("__p", "__m")
