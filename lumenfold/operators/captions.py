"""Caption scores: consensus of TF-IDF n-grams, and counted matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..staging import dropped, staged


#: Texts whose grams a task makes.
TEXTS = 1000


def _grams(words: Column, n: int) -> Column:
    """(n, a, b) of each gram of 1 to n words: two hashes of 64 bits tell its text from others."""

    def grams(k: int) -> Column:
        last = F.size(words) - k
        one = lambda t: F.struct(F.lit(k).alias("n"), F.xxhash64(t).alias("a"), F.xxhash64(F.lit(k), t).alias("b"))
        every = F.transform(F.sequence(F.lit(0), last), lambda i: let(F.array_join(F.slice(words, i + 1, k), " "), one))
        return F.when(last >= 0, every).otherwise(F.array().cast("array<struct<n:int,a:bigint,b:bigint>>"))

    return F.flatten(F.array(*[grams(k) for k in range(1, n + 1)]))


def cider(pairs: DataFrame, n: int = 4) -> DataFrame:
    """(image, cider): ten times the mean cosine of TF-IDF vectors of 1- to n-grams.

    pairs: image, candidate, reference; one candidate for each image, and any number of references.
    Document frequencies are the images whose references hold the n-gram. The grams of an image are
    made once, in tasks of TEXTS texts; one join gives them their frequencies.
    """
    words = lambda c: F.filter(F.split(F.lower(F.col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    candidates = pairs.where("image is not null").groupBy("image").agg(F.min("candidate").alias("candidate"))
    texts = pairs.select("image", F.xxhash64("reference").alias("rid"), words("reference").alias("w"))
    texts = staged(texts.unionByName(candidates.select("image", F.lit(None).cast("long").alias("rid"), words("candidate").alias("w"))), "texts")
    dealt = texts.repartition(1 + texts.count() // TEXTS, "image")  # a number that is given isn't lowered by the texts' bytes
    counts = dealt.select("image", "rid", F.explode(_grams(F.col("w"), n)).alias("g")).groupBy("image", "rid", "g.n", "g.a", "g.b").agg(F.count("*").cast("double").alias("tf"))
    one = F.struct("rid", "tf")
    own = counts.groupBy("image", "n", "a", "b").agg(F.max(F.when(F.col("rid").isNull(), F.col("tf"))).alias("c"), F.collect_list(F.when(F.col("rid").isNotNull(), one)).alias("refs"))
    grams = staged(own, "grams")
    images = F.log(F.lit(float(max(1, texts.where("rid is not null").select("image").distinct().count()))))
    df = grams.where(F.size("refs") > 0).groupBy("a", "b").agg(F.count("*").alias("df")).where("df > 1")  # all others: 1
    w = grams.join(df, ["a", "b"], "left").withColumn("idf", images - F.log(F.coalesce("df", F.lit(1)).cast("double")))
    w = w.withColumn("cw", F.col("c") * F.col("idf")).select("image", "n", "idf", "cw", F.explode(F.concat("refs", F.when(F.col("c").isNotNull(), F.array(F.struct(F.lit(None).cast("long").alias("rid"), F.col("c").alias("tf")))).otherwise(F.array().cast(grams.schema["refs"].dataType)))).alias("r"))
    w = w.select("image", "n", "r.rid", "cw", (F.col("r.tf") * F.col("idf")).alias("w"))
    sums = staged(w.groupBy("image", "rid", "n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.least("cw", "w") * F.when(F.col("cw").isNotNull(), F.col("w"))).alias("dot")), "sums")
    for t in (texts, grams):
        dropped(t)
    cn = sums.where("rid is null").select("image", "n", F.col("norm").alias("cn"))
    every = sums.where("rid is not null").join(cn, ["image", "n"], "left")
    sim = F.coalesce(F.try_divide("dot", F.col("norm") * F.col("cn")), F.lit(0.0))
    return every.groupBy("image", "rid").agg((F.sum(sim) / n).alias("s")).groupBy("image").agg((F.avg("s") * 10).alias("cider"))


def counted(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1, miss and false rates from summed tp, fn, fp, denominators 1 at least."""
    s = rows.agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp")], F.count("*").alias("images"))
    over = lambda a, b, c: F.col(a) / F.greatest(F.col(b) + F.col(c), F.lit(1))
    s = s.withColumn("precision", over("tp", "tp", "fp")).withColumn("recall", over("tp", "tp", "fn"))
    f = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-8))
    return s.withColumn("f1", f).withColumn("fnr", over("fn", "tp", "fn")).withColumn("fpr", over("fp", "tp", "fp"))
