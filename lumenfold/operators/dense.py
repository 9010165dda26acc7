"""Depth and normal metrics: an aggregate for each sample, then plain means over samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the angular error in degrees.
ANGLES = (5.0, 7.5, 11.25, 22.5, 30.0)


def align_depth(pixels: DataFrame, by: str = "sample", disparity: bool = False, low: float = 1e-3, high: float = 1e3) -> DataFrame:
    """Replace pred by scale * pred + shift, the least squares fit of gt over a sample's valid pixels
    (of 1/gt for a disparity fit, inverted afterwards), clipped to [low, high].

    pixels: sample, gt, pred, valid. A sample whose fit is undefined keeps pred.
    """
    target = F.when(F.col("gt") > 0, 1 / F.col("gt")) if disparity else F.col("gt")
    seen = F.col("valid")
    fit = pixels.where(seen).groupBy(by).agg(F.regr_slope(target, "pred").alias("__k"), F.regr_intercept(target, F.col("pred")).alias("__c"))
    fitted = F.coalesce(F.col("pred") * F.col("__k") + F.col("__c"), F.col("pred"))
    if disparity:
        fitted = F.when(fitted > 0, 1 / fitted).otherwise(F.lit(high))
    rows = pixels.join(fit, by, "left")
    return rows.withColumn("pred", F.least(F.greatest(fitted, F.lit(low)), F.lit(high))).drop("__k", "__c")


def depth_errors(pixels: DataFrame, by: str = "sample") -> DataFrame:
    """One row per sample, over valid pixels of positive gt and pred."""
    g, p = F.col("gt"), F.col("pred")
    d, lg = p - g, F.log(p) - F.log(g)
    ratio = F.greatest(p / g, g / p)
    rows = pixels.where(F.col("valid") & (g > 0) & (p > 0))
    out = rows.groupBy(by).agg(
        F.avg(F.abs(d) / g).alias("abs_rel"), F.avg(d * d / g).alias("sq_rel"), F.sqrt(F.avg(d * d)).alias("rmse"), F.sqrt(F.avg(lg * lg)).alias("rmse_log"),
        F.avg(F.abs(F.log10(p) - F.log10(g))).alias("log10"), F.sqrt(F.avg(F.pow(1 / p - 1 / g, F.lit(2.0)))).alias("i_rmse"),
        *[F.avg((ratio < 1.25**k).cast("double")).alias(f"delta{k}") for k in (1, 2, 3)], F.avg(lg * lg).alias("__a"), F.avg(lg).alias("__b"),
    )
    silog = F.sqrt(F.greatest(F.col("__a") - F.col("__b") * F.col("__b"), F.lit(0.0))) * 100
    return out.withColumn("silog", silog).drop("__a", "__b")


def means(errors: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Plain means over samples, and their number."""
    return errors.agg(*[F.round(F.avg(c), digits).alias(c) for c in columns], F.count("*").alias("samples"))


def angle(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Degrees between two vectors; 90 if one has no length."""
    dot = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    norm = lambda v: F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))
    cos = F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))))


def normal_errors(pixels: DataFrame, by: str = "sample", digits: int = 4) -> DataFrame:
    """One row per sample: mean, median, RMSE and shares below the limits of angular error,
    each rounded. pixels: sample, err in degrees."""
    e = F.col("err")
    return pixels.groupBy(by).agg(
        F.round(F.avg(e), digits).alias("mean"), F.round(F.median(e), digits).alias("median"), F.round(F.sqrt(F.avg(e * e)), digits).alias("rmse"),
        *[F.round(F.avg((e < a).cast("double")) * 100, digits).alias(f"sub{str(a).rstrip('0').rstrip('.').replace('.', '_')}") for a in ANGLES],
    )


def inverse_depth_image(depth: DataFrame, by: str = "sample") -> DataFrame:
    """Add gray (0 to 255): inverse depth over the sample's own range of it."""
    r = depth.where("depth > 0").groupBy(by).agg((1 / F.max("depth")).alias("__lo"), (1 / F.min("depth")).alias("__hi"))
    share = F.try_divide(1 / F.col("depth") - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    return depth.join(r, by, "left").withColumn("gray", F.when(F.col("depth") > 0, F.floor(F.coalesce(share, F.lit(0.0)) * 255)).otherwise(0).cast("int")).drop("__lo", "__hi")


def psnr(pixels: DataFrame, by: str = "sample", peak: float = 1.0) -> DataFrame:
    mse = F.avg(F.pow(F.col("gt") - F.col("pred"), F.lit(2.0)))
    return pixels.groupBy(by).agg((10 * F.log10(F.try_divide(F.lit(peak * peak), mse))).alias("psnr"))


def training_losses(pixels: DataFrame, lam: float, alpha: float, by: str = "sample") -> DataFrame:
    """One row per sample over valid pixels: l1, mae_rel, and the scale-invariant log loss silog_mse with
    its scaled root silog_rmse. pixels: sample, gt, pred, valid; pred clipped from below at 1e-8."""
    g, p = F.col("gt"), F.greatest(F.col("pred"), F.lit(1e-8))
    d = F.log(p) - F.log(g)
    out = pixels.where(F.col("valid") & (g > 0)).groupBy(by).agg(
        F.avg(F.abs(F.col("pred") - g)).alias("l1"), F.avg(F.abs((F.col("pred") - g) / g)).alias("mae_rel"), (F.avg(d * d) - lam * F.avg(d) * F.avg(d)).alias("silog_mse")
    )
    return out.withColumn("silog_rmse", alpha * F.sqrt(F.greatest(F.col("silog_mse"), F.lit(0.0))))


def normal_bytes(n: Column) -> Column:
    """Three bytes of a unit normal: -1 to 1 over 0 to 255."""
    return F.transform(n, lambda v: F.floor((F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)) + 1) / 2 * 255).cast("int"))


def usable_normal(n: Column, least: float = 0.1) -> Column:
    """Whether a normal has length enough to have a direction."""
    return F.sqrt(F.aggregate(n, F.lit(0.0), lambda s, v: s + v * v)) >= least


def soundness(pixels: DataFrame, by: Sequence[str], rules: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """For each image, by rule (good, most), whether at most the share `most` of its pixels isn't good; null
    counts as not good. All rules in one aggregate."""
    return pixels.groupBy(*by).agg(*[(F.avg(F.when(good, 0.0).otherwise(1.0)) <= most).alias(name) for name, (good, most) in rules.items()])


def sound_images(pixels: DataFrame, by: Sequence[str], good: Column, most: float) -> DataFrame:
    """Pixels of the images of which at most the share `most` isn't good; null counts as not good."""
    kept = soundness(pixels, by, {"__sound": (good, most)}).where("__sound").drop("__sound")
    return pixels.join(kept, list(by), "left_semi")


def sound_depth(depth: Column, least: float, most: float) -> Column:
    """Finite, and within the range, ends included."""
    return F.coalesce(~F.isnan(depth) & (depth >= least) & (depth <= most), F.lit(False))
