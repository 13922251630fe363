"""Quality measures between images, and array forms of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 8
# SSIM's stabilisers for an 8-bit range.
C1 = (0.01 * 255) ** 2
C2 = (0.03 * 255) ** 2


def psnr(mse: Column) -> Column:
    """Decibels of an 8-bit range; a mean error of 0 counts as 1e-7."""
    return 20 * F.log10(F.lit(255.0)) - 10 * F.log10(F.when(mse == 0, F.lit(1e-7)).otherwise(mse))


def image_error(original: DataFrame, other: DataFrame) -> DataFrame:
    """(frame, n, mse, psnr) of two images joined by position."""
    both = original.select("frame", "x", "y", F.col("v").alias("a")).join(other.select("frame", "x", "y", F.col("v").alias("b")), ["frame", "x", "y"])
    square = ((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).cast("double")
    return both.groupBy("frame").agg(F.count("*").alias("n"), F.avg(square).alias("mse")).withColumn("psnr", psnr(F.col("mse")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def ssim(a: Column, b: Column) -> Column:
    """Similarity of two equally long arrays as one window; (co)variances are sums, not means."""
    n = F.size(a).cast("double")
    mean_a, mean_b = _sum(a) / n, _sum(b) / n
    # sums of products about the means, from plain sums, so each array is read a fixed number of times
    spread = lambda x, y, mx, my: _sum(F.zip_with(x, y, lambda p, q: p * q)) - n * mx * my
    var_a, var_b, cov = spread(a, a, mean_a, mean_a), spread(b, b, mean_b, mean_b), spread(a, b, mean_a, mean_b)
    return (2 * mean_a * mean_b + C1) * (2 * cov + C2) / ((mean_a * mean_a + mean_b * mean_b + C1) * (var_a + var_b + C2))


def frame_ssim(original: DataFrame, other: DataFrame, window: int = WINDOW) -> DataFrame:
    """(frame, windows, ssim): the mean over all whole windows of two images, as a percentage.

    Window sums come from two running sums, along rows and then along columns, so each pixel is touched
    twice whatever the window's size. Positions that either image lacks take their windows out.
    """
    both = original.select("frame", "x", "y", F.col("v").alias("a")).join(other.select("frame", "x", "y", F.col("v").alias("b")), ["frame", "x", "y"])
    terms = {"n": F.lit(1), "a": F.col("a"), "b": F.col("b"), "aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b")}
    rows = both.select("frame", "x", "y", *(v.cast("long").alias(k) for k, v in terms.items()))
    for along, across in (("x", "y"), ("y", "x")):
        w = Window.partitionBy("frame", across).orderBy(along).rangeBetween(0, window - 1)
        rows = rows.select("frame", "x", "y", *(F.sum(k).over(w).alias(k) for k in terms))
    size = float(window * window)
    mean_a, mean_b = F.col("a") / size, F.col("b") / size
    var_a, var_b, cov = F.col("aa") - size * mean_a * mean_a, F.col("bb") - size * mean_b * mean_b, F.col("ab") - size * mean_a * mean_b
    score = (2 * mean_a * mean_b + C1) * (2 * cov + C2) / ((mean_a * mean_a + mean_b * mean_b + C1) * (var_a + var_b + C2))
    return rows.where(F.col("n") == window * window).groupBy("frame").agg(F.count("*").alias("windows"), (F.avg(score) * 100).alias("ssim"))
