"""DDSketch as grouped counts: mergeable quantiles of bounded relative error.

A value falls into bucket ``ceil(log_gamma(|v|))`` with gamma = (1 + alpha) / (1 - alpha), negative values into mirrored
buckets and tiny ones into bucket zero. A sketch is the count of each bucket, so it is built by a map-side combined
group-by, two sketches merge by adding counts, and a quantile is a running sum over at most a few thousand buckets a key.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.01
TINY = 1e-9
#: Added to bucket numbers, so that mirrored negative buckets sort below zero's.
SHIFT = 1_000_000


def gamma(alpha: float = ALPHA) -> float:
    return (1 + alpha) / (1 - alpha)


def bucket(v: Column, alpha: float = ALPHA) -> Column:
    """Signed, ordered bucket number; null for null, NaN and infinite values."""
    k = F.ceil(F.log(F.abs(v)) / F.lit(log(gamma(alpha)))).cast("long") + F.lit(SHIFT)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(finite, F.when(v > TINY, k).when(v < -TINY, -k).otherwise(F.lit(0)))


def sketch(df: DataFrame, keys: list[Column | str], value: Column, alpha: float = ALPHA) -> DataFrame:
    """(keys..., bucket, n, low, high) of the finite values; union sketches and :func:`merge` them to combine."""
    keyed = df.select(*keys, value.cast("double").alias("v")).withColumn("bucket", bucket(F.col("v"), alpha)).where("bucket is not null")
    names = [c for c in keyed.columns if c not in ("v", "bucket")]
    return keyed.groupBy(*names, "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def merge(sketches: DataFrame) -> DataFrame:
    names = [c for c in sketches.columns if c not in ("bucket", "n", "low", "high")]
    return sketches.groupBy(*names, "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def quantiles(sketches: DataFrame, qs: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """(keys..., count, and a column for each quantile): the first bucket whose running count exceeds q * (count - 1)."""
    names = [c for c in sketches.columns if c not in ("bucket", "n", "low", "high")]
    w = Window.partitionBy(*names)
    up = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sketches.withColumns({"upto": F.sum("n").over(up), "all": F.sum("n").over(w)})
    g = gamma(alpha)
    k = F.abs(F.col("bucket")) - F.lit(SHIFT)
    estimate = F.when(F.col("bucket") == 0, 0.0).otherwise(F.signum(F.col("bucket").cast("double")) * 2 * F.pow(F.lit(g), k) / (1 + g))
    run = run.withColumn("estimate", estimate)
    out = run.groupBy(*names).agg(
        F.max("all").alias("count"), F.min("low").alias("low"), F.max("high").alias("high"),
        *(F.min_by("estimate", F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("all") - 1)), F.col("bucket"))).alias(n) for n, q in qs.items()),
    )
    return out.select(*names, "count", *(F.least(F.greatest(F.col(n), "low"), F.col("high")).alias(n) for n in qs))
