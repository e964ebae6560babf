"""Event-time windows in batch: the last revision of what the streaming operators emit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarp.functions.ddsketch import quantiles, sketch
from tracewarp.functions.eventtime import hop_starts, tumble_start

P = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _windowed(df: DataFrame, size_ns: int, slide_ns: int | None) -> DataFrame:
    fine = df.where(F.col("service").isNotNull() & F.col("value").isNotNull() & F.col("event_time").isNotNull())
    if slide_ns is None:
        return fine.withColumn("window_start", tumble_start(F.col("event_time"), size_ns))
    return fine.withColumn("window_start", F.explode(hop_starts(F.col("event_time"), size_ns, slide_ns)))


def window_average(metrics: DataFrame, size_ns: int, slide_ns: int | None = None) -> DataFrame:
    """(service, window_start, window_end, value, n): the mean of each service's values; without a slide, windows tumble."""
    out = _windowed(metrics, size_ns, slide_ns).groupBy("service", "window_start").agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return out.select("service", "window_start", (F.col("window_start") + size_ns).alias("window_end"), "value", "n")


def window_percentiles(metrics: DataFrame, size_ns: int, slide_ns: int | None = None, part: str = "lat", above: float | None = None) -> DataFrame:
    """(service, window_start, window_end, count, p50, p95, p99) by sketch of the metrics whose name contains ``part``, of all values or of those ``above`` a bound."""
    shown = F.col("name").contains(part) if above is None else F.col("name").contains(part) & (F.col("value") > above)
    w = _windowed(metrics.where(shown), size_ns, slide_ns)
    out = quantiles(sketch(w, ["service", "window_start"], F.col("value")), P)
    return out.select("service", "window_start", (F.col("window_start") + size_ns).alias("window_end"), "count", *P)


def lifecycle(df: DataFrame, size_ns: int, grace_ns: int, watermark: DataFrame) -> DataFrame:
    """Windows of :func:`window_average` with ``finalized`` (the watermark passed the end) and ``live`` (kept in state).

    ``watermark`` is a frame of one row and column, so that it is found in the same job.
    """
    out = window_average(df, size_ns).join(F.broadcast(watermark.toDF("__wm")))
    end = F.col("window_end")
    return out.withColumns({"finalized": end <= F.col("__wm"), "live": end + grace_ns > F.col("__wm")}).drop("__wm")
