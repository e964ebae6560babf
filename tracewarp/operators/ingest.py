"""Admission of telemetry: validation, first-wins dedupe, arrival numbers, partition keys, watermarks, lateness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def valid(df: DataFrame) -> DataFrame:
    """Rows of the known schema version with an event id."""
    return df.where((F.col("schema_version") == SCHEMA_VERSION) & (F.coalesce(F.col("event_id"), F.lit("")) != ""))


def first_arrivals(df: DataFrame, order: str, key: str = "event_id") -> DataFrame:
    """Of rows with equal ``key`` the one with the smallest ``order``; combined map-side, without sorting.

    Rows without a key are no events (see :func:`valid`) and are left out.
    """
    rows = F.struct(*(F.col(c) for c in df.columns))
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min_by(rows, F.struct(F.col(order), rows)).alias("r")).select("r.*")


def arrival_numbers(df: DataFrame, order: list[str], name: str = "ingest_sequence", ranges: int | None = None) -> DataFrame:
    """Rows numbered from 1 in the order of ``order``, without bringing them into one partition.

    The first column of ``order``, a number, is cut into ranges of about equal size. The cuts are found first and are
    constants of the plan, so that counting the rows of each range and numbering them see the same ranges, whatever
    becomes of partitions. Nulls come first.
    """
    first = F.col(order[0])
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(first, [i / n for i in range(1, n)] or [0.5], F.lit(10_000))).first()[0] or []
    cuts = sorted(set(cuts))
    marks = F.lit(cuts) if cuts else F.array().cast("array<long>")
    placed = df.withColumn("__p", F.coalesce(F.size(F.filter(marks, lambda x: x < first)), F.lit(0)))
    counts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return placed.withColumn("__n", number).join(F.broadcast(before), "__p").withColumn(name, (F.col("__n") + F.col("__before")).cast("long")).drop("__p", "__n", "__before")


def partition_key(signal: Column, service: Column, name: Column, trace_id: Column) -> Column:
    """The logical partition of an event: series for metrics, trace for spans, service for the rest."""
    s = F.coalesce(service, F.lit("unknown"))
    tagged = lambda tag, *c: F.concat_ws(":", F.lit(tag), *c)
    return (
        F.when(signal == "metric", tagged("metric", s, F.coalesce(name, F.lit(""))))
        .when(signal == "span", tagged("span", F.coalesce(trace_id, F.lit(""))))
        .when(signal == "log", tagged("log", s))
        .when(signal.isin("deployment", "configuration"), tagged("change", s))
        .when(signal.isin("alert", "annotation"), tagged("other", s))
        .when(signal == "control", F.lit("control"))
        .otherwise(tagged("misc", s))
    )


def counts_by_signal(df: DataFrame) -> DataFrame:
    """(signal, events, distinct_events, duplicates)."""
    per = df.groupBy("signal", "event_id").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("signal").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("distinct_events"))
    return out.withColumn("duplicates", F.col("events") - F.col("distinct_events"))


def with_watermark_column(df: DataFrame, partition: str, arrival: list[str], lateness_ns: int, time: str = "event_time") -> DataFrame:
    """``watermark``: the largest time that arrived in the row's partition before it, less the allowed lateness."""
    w = Window.partitionBy(partition).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("watermark", F.max(time).over(w) - F.lit(lateness_ns))


def lateness_class(time: Column, watermark: Column, grace_ns: int) -> Column:
    """on_time, late_revisable (at or before the watermark) or beyond_grace (by the grace period or more)."""
    return F.when(time <= watermark - F.lit(grace_ns), "beyond_grace").when(time <= watermark, "late_revisable").otherwise("on_time")
