"""What a viewer of an incident asks for at a cursor time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarp.functions.eventtime import tumble_start
from tracewarp.operators import graph, windows

SHOWN = ("lat", "err", "mem")


def at_cursor(df: DataFrame, cursor_ns: int, time: str = "event_time") -> DataFrame:
    return df.where(F.col(time) <= cursor_ns)


def _shown() -> F.Column:
    a, b, c = (F.col("name").contains(p) for p in SHOWN)
    return a | b | c


def heatmap(metrics: DataFrame, size_ns: int) -> DataFrame:
    """(service, window_start, value, n): means of the shown metrics by service and bucket."""
    m = metrics.where(_shown() & F.col("service").isNotNull())
    return m.groupBy("service", tumble_start(F.col("event_time"), size_ns).alias("window_start")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def merged_heatmap(metrics: DataFrame, size_ns: int, above: float | None = None) -> DataFrame:
    """(service, window_start, avg_value, p99, value): means beside latency p99s (of values ``above`` a bound, if given); a cell shows the p99 where it has one."""
    a = windows.window_average(metrics.where(_shown()), size_ns).select("service", "window_start", F.col("value").alias("avg_value"))
    p = windows.window_percentiles(metrics, size_ns, above=above).select("service", "window_start", "p99")
    return a.join(p, ["service", "window_start"], "full").withColumn("value", F.coalesce("p99", "avg_value"))


def number(c: F.Column) -> F.Column:
    """A double as text without a needless fraction: 1 and 1.5."""
    return F.when(c == F.floor(c), F.format_string("%.0f", c)).otherwise(c.cast("string"))


def timeline(metrics: DataFrame, logs: DataFrame, changes: DataFrame) -> DataFrame:
    """(event_time, event_id, lane, service, summary) of all signals but spans; order by the first two."""
    m = metrics.select("event_time", "event_id", F.lit("metric").alias("lane"), "service", F.concat_ws(" = ", "name", number(F.col("value"))).alias("summary"))
    lg = logs.select("event_time", "event_id", F.lit("log").alias("lane"), "service", F.concat(F.lit("["), F.coalesce("severity", F.lit("-")), F.lit("] "), "body").alias("summary"))
    kind = F.when(F.col("change_type") == "featureflag", "feature_flag").otherwise(F.col("change_type"))
    c = changes.select("event_time", "event_id", F.lit("change").alias("lane"), "service", F.concat(kind, F.lit(" "), "change_id", F.lit(" to "), F.coalesce("version_after", F.lit("?"))).alias("summary"))
    return m.unionByName(lg).unionByName(c)


def topology(spans: DataFrame, cursor_ns: int) -> tuple[DataFrame, DataFrame]:
    s = at_cursor(spans, cursor_ns, "start_time_ns")
    return graph.service_nodes(s), graph.service_edges(s)


def trace_detail(spans: DataFrame, trace_id: str, onset_ns: int | None = None) -> dict[str, DataFrame]:
    """A trace by its parts: ``spans``, the ``critical_path`` by service and, of a failed trace, its ``cohort`` and ``comparison``.

    The cohort are healthy traces like it that began before the onset, and the comparison holds its spans against those
    of the cohort's median; both are empty for a trace without a failed span.
    """
    one = spans.where(F.col("trace_id") == trace_id)
    # Only healthy traces can be in the cohort, so the other failed ones needn't be matched.
    failed = spans.groupBy("trace_id").agg(F.max(F.coalesce(F.col("status") == "error", F.lit(False))).alias("failed")).where((F.col("trace_id") != trace_id) & F.col("failed"))
    near = spans.join(failed, "trace_id", "left_anti")
    cohort = graph.healthy_cohorts(near, onset_ns).where(F.col("failed_trace_id") == trace_id)
    pairs = cohort.where("median_trace_id is not null").select("failed_trace_id", F.col("median_trace_id").alias("healthy_trace_id"))
    both = near.join(pairs.select(F.explode(F.array("failed_trace_id", "healthy_trace_id")).alias("trace_id")), "trace_id", "left_semi")
    path = graph.critical_paths(one).select("trace_id", "service", "contribution_ns", "envelope_ns")
    return {"spans": graph.trace_spans(one), "critical_path": path, "cohort": cohort, "comparison": graph.compare_traces(both, pairs)}
