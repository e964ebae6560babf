"""Service graphs and traces.

Spans are (trace_id, span_id, parent_span_id, service, operation, start_time_ns, end_time_ns, duration_ns, status,
peer_service). What needs a trace's spans together runs over partitions sorted by trace, one pass, so that a partition
holds one trace at a time however many there are. ``by`` names further key columns, as the incident's id: graphs and
traces of different keys are apart, and the keys come first in the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarp.operators import whole_traces
from tracewarp.tables import delete, stored, written

SIMILAR, COHORT, SURE = 0.5, 20, 3


def service_nodes(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(service, spans, errors, duration_ns); services only named as a peer have zero spans."""
    s = spans.where("service is not null")
    one = F.struct(F.col("service").alias("service"), F.lit(1).cast("long").alias("n"), (F.col("status") == "error").cast("long").alias("e"), F.col("duration_ns").alias("d"))
    zero = F.lit(0).cast("long")
    peer = F.struct(F.col("peer_service").alias("service"), zero.alias("n"), zero.alias("e"), zero.alias("d"))
    rows = s.select(*by, F.explode(F.when(F.col("peer_service") != F.col("service"), F.array(one, peer)).otherwise(F.array(one))).alias("x"))
    return rows.groupBy(*by, F.col("x.service").alias("service")).agg(F.sum("x.n").alias("spans"), F.sum("x.e").alias("errors"), F.sum("x.d").alias("duration_ns"))


def service_edges(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(source, target, calls, errors, duration_ns): who calls whom.

    A span with a peer service is a call of it; any other span is a call of it by its parent's service, if that is
    another and the parent came first (by start, then id). Of spans that share the parent's id the last before counts.
    """
    s = spans.where("service is not null")
    named = F.col("peer_service").isNotNull() & (F.col("peer_service") != F.col("service"))
    out = s.where(named).select(*by, F.col("service").alias("source"), F.col("peer_service").alias("target"), "status", "duration_ns")
    # Spans are sorted together with those that name them as their parent: one shuffle, and no row grows with repeated ids.
    at = F.struct("start_time_ns", "span_id").alias("at")
    itself = F.struct(F.col("span_id").alias("id"), at, F.col("service").alias("parent"), F.lit(None).cast("string").alias("service"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("ns"))
    kid = F.struct(F.col("parent_span_id").alias("id"), at, F.lit(None).cast("string").alias("parent"), "service", "status", F.col("duration_ns").alias("ns"))
    calls = ~F.coalesce(named, F.lit(False)) & F.col("parent_span_id").isNotNull()
    both = s.select(*by, F.explode(F.when(calls, F.array(itself, kid)).otherwise(F.array(itself))).alias("x")).select(*by, "x.*")
    before = Window.partitionBy(*by, "id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("source", F.last("parent", ignorenulls=True).over(before)).where("service is not null and source != service")
    out = out.unionByName(found.select(*by, "source", F.col("service").alias("target"), "status", F.col("ns").alias("duration_ns")))
    return out.groupBy(*by, "source", "target").agg(
        F.count(F.lit(1)).alias("calls"), F.sum((F.col("status") == "error").cast("long")).alias("errors"), F.sum("duration_ns").alias("duration_ns")
    )


def reach(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(service, caller): every transitive caller of a service, itself included where it is on a cycle.

    Squares the relation until it stops growing, so paths double in length each round and cycles end it. The relation
    is over services, not spans. Each round is a table in the shared folder, deleted when the next one is written.
    """
    r, path = stored(edges.select(*by, F.col("target").alias("service"), F.col("source").alias("caller")).distinct(), "reach")
    n = r.count()
    while True:
        step = r.select(*by, F.col("service").alias("caller"), F.col("caller").alias("far"))
        wider, wider_path = stored(r.union(r.join(step, [*by, "caller"]).select(*by, "service", F.col("far").alias("caller"))).distinct(), "reach")
        delete(r.sparkSession, path)
        m = wider.count()
        if m == n:
            return wider
        r, path, n = wider, wider_path, m


def trace_spans(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Spans with ``missing_parent``, and ``position`` in their trace by (start, id).

    Each span is sent to its trace twice, as itself and as what it names as its parent; there they are sorted together,
    so finding parents takes no join and all that follows by trace no further shuffle.
    """
    trace = [*by, "trace_id"]
    whole = F.struct(*(F.col(c) for c in spans.columns))
    none = F.when(F.lit(False), whole)
    both = F.array(F.struct(F.col("span_id").alias("id"), F.lit(True).alias("is"), none.alias("row")), F.struct(F.col("parent_span_id").alias("id"), F.lit(False).alias("is"), whole.alias("row")))
    placed = spans.select(*trace, F.explode(both).alias("x")).select(*trace, F.col("x.id").alias("__id"), F.col("x.is").alias("__is"), F.col("x.row").alias("__row")).repartition(*trace)
    there = F.max("__is").over(Window.partitionBy(*trace, "__id"))
    rows = placed.withColumn("__there", there).where(~F.col("__is")).select(*trace, "__there", "__row")
    missing = F.col("__row.parent_span_id").isNotNull() & ~F.col("__there")
    position = F.row_number().over(Window.partitionBy(*trace).orderBy("__row.start_time_ns", "__row.span_id"))
    return rows.withColumns({"missing_parent": missing, "position": position}).select(*(F.col(f"__row.{c}").alias(c) for c in spans.columns if c not in trace), *trace, "missing_parent", "position").select(*spans.columns, "missing_parent", "position")


def traces(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(trace_id, span_count, incomplete)."""
    return trace_spans(spans, by).groupBy(*by, "trace_id").agg(F.count(F.lit(1)).alias("span_count"), F.max("missing_parent").alias("incomplete"))


_NEEDED = ["span_id", "parent_span_id", "service", "operation", "start_time_ns", "end_time_ns", "status"]


def per_trace(spans: DataFrame, f: Callable[[pa.Table, int], list[pa.Array]], schema: str, by: Sequence[str] = ()) -> DataFrame:
    """The columns that ``f`` gives for chunks of whole traces, whose spans are in order of (start, id): the trace's keys first."""
    keys = [*by, "trace_id"]
    placed = spans.select(*keys, *_NEEDED).repartition(*keys).sortWithinPartitions(*keys, "start_time_ns", "span_id")
    whole = ", ".join(f"{k} string" for k in keys) + ", " + schema
    names, n = [c.split()[0] for c in whole.split(", ")], len(keys)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_traces.chunks(it, n):
            yield pa.RecordBatch.from_arrays(f(t, n), names)

    return placed.mapInArrow(run, whole)


def critical_segments(spans: list[dict]) -> tuple[dict | None, list[tuple[int, int, dict]]]:
    """The root of a trace and its critical path, as (start, end, span) in order of time.

    The root is the widest span without a parent in the trace (then the earliest, then the smallest id). From its end
    backwards, time belongs to the child that ends last and overlaps what is not yet given away, recursively, and
    otherwise to the span itself; nothing is given beyond a parent's own interval.
    """
    ids = {s["span_id"] for s in spans}
    kids: dict[str, list[dict]] = {}
    roots = []
    for s in spans:
        if s["parent_span_id"] in ids and s["parent_span_id"] is not None:
            kids.setdefault(s["parent_span_id"], []).append(s)
        else:
            roots.append(s)
    if not roots:
        return None, []
    root = min(roots, key=lambda s: (s["start_time_ns"] - s["end_time_ns"], s["start_time_ns"], s["span_id"]))
    found: list[tuple[int, int, dict]] = []
    # Frames of the walk: span, the end of what it may still take, and its remaining children.
    stack: list[list] = []

    def enter(span: dict, limit: int) -> None:
        end = min(span["end_time_ns"], limit)
        if end > span["start_time_ns"]:
            mine = [c for c in kids.get(span["span_id"], ()) if span["start_time_ns"] <= c["start_time_ns"] < end]
            mine.sort(key=lambda c: (-c["end_time_ns"], c["span_id"]))
            stack.append([span, end, iter(mine)])

    enter(root, root["end_time_ns"])
    while stack:
        span, cursor, rest = stack[-1]
        child = next(rest, None) if cursor > span["start_time_ns"] else None
        if child is None:
            if cursor > span["start_time_ns"]:
                found.append((span["start_time_ns"], cursor, span))
            stack.pop()
        elif child["start_time_ns"] < cursor:
            end = min(child["end_time_ns"], cursor)
            if end < cursor:
                found.append((end, cursor, span))
            stack[-1][1] = child["start_time_ns"]
            enter(child, end)
    return root, sorted(found, key=lambda x: (x[0], x[2]["span_id"]))


def trace_services(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(trace_id, service, contribution_ns, envelope_ns, failed, present, first): each trace's services.

    ``contribution_ns`` is the service's time on the critical path, null where it has none; spans without a service
    count as ``unknown``, which isn't ``present``. One row of a trace is its ``first``, so traces can be counted.
    """
    return per_trace(spans, whole_traces.services, "service string, contribution_ns long, envelope_ns long, failed boolean, present boolean, first boolean", by)


def critical_paths(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(trace_id, service, contribution_ns, envelope_ns, failed): time of each service on its traces' critical paths."""
    return trace_services(spans, by).where("contribution_ns is not null").drop("present", "first")


_SUMMARY = "operation string, start_time_ns long, root_ns long, services array<string>, failed boolean, critical_ns long, envelope_ns long"
_PATH = "path string, ordinal long, span_id string, duration_ns long"


def summaries(spans: DataFrame) -> DataFrame:
    """A row for each trace: (trace_id, operation, start_time_ns, root_ns, services, failed, critical_ns, envelope_ns).

    The first three are of its widest root, ties by id; the last two of its critical path and its root.
    """
    return per_trace(spans, whole_traces.summaries, _SUMMARY)


def roots(spans: DataFrame) -> DataFrame:
    """(trace_id, operation, start_time_ns, envelope_ns, services, failed): a trace by its widest root, ties by id."""
    return _roots(summaries(spans))


def _roots(found: DataFrame) -> DataFrame:
    return found.where("root_ns is not null").select("trace_id", "operation", "start_time_ns", F.col("root_ns").alias("envelope_ns"), "services", "failed")


def _prefix(services: Column) -> Column:
    """Of a sorted set as many members, from the first on, that any set at least ``SIMILAR`` to it shares one of them."""
    n = F.size(services)
    return F.when(n == 0, F.array(F.lit(""))).otherwise(F.slice(services, 1, (n - F.ceil(n * F.lit(SIMILAR)) + 1).cast("int")))


def healthy_cohorts(spans: DataFrame, onset_ns: int | None = None, found: DataFrame | None = None) -> DataFrame:
    """(failed_trace_id, operation, cohort, median_trace_id, confidence) for each failed trace.

    The cohort are healthy traces of the same root operation that began before the onset and share at least half of all
    services, the newest ``COHORT``. Healthy traces are first grouped by (operation, set of services), so similarity and
    the newest of a group need no pairs of traces; sets meet only where the prefixes that similar ones must share do.
    ``found`` are the :func:`summaries`, if they are there already.
    """
    r = _roots(written(summaries(spans), "summaries") if found is None else found)
    healthy = r.where(~F.col("failed")) if onset_ns is None else r.where(~F.col("failed") & (F.col("start_time_ns") < onset_ns))
    newest = F.row_number().over(Window.partitionBy("operation", "services").orderBy(F.desc("start_time_ns"), "trace_id"))
    groups = healthy.withColumn("n", newest).where(F.col("n") <= COHORT).groupBy("operation", "services").agg(
        F.collect_list(F.struct("start_time_ns", "trace_id", "envelope_ns")).alias("members")
    )
    failed = r.where("failed").select(F.col("trace_id").alias("failed_trace_id"), F.col("operation").alias("op"), F.col("services").alias("own"))
    kinds = failed.select("op", "own").distinct()
    both = F.size(F.array_intersect("own", "services")) / F.greatest(F.size(F.array_union("own", "services")), F.lit(1))
    sim = F.when((F.size("own") == 0) & (F.size("services") == 0), 1.0).otherwise(both)
    sets = groups.select("operation", "services", F.explode(_prefix(F.col("services"))).alias("shared"))
    met = kinds.select("op", "own", F.explode(_prefix(F.col("own"))).alias("shared")).join(sets.withColumnRenamed("operation", "op"), ["op", "shared"]).select("op", "own", "services").distinct()
    match = met.withColumn("sim", sim).where(F.col("sim") >= SIMILAR).join(groups.withColumnRenamed("operation", "op"), ["op", "services"])
    member = match.select("op", "own", "sim", F.explode("members").alias("m"))
    rank = F.row_number().over(Window.partitionBy("op", "own").orderBy(F.desc("m.start_time_ns"), "m.trace_id"))
    top = member.withColumn("n", rank).where(F.col("n") <= COHORT).groupBy("op", "own").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "m.trace_id"))), lambda x: x["trace_id"]).alias("cohort"),
        F.sort_array(F.collect_list(F.struct("m.envelope_ns", "m.trace_id"))).alias("by_length"),
        F.avg("sim").alias("similarity"),
    )
    out = failed.join(top, ["op", "own"], "left")
    n = F.size("by_length")
    median = F.when(n > 0, F.element_at("by_length", (F.floor(n / 2) + 1).cast("int"))["trace_id"])
    sure = F.coalesce(F.col("similarity") * F.least(n / F.lit(float(SURE)), F.lit(1.0)), F.lit(0.0))
    return out.select("failed_trace_id", F.col("op").alias("operation"), F.coalesce("cohort", F.array().cast("array<string>")).alias("cohort"), median.alias("median_trace_id"), sure.alias("confidence"))


def causal_paths(spans: DataFrame) -> DataFrame:
    """(trace_id, path, ordinal, span_id, duration_ns): each span under its path of service:operation from the root, and its number among the trace's spans of that path."""
    return per_trace(spans, whole_traces.paths, _PATH)


def paths_and_summaries(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`causal_paths` and :func:`summaries` by one pass over the spans, written."""
    both = written(per_trace(spans, whole_traces.paths_and_summaries, f"{_PATH}, {_SUMMARY}"), "paths")
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    return both.select("trace_id", *names(_PATH)), both.where("failed is not null").select("trace_id", *names(_SUMMARY))


def compare_traces(spans: DataFrame, pairs: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Span differences of (failed_trace_id, healthy_trace_id) pairs, aligned by causal path and number.

    (failed_trace_id, healthy_trace_id, path, ordinal, failed_span_id, healthy_span_id, delta_ns); delta is null where
    one side lacks the span. ``paths`` are the :func:`causal_paths`, if they are there already.
    """
    both = pairs.select("failed_trace_id", "healthy_trace_id").distinct()
    sides = both.select("*", F.explode(F.array(F.struct(F.col("failed_trace_id").alias("trace_id"), F.lit(True).alias("own")), F.struct(F.col("healthy_trace_id").alias("trace_id"), F.lit(False).alias("own")))).alias("x"))
    j = (causal_paths(spans) if paths is None else paths).join(sides.select("failed_trace_id", "healthy_trace_id", "x.*"), "trace_id")
    of = lambda own, c: F.max(F.when(F.col("own") if own else ~F.col("own"), F.col(c)))
    return j.groupBy("failed_trace_id", "healthy_trace_id", "path", "ordinal").agg(
        of(True, "span_id").alias("failed_span_id"), of(False, "span_id").alias("healthy_span_id"), (of(True, "duration_ns") - of(False, "duration_ns")).alias("delta_ns")
    )


def compare_summaries(spans: DataFrame, pairs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Per pair: excess of envelope and critical path, and services that only one side has. ``found`` are the :func:`summaries`, if they are there already."""
    per = summaries(spans) if found is None else found
    side = lambda name: per.select(F.col("trace_id").alias(f"{name}_trace_id"), *(F.col(c).alias(f"{name}_{c}") for c in ("critical_ns", "envelope_ns", "services")))
    j = pairs.select("failed_trace_id", "healthy_trace_id").distinct().join(side("failed"), "failed_trace_id").join(side("healthy"), "healthy_trace_id")
    return j.select(
        "failed_trace_id", "healthy_trace_id", (F.col("failed_envelope_ns") - F.col("healthy_envelope_ns")).alias("total_excess_ns"),
        (F.col("failed_critical_ns") - F.col("healthy_critical_ns")).alias("critical_path_delta_ns"),
        F.array_except("failed_services", "healthy_services").alias("added_services"), F.array_except("healthy_services", "failed_services").alias("removed_services"),
    )
