"""Root-cause inference: baselines, anomaly intervals, features, ranking, evidence, evaluation.

All tables carry ``incident_id``, so any number of incidents is one job; it is a key of every join and group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarp.operators import graph
from tracewarp.tables import written

WINDOW, WARM = 32, 5
LIMIT = 8.0
ENTER, ENTER_COUNT, EXIT, EXIT_COUNT = 3.0, 2, 1.5, 2
CHANGE_WINDOW_NS, LOG_WINDOW_NS, LOGS_FULL = 600_000_000_000, 60_000_000_000, 3
#: Feature columns with their weights, in the order in which the score adds them up.
WEIGHTS: dict[str, float] = {
    "anomaly_strength": 0.20, "temporal_precedence": 0.15, "failed_trace_coverage": 0.15, "critical_path_contribution": 0.15, "downstream_impact": 0.10,
    "topology_consistency": 0.10, "change_proximity": 0.10, "log_evidence": 0.05, "contradiction_penalty": -0.10,
}
#: Which weights an ablation sets to zero.
ABLATIONS: dict[str, tuple[str, ...]] = {
    "no_temporal_precedence": ("temporal_precedence",), "no_traces": ("failed_trace_coverage", "critical_path_contribution"),
    "no_topology": ("downstream_impact", "topology_consistency"), "no_change": ("change_proximity",), "no_logs": ("log_evidence",), "no_contradiction": ("contradiction_penalty",),
}
SERIES = ["incident_id", "service", "name"]


def _median(sorted_array: Column) -> Column:
    n = F.size(sorted_array)
    low, high = F.floor((n - 1) / 2).cast("int") + 1, F.floor(n / 2).cast("int") + 1
    return (F.element_at(sorted_array, low) + F.element_at(sorted_array, high)) / 2


def robust_z(metrics: DataFrame, series: list[str] = SERIES) -> DataFrame:
    """Finite samples with ``baseline_n``, ``median`` and ``z``, from the up to 32 samples of the series before each.

    z is 0.6745 (x - median) / MAD, or with the mean deviation 0.7979 (x - median) / mean, or, of a constant baseline, 0
    where x equals it and else 8 with the sign of the difference; clamped to +-8 and null before 5 samples.
    """
    v = F.col("value")
    fine = metrics.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    w = Window.partitionBy(*series).orderBy("event_time", "event_id").rowsBetween(-WINDOW, -1)
    b = fine.withColumn("__b", F.sort_array(F.collect_list("value").over(w)))
    warm = F.size("__b") >= WARM
    b = b.withColumns({"baseline_n": F.size("__b"), "median": F.when(warm, _median(F.col("__b")))})
    b = b.withColumn("__d", F.when(warm, F.sort_array(F.transform("__b", lambda x: F.abs(x - F.col("median"))))))
    mean = F.aggregate("__d", F.lit(0.0), lambda a, x: a + x) / F.size("__d")
    b = b.withColumns({"__mad": _median(F.col("__d")), "__mean": mean, "__x": v - F.col("median")})
    flat = F.when(F.abs("__x") <= 1e-9, 0.0).otherwise(F.signum("__x") * LIMIT)
    z = F.when(F.col("__mad") > 0, 0.6745 * F.col("__x") / F.nullif("__mad", F.lit(0.0))).when(F.col("__mean") > 0, 0.7979 * F.col("__x") / F.nullif("__mean", F.lit(0.0))).otherwise(flat)
    b = b.withColumn("z", F.when(warm, F.greatest(F.least(z, F.lit(LIMIT)), F.lit(-LIMIT))))
    return b.drop("__b", "__d", "__mad", "__mean", "__x")


class Hysteresis:
    """Anomaly intervals of one series, fed in order of time; used by the batch and the streaming path alike."""

    def __init__(self):
        self.entering: list[tuple[int, float, str]] = []
        self.open: dict | None = None
        self.exiting = 0

    def push(self, t: int, z: float | None, ref: str) -> dict | None:
        """The interval that this sample closes, if any. Samples without z change nothing."""
        if z is None:
            return None
        size = abs(z)
        if self.open is not None:
            if size < EXIT:
                self.exiting += 1
                if self.exiting >= EXIT_COUNT:
                    done, self.open, self.exiting = self.open | {"closed": True}, None, 0
                    return done
            else:
                self.exiting, o = 0, self.open
                o.update(end_ns=t, sample_count=o["sample_count"] + 1, peak_abs_z=max(o["peak_abs_z"], size))
                o["source_refs"].append(ref)
        elif size >= ENTER:
            self.entering.append((t, size, ref))
            if len(self.entering) >= ENTER_COUNT:
                e, self.entering, self.exiting = self.entering, [], 0
                self.open = {"start_ns": e[0][0], "end_ns": t, "peak_abs_z": max(x[1] for x in e), "sample_count": len(e), "closed": False, "source_refs": [x[2] for x in e]}
        else:
            self.entering = []
        return None


_INTERVAL = "start_ns long, end_ns long, peak_abs_z double, sample_count long, closed boolean, source_refs array<string>"


def anomaly_intervals(scored: DataFrame, series: list[str] = SERIES) -> DataFrame:
    """(series..., start_ns, end_ns, peak_abs_z, sample_count, closed, source_refs) of :func:`robust_z` samples."""
    rows = scored.select(*series, "event_time", "z", "event_id").where("z is not null")
    placed = rows.repartition(*series).sortWithinPartitions(*series, "event_time", "event_id")
    fields = pa.schema([*((c, pa.string()) for c in series), ("start_ns", pa.int64()), ("end_ns", pa.int64()), ("peak_abs_z", pa.float64()), ("sample_count", pa.int64()), ("closed", pa.bool_()), ("source_refs", pa.list_(pa.string()))])
    n = len(series)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, Hysteresis()
        for b in it:
            out = []
            for *k, t, z, ref in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if h.open:
                        out.append(dict(zip(series, key)) | h.open)
                    key, h = k, Hysteresis()
                if done := h.push(t, z, ref):
                    out.append(dict(zip(series, k[:n])) | done)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=fields)
        if h.open:
            yield pa.RecordBatch.from_pylist([dict(zip(series, key)) | h.open], schema=fields)

    return placed.mapInArrow(run, ", ".join(f"{c} string" for c in series) + ", " + _INTERVAL)


def onsets(intervals: DataFrame) -> DataFrame:
    """(incident_id, service, onset_ns, last_ns, peak_abs_z, anomalous_ns)."""
    return intervals.groupBy("incident_id", "service").agg(
        F.min("start_ns").alias("onset_ns"), F.max("end_ns").alias("last_ns"), F.max("peak_abs_z").alias("peak_abs_z"), F.sum(F.greatest(F.col("end_ns") - F.col("start_ns"), F.lit(0))).alias("anomalous_ns")
    )


@dataclass
class Incident:
    """The telemetry of one incident or of many: four tables with ``incident_id``."""

    metrics: DataFrame
    spans: DataFrame
    logs: DataFrame
    changes: DataFrame


KEY = ["incident_id", "service"]
_TRACE = ["incident_id", "trace_id"]


def intervals_of(data: Incident) -> DataFrame:
    return anomaly_intervals(robust_z(data.metrics.where("service is not null")))


def severe(logs: DataFrame) -> DataFrame:
    return logs.where(F.lower("severity_text").isin("error", "fatal") | (F.col("severity_number") >= 17))


def _merged(parts: list[DataFrame], **how: Column) -> DataFrame:
    """Rows of all parts by (incident, service), brought together by one shuffle: a column is from the part that has it."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy(*KEY).agg(*(how.get(c, F.max(c)).alias(c) for c in out.columns if c not in KEY))


def features(data: Incident, intervals: DataFrame | None = None) -> DataFrame:
    """A row for each service of each incident: the ten features, and what they rest on.

    Traces, changes and logs are counted here and named only by :func:`evidence_refs`, so that no row grows with them.
    The passes over the telemetry are: intervals by series, spans by trace, edges, and the join of changes and logs
    with the services; all else is as large as the services are many.
    """
    found = intervals_of(data) if intervals is None else intervals
    on = written(onsets(found), "onsets")
    # Who is there: services of any signal, peers included, with their onsets.
    peers = data.spans.where("service is not null").select("incident_id", F.explode(F.array_compact(F.array("service", F.when(F.col("peer_service") != F.col("service"), F.col("peer_service"))))).alias("service"))
    names = [df.select(*KEY).where("service is not null").distinct() for df in (peers, data.metrics, data.logs, data.changes)]
    each = Window.partitionBy("incident_id")
    base = _merged([*names, on]).withColumns({
        "incident_onset": F.min("onset_ns").over(each), "incident_end": F.max("last_ns").over(each), "anomalous_n": F.count("onset_ns").over(each), "services_n": F.count(F.lit(1)).over(each),
        "earlier": F.when(F.col("onset_ns").isNotNull(), F.rank().over(each.orderBy(F.col("onset_ns").asc_nulls_last())) - 1),
    })
    base = written(base.withColumn("at", F.coalesce("onset_ns", "incident_onset")), "services")

    # Traces: presence in failed ones, and time on critical paths beyond that in healthy ones.
    paths = written(graph.trace_services(data.spans, ["incident_id"]), "trace-services")
    usual = paths.where("not failed and contribution_ns is not null").groupBy(*KEY).agg(F.avg(F.col("contribution_ns").cast("double")).alias("usual"))
    over = F.when(F.col("contribution_ns").isNotNull(), F.greatest(F.col("contribution_ns") - F.coalesce("usual", F.lit(0.0)), F.lit(0.0)))
    traced = paths.where("failed").join(usual, KEY, "left").groupBy(*KEY).agg(
        F.sum(F.col("present").cast("long")).alias("covered"), F.sum(over).alias("excess"), F.sum(F.col("first").cast("long")).alias("failed_first")
    )
    traced = traced.withColumns({"all_excess": F.sum("excess").over(each), "failed_n": F.sum("failed_first").over(each)}).where(F.col("service").isNotNull())

    # Who calls a service, directly or not, and is anomalous.
    sick = base.where("onset_ns is not null").select(*KEY, "onset_ns")
    reach = graph.reach(graph.service_edges(data.spans, ["incident_id"]), ["incident_id"])
    theirs = sick.select("incident_id", F.col("service").alias("caller"), F.col("onset_ns").alias("their_onset"))
    own = sick.select(*KEY, F.col("onset_ns").alias("own_onset"))
    hit = reach.join(theirs, ["incident_id", "caller"]).join(own, KEY, "left").groupBy(*KEY).agg(
        F.sort_array(F.collect_set("caller")).alias("impacted"), F.sort_array(F.collect_set(F.when(F.col("their_onset") < F.col("own_onset"), F.col("caller")))).alias("preceding")
    )

    near = base.where("at is not null").select(*KEY, "at")
    delay = F.col("at") - F.col("event_time")
    ch = near.join(data.changes.select(*KEY, "event_time"), KEY).where(delay.between(0, CHANGE_WINDOW_NS)).groupBy(*KEY).agg(F.max(1 - delay / F.lit(float(CHANGE_WINDOW_NS))).alias("proximity"))
    lg = near.join(severe(data.logs).select(*KEY, "event_time"), KEY).where(F.abs(delay) <= LOG_WINDOW_NS).groupBy(*KEY).agg(F.count(F.lit(1)).alias("logs_n"))
    all_ = _merged([base, traced.drop("failed_first"), hit, ch, lg]).where("services_n is not null")
    # An incident's numbers are on the rows of its failed services only.
    all_ = all_.withColumns({"failed_n": F.max("failed_n").over(each), "all_excess": F.max("all_excess").over(each)})

    strings = F.array().cast("array<string>")
    all_ = all_.withColumns({c: F.coalesce(c, strings) for c in ("impacted", "preceding")} | {c: F.coalesce(c, F.lit(0)) for c in ("failed_n", "covered", "logs_n")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("peak_abs_z", "excess", "all_excess", "proximity")})
    unit = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    size, anomalous = F.size("impacted"), F.col("onset_ns").isNotNull()
    others = F.col("anomalous_n") - anomalous.cast("int")
    span = F.col("incident_end") - F.col("incident_onset")
    f = {
        "anomaly_strength": unit(F.col("peak_abs_z") / LIMIT),
        "temporal_precedence": F.when(~anomalous, 0.0).when(F.col("anomalous_n") <= 1, 1.0).otherwise(1 - F.try_divide(F.col("earlier").cast("double"), F.col("anomalous_n") - 1)),
        "failed_trace_coverage": F.coalesce(F.try_divide(F.col("covered").cast("double"), F.col("failed_n")), F.lit(0.0)),
        "critical_path_contribution": F.coalesce(F.try_divide(F.col("excess"), F.col("all_excess")), F.lit(0.0)),
        "downstream_impact": F.coalesce(F.try_divide(size.cast("double"), F.col("services_n") - 1), F.lit(0.0)),
        "topology_consistency": F.coalesce(F.try_divide(size.cast("double"), others), F.lit(0.0)),
        "change_proximity": F.col("proximity"),
        "log_evidence": unit(F.col("logs_n") / F.lit(float(LOGS_FULL))),
        "persistence": F.when(span > 0, unit(F.coalesce(F.try_divide(F.col("anomalous_ns").cast("double"), span), F.lit(0.0)))).otherwise(0.0),
        "contradiction_penalty": F.when(~anomalous, (F.col("anomalous_n") > 0).cast("double")).otherwise(F.coalesce(F.try_divide(F.size("preceding").cast("double"), size), F.lit(0.0))),
    }
    out = all_.select(*KEY, *(c.alias(name) for name, c in f.items()), "onset_ns", "peak_abs_z", "incident_onset", "incident_end", "at", "covered", "impacted", "preceding")
    return written(out, "features")


def score(weights: dict[str, float] = WEIGHTS) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.col(name) * F.lit(w)
    return total


def rank_candidates(feats: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The features with ``score``, ``contributions`` (feature, value, weight, product) and ``rank`` by score, then name."""
    parts = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("value"), F.lit(w).alias("weight"), (F.col(n) * F.lit(w)).alias("product")) for n, w in weights.items()))
    out = feats.withColumns({"score": score(weights), "contributions": parts})
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("score"), "service")))


def _le(c: Column) -> Column:
    """Eight bytes of a long, lowest first."""
    b = F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))
    return F.concat(*(F.substring(b, i, 1) for i in range(8, 0, -1)))


def evidence(ranked: DataFrame) -> DataFrame:
    """(incident_id, rank, service, evidence_id, type, direction, strength, start_ns, end_ns), for features with signal."""
    at, end = F.coalesce("at", F.lit(0)).cast("long"), F.col("incident_end")
    end = F.coalesce(end, at)
    item = lambda kind, strength, until, ok=None: F.struct(
        F.lit(kind).alias("type"), F.lit("contradicts" if kind == "Contradiction" else "supports").alias("direction"), strength.alias("strength"), at.alias("start_ns"), until.alias("end_ns"),
        (strength > 0 if ok is None else (strength > 0) & ok).alias("there"),
    )
    c = F.col
    items = F.array(
        item("MetricAnomaly", c("anomaly_strength"), end),
        item("TemporalPrecedence", c("temporal_precedence"), at, c("onset_ns").isNotNull()),
        item("FailedTraceCoverage", c("failed_trace_coverage"), end),
        item("CriticalPathIncrease", c("critical_path_contribution"), end),
        item("DependencyPropagation", F.greatest("topology_consistency", "downstream_impact"), end),
        item("DeploymentProximity", c("change_proximity"), at),
        item("LogTemplateSpike", c("log_evidence"), end),
        item("Contradiction", c("contradiction_penalty"), end),
    )
    e = ranked.select("incident_id", "rank", "service", F.explode(F.filter(items, lambda x: x["there"])).alias("e")).select("incident_id", "rank", "service", "e.*").drop("there")
    text = F.concat_ws("|", "incident_id", "service", "type", F.lit("")).cast("binary")
    return e.withColumn("evidence_id", F.concat(F.lit("ev-"), F.substring(F.sha2(F.concat(text, _le(c("start_ns")), _le(c("end_ns"))), 256), 1, 16)))


def candidate_changes(ranked: DataFrame, data: Incident) -> DataFrame:
    """(incident_id, service, ref): changes of candidates shortly before their onset (or the incident's)."""
    near = data.changes.select(*KEY, "event_time", F.col("event_id").alias("ref")).join(ranked.select(*KEY, "at"), KEY)
    return near.where((F.col("at") - F.col("event_time")).between(0, CHANGE_WINDOW_NS)).select(*KEY, "ref")


def candidate_logs(ranked: DataFrame, data: Incident) -> DataFrame:
    """(incident_id, service, ref): severe logs of candidates around their onset (or the incident's)."""
    near = severe(data.logs).select(*KEY, "event_time", F.col("event_id").alias("ref")).join(ranked.select(*KEY, "at"), KEY)
    return near.where(F.abs(F.col("at") - F.col("event_time")) <= LOG_WINDOW_NS).select(*KEY, "ref")


def evidence_refs(ranked: DataFrame, data: Incident, intervals: DataFrame, top: int = 3) -> DataFrame:
    """(incident_id, service, evidence_id, type, ref): a row for each event or trace that the evidence of the ``top`` candidates rests on."""
    best = ranked.where(F.col("rank") <= top)
    ids = evidence(best).select(*KEY, "type", "evidence_id")
    bad = data.spans.groupBy(*_TRACE).agg(F.max(F.coalesce(F.col("status") == "error", F.lit(False))).alias("failed"), F.collect_set("service").alias("s")).where("failed")
    traces = bad.select("incident_id", F.explode("s").alias("service"), F.col("trace_id").alias("ref"))
    parts = [
        (("MetricAnomaly",), intervals.select(*KEY, F.explode("source_refs").alias("ref"))),
        (("FailedTraceCoverage", "CriticalPathIncrease"), traces),
        (("DeploymentProximity",), candidate_changes(best, data)),
        (("LogTemplateSpike",), candidate_logs(best, data)),
    ]
    out = None
    for kinds, refs in parts:
        rows = ids.where(F.col("type").isin(*kinds)).join(refs, KEY).select(*KEY, "evidence_id", "type", "ref")
        out = rows if out is None else out.unionByName(rows)
    return out


def _short(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 10)


def evidence_graph(ranked: DataFrame, data: Incident, intervals: DataFrame, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes (incident_id, id, kind, service, time_ns, strength) and edges (incident_id, id, source, target, kind) of the best candidates."""
    c, inc = F.col, F.col("incident_id")
    null = F.lit(None).cast("long")
    sick = ranked.where("onset_ns is not null")
    best = ranked.where(c("rank") <= top)
    deg = lambda s: F.concat(F.lit("deg:"), s)
    cand = F.concat(F.lit("cand:"), c("service"))
    metric = F.concat(F.lit("metric:"), _short("service", "name", c("start_ns").cast("string")))
    node = lambda df, i, kind, t, strength: df.select(inc, i.alias("id"), F.lit(kind).alias("kind"), "service", t.alias("time_ns"), strength.alias("strength"))
    changes = best.join(candidate_changes(best, data), KEY)
    logs = best.join(candidate_logs(best, data), KEY)
    change, log_ = F.concat(F.lit("change:"), c("ref")), F.concat(F.lit("log:"), c("ref"))
    unit = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    nodes = node(sick, deg(c("service")), "ServiceDegradation", c("onset_ns"), c("anomaly_strength"))
    for more in (
        node(intervals, metric, "MetricAnomaly", c("start_ns"), unit(c("peak_abs_z") / LIMIT)),
        node(best, cand, "RootCauseCandidate", c("onset_ns"), unit(c("score"))),
        node(changes, change, "Change", null, c("change_proximity")),
        node(logs, log_, "LogPattern", null, c("log_evidence")),
    ):
        nodes = nodes.unionByName(more)
    edge = lambda df, a, b, kind: df.select(inc, a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"))
    ill = best.where("onset_ns is not null")
    times = sick.select("incident_id", c("service").alias("other"), c("onset_ns").alias("other_onset"))
    spread = ill.withColumn("other", F.explode("impacted")).join(times, ["incident_id", "other"]).where("other_onset >= onset_ns")
    edges = edge(intervals, metric, deg(c("service")), "ContributesTo")
    for more in (
        edge(ill, deg(c("service")), cand, "ContributesTo"),
        edge(changes.where("onset_ns is not null"), change, deg(c("service")), "Precedes"),
        edge(logs.where("onset_ns is not null"), log_, deg(c("service")), "CorrelatesWith"),
        edge(spread, deg(c("service")), deg(c("other")), "PropagatesTo"),
        edge(best.withColumn("other", F.explode("preceding")), deg(c("other")), cand, "Contradicts"),
    ):
        edges = edges.unionByName(more)
    edges = edges.withColumn("id", F.concat(F.lit("ee-"), _short("incident_id", "source", "target", "kind")))
    return nodes.dropDuplicates(["incident_id", "id"]), edges.select("incident_id", "id", "source", "target", "kind")


def evaluate(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """(incident_id, best_rank, top1, top3, reciprocal_rank) of the best labelled service; labels: (incident_id, root_cause_services)."""
    truth = labels.select("incident_id", F.explode("root_cause_services").alias("service"))
    hit = truth.join(ranked.select("incident_id", "service", "rank"), ["incident_id", "service"], "left").groupBy("incident_id").agg(F.min("rank").alias("best_rank"))
    r = F.col("best_rank")
    return hit.select("incident_id", "best_rank", F.coalesce(r <= 1, F.lit(False)).alias("top1"), F.coalesce(r <= 3, F.lit(False)).alias("top3"), F.coalesce(1 / r, F.lit(0.0)).alias("reciprocal_rank"))


def summarise(evaluated: DataFrame, *by: str) -> DataFrame:
    return evaluated.groupBy(*by).agg(F.count(F.lit(1)).alias("incidents"), F.avg(F.col("top1").cast("double")).alias("top1"), F.avg(F.col("top3").cast("double")).alias("top3"), F.avg("reciprocal_rank").alias("mrr"))


def ablated(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """(ablation, incidents, top1, top3, mrr), with ``none`` for all weights."""
    out = None
    for name, gone in {"none": (), **ABLATIONS}.items():
        w = {k: 0.0 if k in gone else v for k, v in WEIGHTS.items()}
        row = summarise(evaluate(rank_candidates(feats, w), labels)).select(F.lit(name).alias("ablation"), "*")
        out = row if out is None else out.unionByName(row)
    return out
