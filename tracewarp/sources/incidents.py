"""Recorded incidents on disk: discovery, validation, and their signals as typed tables.

An incident is a folder ``<dataset>/<version>/<incident>`` with ``manifest.json``, perhaps ``labels.json`` (for
evaluation only), and Parquet files of (event_id, event_time_ns, service, payload_json) under metrics, spans, logs and
changes. Payloads are parsed by Spark with a fixed schema, in a mode that fails on a bad row.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarp.operators.inference import Incident

SIGNALS = ("metrics", "spans", "logs", "changes")
PAYLOADS = {
    "metrics": "name string, kind string, value double, unit string",
    "spans": "trace_id string, span_id string, parent_span_id string, operation string, start_time_ns long, end_time_ns long, duration_ns long, status string, peer_service string, span_kind string",
    "logs": "severity_number int, severity_text string, body string, template_id string, trace_id string, span_id string",
    "changes": "change_id string, change_type string, version_before string, version_after string, actor string",
}
NEEDED = {"metrics": ("name", "value"), "spans": ("trace_id", "span_id", "operation", "start_time_ns", "end_time_ns"), "logs": ("body",), "changes": ("change_id", "change_type")}
ENUMS = {
    ("metrics", "kind"): {"gauge": "gauge", "counter": "counter", "histogram_sample": "histogram_sample", "histogram": "histogram_sample"},
    ("spans", "status"): {"unset": "unset", "ok": "ok", "error": "error"},
    ("spans", "span_kind"): {k: k for k in ("internal", "server", "client", "producer", "consumer")},
    ("changes", "change_type"): {"deployment": "deployment", "rollback": "rollback", "config": "config", "feature_flag": "feature_flag", "featureflag": "feature_flag"},
}
DEFAULTS = {("metrics", "kind"): "gauge", ("spans", "status"): "unset", ("spans", "span_kind"): "internal"}


class InvalidIncident(ValueError):
    """A manifest, labels or file that breaks the rules of the format."""


@dataclass(frozen=True)
class Entry:
    dataset: str
    version: str
    incident_id: str
    path: str


def discover(root: str) -> list[Entry]:
    """All incidents below ``root``, sorted by id; folders right below it count as dataset local, version v1."""
    base, found = Path(root), []
    for pattern, depth in (("*/manifest.json", 1), ("*/*/*/manifest.json", 3)):
        for p in base.glob(pattern):
            parts = p.parent.relative_to(base).parts
            dataset, version = parts[:2] if depth == 3 else ("local", "v1")
            found.append(Entry(dataset, version, parts[-1], str(p.parent)))
    return sorted(found, key=lambda e: (e.incident_id, e.path))


def manifest(path: str, verify: bool = False) -> dict:
    """The validated manifest; ``verify`` also compares the files' hashes."""
    m = json.loads((Path(path) / "manifest.json").read_text())
    for k in ("dataset_id", "dataset_version", "incident_id"):
        if not m.get(k):
            raise InvalidIncident(f"{path}: {k} is empty")
    if m.get("start_time_ns", 0) > m.get("end_time_ns", 0):
        raise InvalidIncident(f"{path}: it ends before it starts")
    if not m.get("files"):
        raise InvalidIncident(f"{path}: no files")
    for f in m["files"]:
        if len(f.get("sha256", "")) != 64:
            raise InvalidIncident(f"{path}: {f.get('path')} has no sha256")
        if verify and hashlib.sha256((Path(path) / f["path"]).read_bytes()).hexdigest() != f["sha256"]:
            raise InvalidIncident(f"{path}: {f['path']} isn't the file of its hash")
    return m


def labels(path: str) -> dict:
    found = json.loads((Path(path) / "labels.json").read_text())
    if not found.get("root_cause_services"):
        raise InvalidIncident(f"{path}: no root cause services")
    if not found.get("fault_type"):
        raise InvalidIncident(f"{path}: no fault type")
    return found


def _enum(signal: str, column: str) -> Column:
    """The known spelling of a value, whatever its case; an unknown one fails the job."""
    c, known = F.lower(F.col(column)), ENUMS[signal, column]
    value = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    bad = F.raise_error(F.concat(F.lit(f"unknown {column} "), F.coalesce(c, F.lit("null")))).cast("string")
    default = DEFAULTS.get((signal, column))
    out = F.coalesce(F.try_element_at(value, c), bad)
    return F.when(c.isNull(), F.lit(default)).otherwise(out) if default else out


def _place(path: str) -> str:
    """A file's path as the reader names it once its URI is decoded."""
    return path if "://" in path else str(Path(path.removeprefix("file:")).resolve())


def _signal(spark: SparkSession, signal: str, files: list[tuple[str, str]]) -> DataFrame:
    """(incident_id, event_id, event_time, service, payload columns...) of (incident, file) pairs."""
    schema = T.StructType.fromDDL(PAYLOADS[signal])
    empty = T.StructType([T.StructField(n, T.StringType()) for n in ("incident_id", "event_id", "service")] + [T.StructField("event_time", T.LongType()), *schema])
    if not files:
        return spark.createDataFrame([], empty)
    # Files of signals without events lack all columns but the id: a fixed read schema gives them nulls.
    read = spark.read.schema("event_id string, event_time_ns long, service string, payload_json string").parquet(*(p for _, p in files))
    # An entry a file, by its whole path: folders of different datasets may share a name. Spark gives file paths as URIs.
    places = spark.createDataFrame([(incident, _place(p)) for incident, p in files], "incident_id string, __place string")
    place = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    read = read.where("payload_json is not null").withColumn("__place", F.url_decode(F.regexp_replace(place, r"\+", "%2B")))
    read = read.join(F.broadcast(places), "__place", "left")
    incident = F.coalesce("incident_id", F.raise_error(F.concat(F.lit("no incident has the file "), "__place")).cast("string"))
    rows = read.select(
        incident.alias("incident_id"), "event_id", "service", F.col("event_time_ns").alias("event_time"), F.from_json("payload_json", schema, {"mode": "FAILFAST"}).alias("p")
    )
    rows = rows.select("incident_id", "event_id", "service", "event_time", "p.*")
    for c in NEEDED[signal]:
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.raise_error(F.lit(f"{signal}: {c} is missing")).cast(schema[c].dataType)))
    for s, c in ENUMS:
        if s == signal:
            rows = rows.withColumn(c, _enum(signal, c))
    if signal == "spans":
        rows = rows.withColumn("duration_ns", F.coalesce("duration_ns", F.col("end_time_ns") - F.col("start_time_ns")))
    return rows


def load(spark: SparkSession, paths: list[str]) -> Incident:
    """The telemetry of one incident folder or of many, as one set of tables."""
    files: dict[str, list[tuple[str, str]]] = {s: [] for s in SIGNALS}
    for path in paths:
        m = manifest(path)
        for f in m["files"]:
            signal = f["path"].split("/")[0]
            if signal not in files:
                raise InvalidIncident(f"{path}: unknown signal folder {signal}")
            if f.get("rows", 1):
                files[signal].append((m["incident_id"], str(Path(path) / f["path"])))
    return Incident(*(_signal(spark, s, files[s]) for s in SIGNALS))


def export(rows: DataFrame, root: str, dataset: str, signal: str = "metrics") -> None:
    """Writes rows (incident_id, event_id, event_time_ns, service, payload_json) as incident folders below ``root``.

    Spark writes the files, partitioned by incident; the driver adds a manifest to each folder. ``root`` is a folder
    that the driver sees as a path.
    """
    base = Path(root.removeprefix("file://")) / dataset / "v1"
    ends = {r.incident_id: r for r in rows.groupBy("incident_id").agg(F.min("event_time_ns").alias("a"), F.max("event_time_ns").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    aside = f"{root}/.{signal}"
    rows.select("incident_id", "event_id", "event_time_ns", "service", "payload_json").repartition("incident_id").write.partitionBy("incident_id").parquet(aside)
    for folder in Path(aside.removeprefix("file://")).glob("incident_id=*"):
        incident = folder.name.split("=", 1)[1]
        to = base / incident / signal
        to.parent.mkdir(parents=True)
        folder.rename(to)
        files = [{"path": f"{signal}/{p.name}", "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for p in sorted(to.glob("*.parquet"))]
        head = {"schema_version": 1, "dataset_id": dataset, "dataset_version": "v1", "incident_id": incident, "start_time_ns": ends[incident].a, "end_time_ns": ends[incident].b}
        (base / incident / "manifest.json").write_text(json.dumps(head | {"signals": [signal], "event_counts": {signal: ends[incident].n}, "files": files}, indent=1))


def envelopes(data: Incident) -> DataFrame:
    """All signals as one ordered stream: (incident_id, event_time, event_id, service, signal)."""
    change = F.when(F.col("change_type").isin("deployment", "rollback"), "deployment").otherwise("configuration")
    parts = [(data.metrics, F.lit("metric")), (data.spans, F.lit("span")), (data.logs, F.lit("log")), (data.changes, change)]
    out = None
    for df, signal in parts:
        rows = df.select("incident_id", "event_time", "event_id", "service", signal.alias("signal"))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("incident_id", "event_time", "event_id")


def labels_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = [(x["incident_id"], list(x["root_cause_services"]), x["fault_type"]) for x in map(labels, paths)]
    return spark.createDataFrame(rows, "incident_id string, root_cause_services array<string>, fault_type string")
