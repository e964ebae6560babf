"""Replay of an incident: a clock, a session that answers at its cursor, and checkpoints that survive corruption."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarp.operators import graph, inference, ingest, joins, projections, windows
from tracewarp.operators.inference import Incident
from tracewarp.plans import dialect
from tracewarp.sources import incidents

SPEEDS = (0.5, 1.0, 2.0, 5.0, 10.0, 50.0, float("inf"))
BUCKET_NS = 1_000_000_000


@dataclass
class Clock:
    """Event time between start and end, moved by wall time; stopped, playing or paused."""

    start_ns: int
    end_ns: int
    cursor_ns: int = 0
    speed: float = 1.0
    state: str = "stopped"

    def __post_init__(self):
        self.cursor_ns = self.start_ns

    def play(self) -> None:
        if self.cursor_ns < self.end_ns:
            self.state = "playing"

    def pause(self) -> None:
        if self.state == "playing":
            self.state = "paused"

    def stop(self) -> None:
        self.state, self.cursor_ns = "stopped", self.start_ns

    def seek(self, to_ns: int) -> None:
        self.cursor_ns = min(max(to_ns, self.start_ns), self.end_ns)

    def set_speed(self, speed: float) -> None:
        if speed not in SPEEDS:
            raise ValueError(f"speed must be one of {SPEEDS}")
        self.speed = speed

    def tick(self, wall_ns: int) -> int:
        """Moves the cursor by wall time times speed; at the end the clock pauses."""
        if self.state == "playing":
            self.seek(self.end_ns if self.speed == float("inf") else self.cursor_ns + int(wall_ns * self.speed))
            if self.cursor_ns == self.end_ns:
                self.state = "paused"
        return self.cursor_ns


class CheckpointStore:
    """Checkpoints that are whole or absent: written aside, synced, hashed, and renamed; the manifest comes last."""

    def __init__(self, folder: str, keep: int = 5):
        self.folder, self.keep = Path(folder), keep
        self.folder.mkdir(parents=True, exist_ok=True)

    def _ids(self) -> list[int]:
        return sorted(int(p.name[3:]) for p in self.folder.glob("cp-*") if p.name[3:].isdigit())

    @staticmethod
    def _put(path: Path, data: bytes) -> None:
        with path.open("wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())

    def write(self, state: dict) -> int:
        n = max(self._ids(), default=0) + 1
        aside, data = self.folder / f".tmp-{n}", json.dumps(state, sort_keys=True).encode()
        shutil.rmtree(aside, ignore_errors=True)
        aside.mkdir()
        self._put(aside / "state.json", data)
        self._put(aside / "manifest.json", json.dumps({"id": n, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}).encode())
        aside.rename(self.folder / f"cp-{n}")
        self._put(self.folder / ".latest", str(n).encode())
        (self.folder / ".latest").rename(self.folder / "LATEST")
        for old in self._ids()[: -self.keep]:
            shutil.rmtree(self.folder / f"cp-{old}")
        return n

    def read(self, n: int) -> dict:
        """The state of a checkpoint; ValueError where anything about it is wrong."""
        try:
            m = json.loads((self.folder / f"cp-{n}/manifest.json").read_bytes())
            data = (self.folder / f"cp-{n}/state.json").read_bytes()
        except (OSError, ValueError) as e:
            raise ValueError(f"checkpoint {n}: {e}") from e
        if not isinstance(m, dict) or m.get("id") != n or m.get("bytes") != len(data) or m.get("sha256") != hashlib.sha256(data).hexdigest():
            raise ValueError(f"checkpoint {n} isn't what its manifest says")
        return json.loads(data)

    def recover(self) -> tuple[int, dict, list[str]] | None:
        """The newest sound checkpoint, and why newer ones were passed over; None without any."""
        passed = []
        for n in reversed(self._ids()):
            try:
                return n, self.read(n), passed
            except ValueError as e:
                passed.append(str(e))
        return None


class Session:
    """One incident at a movable cursor. Labels are no part of it: they are read only by :meth:`case`, on request."""

    def __init__(self, spark: SparkSession, path: str, checkpoints: str | None = None):
        self.spark, self.path = spark, path
        m = incidents.manifest(path)
        self.incident_id = m["incident_id"]
        self.all = incidents.load(spark, [path])
        self.clock = Clock(m["start_time_ns"], m["end_time_ns"])
        self.store = CheckpointStore(checkpoints) if checkpoints else None

    def at_cursor(self) -> Incident:
        d = self.all
        return Incident(*(projections.at_cursor(df, self.clock.cursor_ns) for df in (d.metrics, d.spans, d.logs, d.changes)))

    def query(self, sql: str) -> DataFrame:
        return self._dialect().query(sql)

    def explain(self, sql: str, analyze: bool = False) -> str:
        return self._dialect().explain(sql, analyze)

    def _dialect(self) -> dialect.Session:
        d = self.all
        tables = {
            "metrics": d.metrics.select("service", "name", "value", "event_time"),
            "spans": d.spans.select("service", "operation", "duration_ns", "status", "trace_id", "event_time"),
            "logs": d.logs.select("service", F.coalesce("severity_text", F.lit("")).alias("severity"), "body", "event_time"),
            "deployments": d.changes.select("service", "event_id", "change_id", F.regexp_replace("change_type", "_", "").alias("change_type"), F.coalesce("version_after", F.lit("")).alias("version_after"), "event_time"),
        }
        return dialect.Session(self.spark, tables, self.clock.cursor_ns)

    def topology(self) -> tuple[DataFrame, DataFrame]:
        s = self.at_cursor().spans
        return graph.service_nodes(s), graph.service_edges(s)

    def heatmap(self) -> DataFrame:
        return projections.merged_heatmap(self.at_cursor().metrics, BUCKET_NS)

    def timeline(self) -> DataFrame:
        d = self.at_cursor()
        return projections.timeline(d.metrics, d.logs.withColumnRenamed("severity_text", "severity"), d.changes).orderBy("event_time", "event_id")

    def traces(self) -> DataFrame:
        return graph.traces(self.at_cursor().spans)

    def correlation(self) -> DataFrame:
        d = self.at_cursor()
        return joins.correlation(d.metrics, d.changes, self.clock.end_ns - self.clock.start_ns + 1)

    def percentiles(self, size_ns: int = BUCKET_NS) -> DataFrame:
        return windows.window_percentiles(self.at_cursor().metrics, size_ns)

    def root_causes(self) -> DataFrame:
        return inference.rank_candidates(inference.features(self.at_cursor()))

    def evidence(self) -> DataFrame:
        return inference.evidence(self.root_causes())

    def root_cause_view(self, top: int = 3) -> dict[str, DataFrame]:
        """The ranking with its evidence, what that rests on, and the evidence graph, all of one set of features."""
        d = self.at_cursor()
        iv = inference.intervals_of(d)
        ranked = inference.rank_candidates(inference.features(d, iv))
        nodes, edges = inference.evidence_graph(ranked, d, iv, top)
        return {"candidates": ranked, "evidence": inference.evidence(ranked), "refs": inference.evidence_refs(ranked, d, iv, top), "nodes": nodes, "edges": edges}

    def trace(self, trace_id: str) -> dict[str, DataFrame]:
        """A trace with its critical path and, if it failed, its cohort before the incident's onset and the comparison."""
        d = self.at_cursor()
        onset = inference.intervals_of(d).agg(F.min("start_ns")).first()[0]
        return projections.trace_detail(d.spans, trace_id, onset)

    def reset(self) -> None:
        """Back to the beginning, at the first speed."""
        self.clock = Clock(self.clock.start_ns, self.clock.end_ns)

    def resync(self) -> dict:
        """What a viewer that lost its place needs to go on."""
        c = self.clock
        return {"incident_id": self.incident_id, "cursor_ns": c.cursor_ns, "start_ns": c.start_ns, "end_ns": c.end_ns, "state": c.state, "speed": str(c.speed)}

    def snapshot(self) -> dict:
        """:meth:`resync` with the numbers of events up to the cursor by signal."""
        return self.resync() | {"events": {r.signal: r.events for r in self.stats().collect()}}

    def validate(self, sql: str) -> str | None:
        """Why a statement isn't in the dialect, or None where it is; nothing is run."""
        try:
            self._dialect().query(sql)
        except dialect.DialectError as e:
            return str(e)
        return None

    def stats(self) -> DataFrame:
        return ingest.counts_by_signal(incidents.envelopes(self.at_cursor()))

    def case(self) -> dict:
        """The ranking held against the labels: only here are they read."""
        truth = incidents.labels_table(self.spark, [self.path])
        return inference.evaluate(self.root_causes(), truth).first().asDict()

    def evidence_ids(self) -> list[str]:
        return sorted(r.evidence_id for r in self.evidence().select("evidence_id").collect())

    def checkpoint(self) -> int:
        c = self.clock
        return self.store.write({"incident_id": self.incident_id, "path": self.path, "cursor_ns": c.cursor_ns, "speed": str(c.speed), "evidence_ids": self.evidence_ids()})

    @classmethod
    def recovered(cls, spark: SparkSession, checkpoints: str) -> tuple[Session, bool]:
        """The session of the newest sound checkpoint, and whether its evidence is again what it was."""
        found = CheckpointStore(checkpoints).recover()
        if found is None:
            raise ValueError(f"{checkpoints}: no sound checkpoint")
        _, state, _ = found
        s = cls(spark, state["path"], checkpoints)
        s.clock.seek(state["cursor_ns"])
        s.clock.speed = float(state["speed"])
        return s, s.evidence_ids() == state["evidence_ids"]
