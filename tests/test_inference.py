"""Incidents from disk through inference, against known values."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest

from tracewarp.operators import graph, inference
from tracewarp.operators.projections import timeline
from tracewarp.sources import fixtures, incidents

#: Rank, service, score and features A to H and J of the memory incident.
GOLDEN = [
    ("recommendationservice", 0.916667, (1, 1, 1, 1, 0.5, 1, 1, 1 / 3, 0)), ("checkoutservice", 0.5, (1, 0.5, 1, 0, 0.25, 0.5, 0, 0, 0)), ("frontend", 0.425, (1, 0.5, 1, 0, 0, 0, 0, 0, 0)),
    ("cartservice", -0.1, (0, 0, 0, 0, 0, 0, 0, 0, 1)), ("productcatalogservice", -0.1, (0, 0, 0, 0, 0, 0, 0, 0, 1)),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return fixtures.write_memory_incident(str(tmp_path_factory.mktemp("incidents") / "rec-mem-001"))


@pytest.fixture(scope="module")
def data(spark, folder):
    return incidents.load(spark, [folder])


@pytest.fixture(scope="module")
def ranked(data):
    return inference.rank_candidates(inference.features(data)).persist()


def test_counts_and_order(data):
    e = incidents.envelopes(data).collect()
    assert len(e) == 387 and e == sorted(e, key=lambda r: (r.event_time, r.event_id))
    assert [df.count() for df in (data.metrics, data.spans, data.logs, data.changes)] == [240, 144, 2, 1]


def test_intervals(data):
    rows = inference.anomaly_intervals(inference.robust_z(data.metrics)).collect()
    base = 1_700_000_000 * fixtures.SECOND
    got = sorted((r.service, r.name.split("_", 1)[1], (r.start_ns - base) // fixtures.SECOND, (r.end_ns - base) // fixtures.SECOND, r.sample_count, r.closed, r.peak_abs_z) for r in rows)
    want = [(s, m, 7, 15, 9, False, 8.0) for s in ("checkoutservice", "frontend") for m in ("error_rate", "latency")] + [("recommendationservice", m, 5, 15, 11, False, 8.0) for m in ("latency", "mem")]
    assert got == sorted(want)


def test_ranking(ranked, data):
    rows = ranked.orderBy("rank").collect()
    for r, (service, score, f) in zip(rows, GOLDEN, strict=True):
        assert r.service == service and r.score == pytest.approx(score, abs=1e-6)
        assert [r[n] for n in inference.WEIGHTS] == pytest.approx(f, abs=1e-9)
        assert sum(c["product"] for c in r.contributions) == pytest.approx(r.score)
    assert rows[0].covered == 8
    refs = inference.evidence_refs(ranked, data, inference.intervals_of(data), top=1).collect()
    found = {k: sorted(r.ref for r in refs if r.type == k) for k in {r.type for r in refs}}
    assert found["FailedTraceCoverage"] == found["CriticalPathIncrease"] == [f"trace-{t}-0" for t in (10, 11, 12, 13, 14, 15, 8, 9)]
    assert found["DeploymentProximity"] == ["c-deploy-rec-1"] and found["LogTemplateSpike"] == ["l-rec-mem-1"] and len(found["MetricAnomaly"]) == 22


def test_edges_and_reach(data):
    assert {(r.source, r.target) for r in graph.service_edges(data.spans).collect()} == {("frontend", "checkoutservice"), ("checkoutservice", "recommendationservice")}
    got = {(r.service, r.caller) for r in graph.reach(graph.service_edges(data.spans)).collect()}
    assert got == {("checkoutservice", "frontend"), ("recommendationservice", "checkoutservice"), ("recommendationservice", "frontend")}


def test_evidence_is_stable_and_its_graph_complete(spark, data, ranked):
    a, b = ({(r.evidence_id, r.type) for r in inference.evidence(x).collect()} for x in (ranked, inference.rank_candidates(inference.features(data))))
    assert a == b and len(a) == len({i for i, _ in a})
    first = [r.type for r in inference.evidence(ranked).where("rank = 1").collect()]
    assert sorted(first) == sorted(["MetricAnomaly", "TemporalPrecedence", "FailedTraceCoverage", "CriticalPathIncrease", "DependencyPropagation", "DeploymentProximity", "LogTemplateSpike"])
    iv = inference.anomaly_intervals(inference.robust_z(data.metrics))
    nodes, edges = (x.collect() for x in inference.evidence_graph(ranked, data, iv))
    ids = {n.id for n in nodes}
    assert len(nodes) == 3 + 6 + 3 + 1 + 1 and all(e.source in ids and e.target in ids for e in edges)
    assert {(e.source, e.target) for e in edges if e.kind == "PropagatesTo"} == {("deg:recommendationservice", "deg:checkoutservice"), ("deg:recommendationservice", "deg:frontend"), ("deg:checkoutservice", "deg:frontend")}


def test_evidence_id_is_a_hash_of_bytes(ranked):
    import hashlib
    import struct

    r = inference.evidence(ranked).where("rank = 1 and type = 'MetricAnomaly'").first()
    h = hashlib.sha256(f"rec-mem-001|{r.service}|MetricAnomaly|".encode() + struct.pack("<qq", r.start_ns, r.end_ns)).hexdigest()
    assert r.evidence_id == f"ev-{h[:16]}"


def test_suite_is_solved_in_one_job(spark, tmp_path):
    paths = fixtures.write_suite(str(tmp_path))
    assert [e.path for e in incidents.discover(str(tmp_path))] == sorted(paths)
    feats = inference.features(incidents.load(spark, paths)).persist()
    truth = incidents.labels_table(spark, paths)
    rows = {r.ablation: r for r in inference.ablated(feats, truth).collect()}
    assert len(rows) == 7 and rows["none"].incidents == 16
    assert rows["none"].top1 == rows["none"].top3 == rows["none"].mrr == 1.0


def test_hysteresis_scenarios():
    def run(zs):
        h, out = inference.Hysteresis(), []
        for t, z in enumerate(zs):
            if done := h.push(t, z, f"e{t}"):
                out.append(done)
        return [(d["start_ns"], d["end_ns"], d["sample_count"], d["closed"]) for d in out + ([h.open] if h.open else [])]

    assert run([0, 4, 0, 4, 0]) == []
    assert run([4, 5, 2, 1, 4, 1, 1, 0]) == [(0, 4, 4, True)]
    assert run([4, None, 4, 9]) == [(0, 3, 3, False)]
    assert run([-3, 3]) == [(0, 1, 2, False)]


def _spans(*rows):
    return [dict(zip(("span_id", "parent_span_id", "start_time_ns", "end_time_ns", "service"), r)) | {"operation": "o", "status": "ok"} for r in rows]


def test_critical_path_scenarios():
    def path(*rows):
        root, found = graph.critical_segments(_spans(*rows))
        return root["span_id"], [(a, b, s["span_id"]) for a, b, s in found]

    assert path(("a", None, 0, 10, "x"), ("b", "a", 2, 4, "y"), ("c", "a", 5, 9, "z")) == ("a", [(0, 2, "a"), (2, 4, "b"), (4, 5, "a"), (5, 9, "c"), (9, 10, "a")])
    assert path(("a", None, 0, 10, "x"), ("b", "a", 1, 9, "y"), ("c", "a", 2, 5, "z")) == ("a", [(0, 1, "a"), (1, 9, "b"), (9, 10, "a")])
    assert path(("a", None, 0, 10, "x"), ("b", "a", 3, 15, "y")) == ("a", [(0, 3, "a"), (3, 10, "b")])
    assert path(("b", "gone", 0, 4, "y"), ("c", None, 0, 4, "y"), ("d", None, 1, 6, "y"))[0] == "d"
    assert graph.critical_segments([]) == (None, [])
    assert graph.critical_segments(_spans(("a", "b", 0, 1, "x"), ("b", "a", 0, 1, "x"))) == (None, [])


def test_critical_path_of_random_traces_covers_the_root():
    r = random.Random(0)
    for _ in range(200):
        rows = [("s0", None, 0, 1000, "x")]
        for i in range(1, r.randint(2, 12)):
            a = r.randint(0, 990)
            rows.append((f"s{i}", f"s{r.randrange(i)}", a, a + r.randint(1, 300), "y"))
        root, found = graph.critical_segments(_spans(*rows))
        assert sum(b - a for a, b, _ in found) == 1000 and all(x[1] == y[0] for x, y in zip(found, found[1:]))


def test_deep_traces_need_no_recursion():
    rows = [("s0", None, 0, 20_000, "x")] + [(f"s{i}", f"s{i - 1}", i, 20_000, "x") for i in range(1, 5000)]
    assert len(graph.critical_segments(_spans(*rows))[1]) == 5000


def test_cohort_and_comparison(spark, data):
    onset = 1_700_000_005 * fixtures.SECOND
    c = graph.healthy_cohorts(data.spans, onset).persist()
    rows = c.collect()
    assert len(rows) == 8 and all(len(r.cohort) == 15 and r.confidence == 1.0 for r in rows)
    pairs = c.selectExpr("failed_trace_id", "median_trace_id as healthy_trace_id").where("failed_trace_id = 'trace-15-0'")
    got = {r.path.rsplit(":", 1)[1]: r.delta_ns for r in graph.compare_traces(data.spans, pairs).collect()}
    assert got == {"HTTP GET /cart": 0, "PlaceOrder": 0, "ListRecommendations": 44_000_000}
    s = graph.compare_summaries(data.spans, pairs).first()
    assert s.total_excess_ns == 0 and s.added_services == [] == s.removed_services


def test_timeline(data):
    logs = data.logs.withColumnRenamed("severity_text", "severity")
    rows = timeline(data.metrics, logs, data.changes).orderBy("event_time", "event_id").collect()
    assert len(rows) == 243 and any(r.summary == "deployment deploy-rec-v2 to v2" for r in rows) and any(r.summary == "frontend_latency = 40" for r in rows)


def test_validation(spark, folder, tmp_path):
    incidents.manifest(folder, verify=True)
    bad = fixtures.write_memory_incident(str(tmp_path / "bad"))
    m = json.loads(Path(bad, "manifest.json").read_text())
    for change in ({"incident_id": ""}, {"files": []}, {"start_time_ns": m["end_time_ns"] + 1}, {"files": [m["files"][0] | {"sha256": "x"}]}):
        Path(bad, "manifest.json").write_text(json.dumps(m | change))
        with pytest.raises(incidents.InvalidIncident):
            incidents.manifest(bad)
    Path(bad, "manifest.json").write_text(json.dumps(m))
    Path(bad, "metrics/part-00000.parquet").write_bytes(b"")
    with pytest.raises(incidents.InvalidIncident):
        incidents.manifest(bad, verify=True)
    Path(bad, "labels.json").write_text("{}")
    with pytest.raises(incidents.InvalidIncident):
        incidents.labels(bad)


def test_bad_payloads_fail(spark, tmp_path):
    rows = fixtures.memory_incident()
    rows["metrics"][0]["kind"] = "nonsense"
    path = fixtures.write_incident(str(tmp_path / "x" / "i"), "d", "i", rows, {"root_cause_services": ["a"], "fault_type": "f"})
    with pytest.raises(Exception, match="unknown kind"):
        incidents.load(spark, [path]).metrics.collect()


def test_converters(spark, tmp_path):
    case = tmp_path / "case"
    case.mkdir()
    (case / "inject_time.txt").write_text("1700000000")
    (case / "metrics.json").write_text(json.dumps({f"{s}_cpu": [[1_700_000_000 + i, None if i == 3 else i] for i in range(30)] for s in ("cart", "front")}))
    ids = [f"t{i}" for i in range(40)]
    (case / "traces.csv").write_text("traceID,spanID,serviceName,operationName,startTime,duration,statusCode,parentSpanID\n" + "".join(f"{t},s{t},cartservice,get,1700000000000000,1500,{i % 2},\n" for i, t in enumerate(ids)))
    (case / "logs.csv").write_text("timestamp,container_name,message\n" + "".join(f"{1_700_000_000 + i // 100}.{i % 100:02},front,{'request failed' if i % 50 == 0 else 'fine'} {i}\n" for i in range(5000)))
    d = incidents.load(spark, [fixtures.convert_recording(str(case), str(tmp_path / "out"), "re-1", "cart", "cpu")])
    assert d.metrics.count() == 58 and d.changes.count() == 0
    assert {r.trace_id for r in d.spans.collect()} == {t for t in ids if fixtures.keep_trace(t)} and {r.service for r in d.spans.collect()} <= {"cart"}
    times = [r[0] for r in d.logs.selectExpr("min(event_time)").union(d.logs.selectExpr("max(event_time)")).collect()]
    assert times[0] == 1_700_000_000 * fixtures.SECOND and 49 * fixtures.SECOND < times[1] - times[0] < 50 * fixtures.SECOND
    assert not (tmp_path / "scenario").exists() and d.logs.count() == fixtures.LOG_CAP and d.logs.where("severity_text = 'ERROR'").count() == 100
    with pytest.raises(FileNotFoundError):
        fixtures.convert_scenario(str(case), str(tmp_path / "out"))
    (case / "scenario.json").write_text(json.dumps({k: 1 for k in fixtures.REQUIRED_SCENARIO[:-1]}))
    with pytest.raises(ValueError, match="converter_version"):
        fixtures.convert_scenario(str(case), str(tmp_path / "out"))
    full = {k: 1 for k in fixtures.REQUIRED_SCENARIO} | {"fault_start_unix": 1_700_000_000, "fault_end_unix": 1_700_000_100, "ground_truth_root_cause_service": "cart", "ground_truth_fault_type": "cpu", "expected_affected_services": ["front"]}
    (case / "scenario.json").write_text(json.dumps(full))
    (case / "inject_time.txt").unlink()
    before = sorted(p.name for p in case.iterdir())
    assert incidents.labels(fixtures.convert_scenario(str(case), str(tmp_path / "out")))["fault_end_time_ns"] == 1_700_000_100 * fixtures.SECOND
    assert sorted(p.name for p in case.iterdir()) == before


def test_incidents_of_one_name_in_two_datasets_stay_apart(spark, tmp_path):
    rows = fixtures.memory_incident()
    paths = [fixtures.write_incident(str(tmp_path / d / "v1" / "with space%20é"), d, f"inc-{d}", {k: v[: 10 * n] for k, v in rows.items()}, {"root_cause_services": ["a"], "fault_type": "f"}) for n, d in ((1, "A"), (2, "B"))]
    got = {r.incident_id: r["count"] for r in incidents.load(spark, paths).metrics.groupBy("incident_id").count().collect()}
    assert got == {"inc-A": 10, "inc-B": 20}
