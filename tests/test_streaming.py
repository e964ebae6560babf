from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewarp.operators import inference, projections, windows
from tracewarp.sources import fixtures
from tracewarp.streaming import windows as S
from tracewarp.streaming.arrivals import adversarial
from tracewarp.streaming.tracker import BufferFull, Tracker

SEC = 1_000_000_000
#: Spark takes rows at its first watermark, time 0, for late.
BASE = 100 * SEC
SCHEMA = "event_id string, event_time long, service string, name string, value double"


def source(spark, tmp_path, batches):
    """A file stream that gives one batch after the other."""
    d = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(d / f"b{i}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(d / "*"))


@pytest.fixture
def run(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def go(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(300)
        return spark.table(name)

    yield go
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rows(n, start=0, service="a"):
    return [(f"{service}{start + i}", BASE + (start + i) * SEC // 2, service, f"{service}_latency", float(i % 7)) for i in range(n)]


def test_append_mode_equals_batch(spark, tmp_path, run):
    data = rows(40) + rows(40, service="b")
    end = [("end", 10**6 * SEC, "z", "z_latency", 1.0)]
    df = S.dedupe(S.with_event_ts(source(spark, tmp_path, [data[::-1], data[:5], end]), 100 * SEC))
    out = run(S.window_average(df, 5 * SEC), "averages", "append").where("service != 'z'")
    want = windows.window_average(spark.createDataFrame(data, SCHEMA), 5 * SEC)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_revisions_end_with_the_batch_result(spark, tmp_path, run):
    data = rows(30)
    df = source(spark, tmp_path, [data[:11], data[11:], [("end", 1000 * SEC, "a", "x", 0.0)], [("end2", 2000 * SEC, "a", "x", 0.0)]])
    out = run(S.revisions(df, S.AverageRevisions(5 * SEC, SEC), 2 * SEC), "revisions", "update")
    last = {}
    for r in out.collect():
        assert r.revision > last.get(r.window_start, r)[5] if r.window_start in last else r.revision >= 1
        last[r.window_start] = r
    want = {r.window_start: (r.value, r.n) for r in windows.window_average(spark.createDataFrame(data, SCHEMA), 5 * SEC).collect()}
    assert {s: (r.value, r["count"]) for s, r in last.items() if s < 900 * SEC} == want
    assert all(r.finalized for s, r in last.items() if s < 900 * SEC)


def test_percentile_revisions_equal_the_sketch(spark, tmp_path, run):
    data = [(f"e{i}", BASE + i * SEC // 10, "a", "a_latency", float((i * 37) % 101) - 3) for i in range(200)]
    df = source(spark, tmp_path, [data[:90], data[90:]])
    out = run(S.revisions(df, S.PercentileRevisions(5 * SEC, SEC), 60 * SEC), "quantiles", "update")
    last = {r.window_start: r for r in sorted(out.collect(), key=lambda r: r.revision)}
    want = windows.window_percentiles(spark.createDataFrame(data, SCHEMA), 5 * SEC).collect()
    assert len(want) == 4
    for w in want:
        assert [last[w.window_start][p] for p in windows.P] == pytest.approx([w[p] for p in windows.P]) and last[w.window_start]["count"] == w["count"]


def test_rows_within_grace_revise_and_rows_beyond_dont(spark, tmp_path, run):
    at = lambda i, t: (f"e{i}", BASE + t * SEC, "a", "a_latency", float(i))
    df = source(spark, tmp_path, [[at(1, 5)], [at(2, 16)], [at(3, 6)], [at(4, 200)], [at(5, 7)]])
    out = run(S.revisions(df, S.AverageRevisions(10 * SEC, 60 * SEC), SEC), "graceful", "update")
    got = [(r["count"], r.value, r.finalized, r.late) for r in out.where(f"window_start = {BASE}").orderBy("revision").collect()]
    # Row 3 comes at a watermark of 15 s, after the window was final; row 5 at one of 199 s.
    assert got == [(1, 1.0, False, False), (1, 1.0, True, False), (2, 2.0, True, True)]


def test_streamed_heatmap_of_adversarial_arrivals_equals_batch(spark, tmp_path, run):
    r = __import__("random").Random(4)
    data = [(f"e{i}", BASE + i * SEC // 8, "ab"[i % 2], f"s_{('latency', 'mem', 'cpu')[i % 3]}", float(r.randint(1, 90))) for i in range(400)]
    batches = adversarial(data, seed=9, late_ns=20 * SEC, burst=70)
    assert sum(map(len, batches)) > len(data) and [x for b in batches for x in b] != sorted(x for b in batches for x in b)
    df = S.dedupe(S.with_event_ts(source(spark, tmp_path, batches), 600 * SEC)).drop("event_ts")
    out = run(S.heatmap(source(spark, tmp_path / "once", [list(dict.fromkeys(x for x in b if x not in seen and not seen.add(x))) for seen in [set()] for b in batches]), 5 * SEC, 30 * SEC, 30 * SEC), "heat", "update")
    assert df.isStreaming
    batch = projections.merged_heatmap(spark.createDataFrame(data, SCHEMA), 5 * SEC)
    key = lambda rows: sorted((r.service, r.window_start, round(r.avg_value, 9), None if r.p99 is None else round(r.p99, 9), round(r.value, 9)) for r in rows)
    assert key(S.heatmap_cells(out).collect()) == key(batch.select("service", "window_start", "avg_value", "p99", "value").collect())


def test_anomaly_stream_equals_batch(spark, tmp_path, run):
    m = [(r["event_id"], r["event_time_ns"], r["service"], r["name"], r["value"]) for r in fixtures.memory_incident()["metrics"]]
    cut = len(m) // 2
    out = run(S.anomalies(source(spark, tmp_path, [m[:cut], m[cut:]])), "anomalies", "update")
    last = {(r.service, r.name): (r.start_ns, r.end_ns, r.sample_count) for r in sorted(out.collect(), key=lambda r: r.sample_count)}
    batch = inference.anomaly_intervals(inference.robust_z(spark.createDataFrame(m, SCHEMA).withColumn("incident_id", F.lit("i"))))
    assert last == {(r.service, r.name): (r.start_ns, r.end_ns, r.sample_count) for r in batch.collect()} and len(last) == 6


def test_stream_join_keeps_unmatched(spark, tmp_path, run):
    left = S.with_event_ts(source(spark, tmp_path / "l", [rows(10), [("end", 10**6 * SEC, "z", "x", 0.0)]]), SEC)
    changes = source(spark, tmp_path / "r", [[("c", BASE + 2 * SEC, "a", "v2", 0.0)], [("end", 10**6 * SEC, "z", "x", 0.0)]])
    right = changes.select("service", F.col("event_id").alias("change_id"), F.timestamp_micros(F.expr("event_time div 1000")).alias("change_ts")).withWatermark("change_ts", "1 second")
    out = run(S.interval_join(left, right, SEC, SEC), "joined", "append").where("service = 'a'")
    got = {r.event_id: r.change_id for r in out.collect()}
    assert got == {f"a{i}": "c" if 2 <= i <= 6 else None for i in range(10)}


def test_restart_gives_no_duplicates(spark, tmp_path):
    df = source(spark, tmp_path, [rows(20), rows(20, 20)])
    for _ in range(2):
        q = S.dedupe(S.with_event_ts(df, SEC)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_tracker_classes():
    t = Tracker(lateness_ns=10, grace_ns=5, idle_ns=100)
    assert [t.push("p", "a", 100, 0), t.push("p", "b", 95, 1), t.push("p", "a", 100, 2), t.push("p", "", 1, 2)] == ["on_time", "buffered_for_reorder", "duplicate", "invalid"]
    assert t.watermark == 90
    assert t.push("p", "c", 90, 3) == "late_revisable" and t.push("p", "d", 85, 3) == "beyond_grace"
    assert t.release() == ["c"] and t.drain() == ["b", "a"]
    t.push("q", "e", 300, 50)
    assert t.watermark == 90 and t.advance(120) == 290
    assert t.push("p", "f", 286, 130) == "late_revisable" and t.watermark == 290
    with pytest.raises(BufferFull):
        Tracker(capacity=0).push("p", "x", 1, 0)
    assert t.metrics(130)["counts"]["beyond_grace"] == 1


@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 1000)), max_size=60))
@settings(max_examples=100, deadline=None)
def test_watermark_never_goes_back_and_releases_in_order(events):
    t, before, out = Tracker(lateness_ns=50, grace_ns=20, idle_ns=10**9), None, []
    times = {}
    for i, (p, time) in enumerate(events):
        times[str(i)] = time
        t.push(p, str(i), time, i)
        assert before is None or t.watermark >= before
        before = t.watermark
        got = [times[e] for e in t.release()]
        assert got == sorted(got)
        out += got
    assert len(out) + len(t.drain()) + t.counts.get("beyond_grace", 0) == len(events)


def test_batches_by_rows_and_age():
    from tracewarp.streaming.batcher import Batcher

    b = Batcher(max_rows=3, max_age_ns=10)
    assert b.push("m", "c", 5, 0, {"i": 1}) == [] and b.push("m", "b", 5, 1, {"i": 2}) == [] and b.push("l", "x", 1, 2, {"i": 9}) == []
    assert b.push("m", "a", 4, 3, {"i": 3}) == [("m", [{"i": 3}, {"i": 1}, {"i": 2}])]
    assert b.push("m", "d", 1, 12, {"i": 4}) == [("l", [{"i": 9}])] and b.advance(21) == [] and b.flush() == [("m", [{"i": 4}])] and b.flush() == []


def test_inspector_reads_progress(spark, tmp_path, run):
    from tracewarp.streaming.inspector import inspect, inspect_query

    df = S.window_average(S.with_event_ts(source(spark, tmp_path, [rows(20)]), SEC), 5 * SEC)
    q = df.writeStream.outputMode("append").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "seen")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [inspect(p if isinstance(p, dict) else __import__("json").loads(p.json)) for p in q.recentProgress]
    assert sum(g["input_rows"] for g in got) == 20 and any(o["state_rows"] for g in got for o in g["operators"]) and inspect_query(q)["name"] == "seen"
    assert max(g["watermark_ns"] or 0 for g in got) == BASE + 19 * SEC // 2 - SEC
    assert inspect(None)["operators"] == []
