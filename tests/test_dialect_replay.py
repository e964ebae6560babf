from __future__ import annotations

import json

import pytest

from tracewarp import __main__ as cli
from tracewarp.functions.eventtime import hop_starts, tumble_start
from tracewarp.operators import windows
from tracewarp.plans.dialect import DialectError, Session
from tracewarp.replay import CheckpointStore, Clock
from tracewarp.replay import Session as Replay
from tracewarp.sources import fixtures

SEC = 1_000_000_000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return fixtures.write_memory_incident(str(tmp_path_factory.mktemp("replay") / "rec-mem-001"))


@pytest.fixture(scope="module")
def replay(spark, folder):
    s = Replay(spark, folder)
    s.clock.seek(s.clock.end_ns)
    return s


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "sql,why",
    [
        ("SELECT service FROM metrics; SELECT name FROM metrics", "one statement"), ("SELECT DISTINCT service FROM metrics", "DISTINCT"), ("SELECT service FROM metrics ORDER BY service", "LIMIT"),
        ("SELECT service FROM nothing", "unknown table"), ("SELECT nothing FROM metrics", "unknown column"), ("SELECT service FROM metrics WHERE service IN (SELECT service FROM logs)", "IN"),
        ("SELECT * FROM metrics", "wildcard"), ("WITH x AS (SELECT 1) SELECT a FROM x", "WITH"), ("SELECT service FROM metrics UNION SELECT service FROM logs", "UNION"),
        ("SELECT service, COUNT(*) FROM metrics GROUP BY service HAVING COUNT(*) > 1", "HAVING"), ("SELECT COUNT(DISTINCT service) FROM metrics", "DISTINCT"), ("SELECT COUNT(*) FILTER (WHERE value > 1) FROM metrics", "FILTER"),
        ("SELECT SUM(value) OVER () FROM metrics", "OVER"), ("SELECT upper(service) FROM metrics", "unknown function"), ("SELECT SUM(value, 2) FROM metrics", "one argument"), ("SELECT service FROM metrics LIMIT 1 OFFSET 2", "OFFSET"),
        ("SELECT service FROM metrics JOIN logs ON service = service", "only deployments"), ("SELECT service FROM metrics JOIN deployments ON name = change_id", "service = service"), ("SELECT service, value FROM metrics GROUP BY service", "neither grouped"),
        ("SELECT service FROM metrics WHERE value = 'x'", "compared"), ("SELECT TUMBLE(value, '1s') FROM metrics", "event_time"), ("SELECT TUMBLE(event_time, '1h') FROM metrics", "duration"), ("SELECT service FROM (SELECT service FROM metrics)", "name"),
        ("SELECT service FROM metrics ORDER BY value LIMIT 3", "no such column"), ("SELECT service FROM metrics ORDER BY service NULLS FIRST LIMIT 3", "NULLS"), ("SELECT service FROM metrics WHERE service IS NULL", "IS"), ("SELECT service FROM metrics, logs", "several tables"),
        ("SELECT service FROM metrics WHERE COUNT(*) > 1", "WHERE"), ("SELECT TUMBLE(event_time,'1s'), HOP(event_time,'2s','1s') FROM metrics", "one window"), ("SELECT MAX(MIN(value)) FROM metrics", "nest"), ("SELECT se§rvice FROM metrics", "read"),
    ],
)
def test_refusals(replay, sql, why):
    with pytest.raises(DialectError, match=why):
        replay.query(sql)


def test_canonical_queries(replay):
    p99 = rows(replay.query("SELECT service, TUMBLE(event_time,'1s'), P99(value) AS p99 FROM metrics WHERE name LIKE '%latency%' GROUP BY service"))
    stream = {(r.service, r.window_start): r.p99 for r in windows.window_percentiles(replay.at_cursor().metrics, SEC).collect()}
    assert len(p99) == 80 and {(s, w): p for s, w, p in p99} == pytest.approx(stream, abs=1e-9)
    err = replay.query("SELECT service, TUMBLE(event_time,'1s'), AVG(value) AS err FROM metrics WHERE name LIKE '%error_rate%' GROUP BY service")
    assert err.columns == ["service", "window_start", "err"] and err.count() == 80
    j = rows(replay.query("SELECT service, name, value, change_id, delay_ns FROM metrics JOIN deployments ON service = service WHERE name LIKE '%latency%' AND change_id != '' ORDER BY delay_ns LIMIT 20"))
    assert j and {r[3] for r in j} == {"deploy-rec-v2"} and [r[4] for r in j] == sorted(r[4] for r in j) and max(abs(r[4]) for r in j) <= 10 * SEC


def test_meaning(spark):
    t = spark.createDataFrame([("a", "x_1", 1.0, 5), ("a", "xy", None, 15), ("b", "x_1", 4.0, 25), (None, "n", 9.0, 1)], "service string, name string, value double, event_time long")
    s = Session(spark, {"metrics": t, "deployments": spark.createDataFrame([("e", "a", "c1", "deployment", None, 4)], "event_id string, service string, change_id string, change_type string, version_after string, event_time long")}, lookback_ns=2, lookahead_ns=0)
    q = lambda sql: sorted(rows(s.query(sql)), key=repr)
    assert q("SELECT COUNT(*) AS n, COUNT(value) AS v, SUM(value) AS s FROM metrics WHERE value > 100") == [(0, 0, 0.0)]
    assert q("SELECT COUNT(*) AS n, COUNT(value) AS v, MIN(value) AS lo, P50(value) AS p, P99(event_time) AS e FROM metrics")[0][:3] == (3, 2, 1.0)
    assert q("SELECT service FROM metrics GROUP BY service") == [("a",), ("b",)]
    assert q("SELECT name FROM metrics WHERE name LIKE 'x'") == [] and q("SELECT name FROM metrics WHERE name LIKE 'x_'") == [("xy",)]
    assert q("SELECT value FROM metrics WHERE value = value OR NOT value > 0") == [(1.0,), (4.0,)]
    assert q("SELECT value / 0 AS z, value + 1 AS p FROM metrics WHERE service = 'b'") == [(None, 5.0)]
    assert q("SELECT COUNT(*) AS n, HOP(event_time, '20ns', '10ns') AS w FROM metrics") == [(1, 0), (1, 20), (2, 10)] or q("SELECT HOP(event_time, '20ns', '10ns') AS w, COUNT(*) AS n FROM metrics") == [(0, 2), (10, 2), (20, 1)]
    assert q("SELECT service, change_id, delay_ns FROM metrics LEFT JOIN deployments ON metrics.service = deployments.service") == [("a", "c1", 1), ("a", None, None), ("b", None, None)]
    assert q("SELECT service, delay_ns FROM metrics JOIN deployments ON service = service") == [("a", 1)]
    assert q("SELECT incident_id FROM incidents") == []
    assert q("SELECT SUM(value) + COUNT(*) AS both FROM metrics") == [(8.0,)]


def test_explain(replay):
    e = json.loads(replay.explain("SELECT service, COUNT(*) AS n FROM metrics WHERE value > 1 GROUP BY service ORDER BY n LIMIT 2", analyze=True))
    assert e["steps"] == ["scan metrics", "filter", "aggregate", "project", "top 2"] and e["rows"] == 2 and "plan" in e


def test_windows_floor_and_gap(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(-7,), (0,), (75,), (99,), (100,), (None,)], "t long")
    assert rows(df.select(tumble_start(F.col("t"), 100), hop_starts(F.col("t"), 100, 50), hop_starts(F.col("t"), 10, 50))) == [(-100, [], []), (0, [0], [0]), (0, [0, 50], []), (0, [0, 50], []), (100, [50, 100], [100]), (None, None, None)]


def test_replay_at_a_cursor(spark, folder, replay):
    s = Replay(spark, folder)
    assert s.clock.cursor_ns == s.clock.start_ns and s.timeline().count() == 15
    s.clock.seek(s.clock.start_ns + 4 * SEC)
    assert s.root_causes().where("score > 0").count() == 0 and s.correlation().count() == 0
    assert replay.heatmap().count() == 80 and replay.traces().count() == 48 and replay.topology()[1].count() == 2
    assert {r.signal: r.events for r in replay.stats().collect()} == {"metric": 240, "span": 144, "log": 2, "deployment": 1}
    c = replay.correlation().first()
    assert (c.change_id, c.p99_before, c.windows, c.anomaly_delay_ns) == ("deploy-rec-v2", 40.0, 11, 0)
    assert replay.case()["best_rank"] == 1


def test_a_failed_trace_in_detail(replay):
    d = replay.trace("trace-12-0")
    assert d["spans"].count() == 3 and d["cohort"].first().confidence == 1.0 and len(d["cohort"].first().cohort) == 15
    assert {r.service: r.contribution_ns for r in d["critical_path"].collect()}["recommendationservice"] > 0
    assert {r.path.rsplit(":", 1)[1]: r.delta_ns for r in d["comparison"].collect()}["ListRecommendations"] > 0
    assert replay.trace("trace-1-1")["cohort"].count() == 0


def test_session_calls(spark, folder):
    s = Replay(spark, folder)
    s.clock.seek(s.clock.end_ns)
    assert s.snapshot()["events"] == {"metric": 240, "span": 144, "log": 2, "deployment": 1} and s.resync()["cursor_ns"] == s.clock.end_ns
    view = s.root_cause_view()
    assert view["candidates"].where("rank = 1").first().service == "recommendationservice" and view["nodes"].count() == 14 and view["refs"].count() > 0
    assert s.validate("SELECT COUNT(*) AS n FROM metrics") is None and "HAVING" in s.validate("SELECT COUNT(*) AS n FROM metrics GROUP BY service HAVING n > 1")
    s.reset()
    assert s.clock.cursor_ns == s.clock.start_ns and s.snapshot()["events"].get("deployment") is None


def test_least_and_largest_times_keep_their_digits(spark):
    t = spark.createDataFrame([("a", "n", 1.0, 1704067207179575043), ("a", "n", None, 1704067207179575041)], "service string, name string, value double, event_time long")
    assert tuple(Session(spark, {"metrics": t}).query("SELECT MIN(event_time) AS a, MAX(event_time) AS b FROM metrics").first()) == (1704067207179575041, 1704067207179575043)


def test_clock():
    c = Clock(100, 1000)
    assert c.tick(50) == 100
    c.play()
    assert c.tick(50) == 150
    c.set_speed(10.0)
    assert c.tick(10) == 250
    c.pause()
    assert c.tick(10) == 250
    c.seek(5000)
    assert c.cursor_ns == 1000
    c.seek(0)
    c.play()
    c.set_speed(float("inf"))
    assert c.tick(1) == 1000 and c.state == "paused"
    c.stop()
    assert c.cursor_ns == 100
    with pytest.raises(ValueError):
        c.set_speed(3.0)


def test_checkpoints_fall_back_over_corrupt_ones(tmp_path):
    s = CheckpointStore(str(tmp_path), keep=3)
    assert s.recover() is None
    for i in range(5):
        s.write({"n": i})
    assert s.recover()[:2] == (5, {"n": 4}) and sorted(p.name for p in tmp_path.glob("cp-*")) == ["cp-3", "cp-4", "cp-5"]
    (tmp_path / "cp-5/state.json").write_bytes(b'{"n": 99}')
    assert s.recover()[0] == 4
    (tmp_path / "cp-4/manifest.json").write_bytes(b'{"id": 4')
    n, state, passed = s.recover()
    assert (n, state, len(passed)) == (3, {"n": 2}, 2)
    (tmp_path / "cp-3/manifest.json").unlink()
    assert s.recover() is None
    assert s.write({"n": 7}) == 6 and s.recover()[0] == 6
    (tmp_path / ".tmp-7").mkdir()
    assert s.recover()[0] == 6 and s.write({"n": 8}) == 7


def test_crash_and_recovery(spark, folder, tmp_path):
    s = Replay(spark, folder, str(tmp_path))
    s.clock.seek(s.clock.start_ns + 9 * SEC)
    s.checkpoint()
    again, same = Replay.recovered(spark, str(tmp_path))
    assert same and again.clock.cursor_ns == s.clock.cursor_ns and again.evidence_ids()


def test_command_line(tmp_path, capsys, spark):
    assert cli.main(["version"]) == 0 and cli.main(["generate", str(tmp_path)]) == 0 and cli.main(["validate", str(tmp_path)]) == 0
    r = cli.report(spark, str(tmp_path))
    assert r["overall"]["incidents"] == 17 and r["overall"]["top1"] == 1.0 and "| all | 17 | 1.000" in cli.markdown(r)
    (tmp_path / "fixtures/v1/rec-mem-001/metrics/part-00000.parquet").write_bytes(b"x")
    assert cli.main(["validate", str(tmp_path)]) == 1
