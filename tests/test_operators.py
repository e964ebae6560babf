from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tracewarp.functions.ddsketch import ALPHA, merge, quantiles, sketch
from tracewarp.operators import graph, ingest, joins, relational
from tracewarp.operators.projections import number

P = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def distributions():
    r = random.Random(3)
    return {
        "uniform": [r.uniform(0, 1000) for _ in range(2000)], "normalish": [sum(r.random() for _ in range(12)) * 10 for _ in range(2000)], "skewed": [r.random() ** 4 * 500 for _ in range(2000)],
        "heavy_tail": [r.paretovariate(1.2) for _ in range(2000)], "identical": [42.0] * 500, "small": [1.0, 2.0, 3.0], "large": [float(i) for i in range(20_000)],
        "outliers": [10.0] * 990 + [1e6] * 10, "signed": [r.gauss(0, 50) for _ in range(2000)], "with_odd": [float("nan"), float("inf"), float("-inf"), 0.0, 5.0] + [7.0] * 50,
    }


def test_sketch_is_accurate_and_merges(spark):
    data = distributions()
    df = spark.createDataFrame([(k, i % 2, v) for k, vs in data.items() for i, v in enumerate(vs)] + [("none", 0, None)], "k string, half int, v double")
    whole = sketch(df, ["k"], F.col("v"))
    parts = merge(sketch(df.where("half = 0"), ["k"], F.col("v")).unionByName(sketch(df.where("half = 1"), ["k"], F.col("v"))))
    got = {r.k: r for r in quantiles(whole, P).collect()}
    assert got == {r.k: r for r in quantiles(parts, P).collect()} and "none" not in got
    for k, vs in data.items():
        vs = sorted(v for v in vs if math.isfinite(v))
        assert got[k]["count"] == len(vs)
        for p, q in P.items():
            exact = vs[math.floor(q * (len(vs) - 1))]
            assert abs(got[k][p] - exact) <= 1.0001 * ALPHA * abs(exact) + 1e-9, (k, p)


def test_interval_join_bounds_are_inclusive(spark):
    left = spark.createDataFrame([("a", t, f"l{t}") for t in (0, 99, 100, 1000, -150)] + [("b", 100, "lb"), (None, 100, "ln"), ("a", None, "lt")], "service string, event_time long, ref string")
    right = spark.createDataFrame([("a", 200, "r"), ("a", -50, "m"), (None, 100, "n"), ("a", None, "t")], "service string, change_time long, change_id string")
    out = joins.interval_join(left, right, "service", "event_time", "change_time", 100, 100)
    got = sorted(((r.ref, r.change_id) for r in out.collect()), key=repr)
    assert got == sorted([("l0", "m"), ("l99", None), ("l100", "r"), ("l1000", None), ("l-150", "m"), ("lb", None), ("ln", None), ("lt", None)], key=repr)
    assert joins.interval_join(left, right, "service", "event_time", "change_time", 100, 100, "inner").count() == 3
    assert joins.interval_join(left, right, "service", "event_time", "change_time", 0, 0).count() == 8
    with pytest.raises(ValueError):
        joins.interval_join(left, right, "service", "event_time", "change_time", 1, 1, "full")


def test_interval_join_equals_the_plain_condition(spark):
    r = random.Random(1)
    left = spark.createDataFrame([("ab"[i % 2], r.randint(-500, 500), i) for i in range(300)], "service string, event_time long, l int")
    right = spark.createDataFrame([("ab"[i % 2], r.randint(-500, 500), i) for i in range(60)], "s string, change_time long, r int")
    plain = left.join(right, (F.col("service") == F.col("s")) & F.col("change_time").between(F.col("event_time") - 37, F.col("event_time") + 11), "left")
    mine = joins.interval_join(left, right.withColumnRenamed("s", "service"), "service", "event_time", "change_time", 37, 11)
    assert sorted(((x.l, x.r) for x in mine.collect()), key=repr) == sorted(((x.l, x.r) for x in plain.collect()), key=repr)


def test_repeated_changes_count_once(spark):
    t = spark.createDataFrame([("a", 10, "e")], "service string, event_time long, event_id string")
    c = spark.createDataFrame([("x", "a", 5, "c1", "deployment", "v")] * 3, "event_id string, service string, event_time long, change_id string, change_type string, version_after string")
    rows = joins.change_join(t, c, 10, 10).collect()
    assert [(r.change_id, r.delay_ns) for r in rows] == [("c1", 5)]


def test_correlation_of_emits_ignores_finalisations(spark):
    emits = spark.createDataFrame([("c", "a", 100, "r1"), ("c", "a", 100, "r1"), ("c", "a", 100, "r2"), (None, "a", 0, "r3")], "change_id string, service string, change_time long, telemetry_ref string")
    p99 = spark.createDataFrame([("a", 0, 50, 9.0), ("a", 50, 100, 2.0), ("a", 100, 150, 2.9), ("a", 150, 200, 3.0)], "service string, window_start long, window_end long, p99 double")
    r = joins.emit_correlation(emits, p99).first()
    assert (r.matches, r.refs, r.p99_before, r.p99_after, r.first_anomaly, r.delay_ns) == (3, ["r1", "r2"], 2.0, 2.9, 150, 50)


def test_admission(spark):
    df = spark.createDataFrame([(1, "a", 3, "x"), (1, "a", 1, "y"), (2, "b", 2, "z"), (1, "", 4, "w"), (1, None, 5, "v"), (1, "c", 0, None)], "schema_version int, event_id string, arrival long, v string")
    kept = ingest.first_arrivals(ingest.valid(df), "arrival")
    assert sorted((r.event_id, r.v) for r in kept.collect()) == [("a", "y"), ("c", None)]
    big = spark.range(1000).select(F.col("id").alias("event_id"), ((F.col("id") * 7919) % 1000).alias("arrival")).repartition(7)
    rows = ingest.arrival_numbers(big, ["arrival"]).collect()
    assert sorted(r.ingest_sequence for r in rows) == list(range(1, 1001)) and all(r.ingest_sequence == r.arrival + 1 for r in rows)


def test_predicates_take_null_for_false(spark):
    df = spark.createDataFrame([("a", "lat", 1.0), ("a", None, 5.0), (None, "lat", None)], "service string, name string, value double")
    r = relational
    count = lambda p: r.select_rows(df, p).count()
    assert [count(p) for p in (r.service_is("a"), r.name_contains("at"), r.value_above(2), r.value_below(2), r.service_is("a") & r.value_above(2), r.name_contains("l") | r.value_above(2))] == [2, 2, 1, 1, 1, 3]


def test_projection_keeps_time_and_service(spark):
    df = spark.createDataFrame([(1, "a", 2.0, "n")], "event_time long, service string, value double, name string")
    out = relational.project(df, [("value", "v", 10.0), ("name", "label"), "service"])
    assert out.columns == ["event_time", "v", "label", "service"] and tuple(out.first()) == (1, 20.0, "n", "a")


def test_numbers_have_no_needless_fraction(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (-3.0,)], "x double")
    assert [r[0] for r in df.select(number(F.col("x"))).collect()] == ["1", "1.5", "-3"]


def test_peers_and_parents(spark):
    schema = "trace_id string, span_id string, parent_span_id string, service string, operation string, start_time_ns long, end_time_ns long, duration_ns long, status string, peer_service string"
    rows = [
        ("t", "1", None, "a", "o", 0, 9, 9, "ok", "b"), ("t", "2", "1", "b", "o", 1, 5, 4, "error", None), ("t", "3", "2", "b", "o", 2, 3, 1, "ok", "b"), ("t", "4", "late", "c", "o", 3, 4, 1, "ok", None),
        ("t", "late", "1", "d", "o", 5, 6, 1, "ok", "e"), ("t", "6", "gone", "f", "o", 5, 6, 1, "ok", None), ("t", "7", "1", None, "o", 5, 6, 1, "ok", None),
    ]
    s = spark.createDataFrame(rows, schema)
    assert {(r.source, r.target, r.calls, r.errors) for r in graph.service_edges(s).collect()} == {("a", "b", 2, 1), ("d", "e", 1, 0)}
    assert {(r.service, r.spans) for r in graph.service_nodes(s).collect()} == {("a", 1), ("b", 2), ("c", 1), ("d", 1), ("e", 0), ("f", 1)}
    assert graph.traces(s).first().incomplete


def test_reach_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("y", "y")], "source string, target string")
    got = {(r.service, r.caller) for r in graph.reach(e).collect()}
    assert got == {(s, c) for s in "abc" for c in "abcx"} | {("y", "y")}
