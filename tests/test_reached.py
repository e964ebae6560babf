"""Joins of which no pair is a row, against what pairs give."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F
from tracewarp.functions.ordered import first_above, kth_smallest, percentile_of
from tracewarp.operators import joins
from tracewarp.plans.catalogue import ORACLES, QUERIES
from tracewarp.sources.telemetry import changes, metrics

SF = "/root/testdata/sf0.001"
CHANGE = "event_id string, service string, event_time long, change_id string, change_type string, version_after string"
METRIC = "service string, event_time long, event_id string, name string, value double"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 500])
def test_ranges_are_asked_right(n):
    r = np.random.default_rng(n)
    v = np.round(r.normal(size=n), 1)
    order = np.argsort(v, kind="stable")
    rank, ranked = np.empty(n, np.int64), v[order]
    rank[order] = np.arange(n)
    low = r.integers(0, n + 1, 200)
    high, limit = np.maximum(low, r.integers(0, n + 1, 200)), r.normal(size=200)
    p = percentile_of(ranked, kth_smallest(rank), low, high, 0.99)
    first = first_above(rank, np.searchsorted(ranked, limit, "right"), low, high)
    for a, b, x, lim, f in zip(low, high, p, limit, first):
        assert np.isclose(x, np.quantile(v[a:b], 0.99) if b > a else math.nan, equal_nan=True)
        assert f == next((i for i in range(a, b) if v[i] > lim), -1)


def odd_tables(spark):
    r = random.Random(5)
    value = lambda: r.choice([None, math.nan, math.inf, 0.0, -2.0, 1.0, 3.0, 9.0, r.random() * 20])
    m = [(r.choice(["a", "b", None]), r.choice([None, r.randint(-300, 300)]) if i % 9 == 0 else r.randint(-300, 300), r.choice([None, f"e{r.randint(0, 250)}"]), r.choice(["lat", "lat", "mem", None]), value()) for i in range(400)]
    c = [(f"x{i}", r.choice(["a", "b", "c", None]), None if i % 11 == 0 else r.randint(-300, 300), r.choice([None, f"c{i}", f"c{i // 2}"]), "deployment", "v") for i in range(60)]
    return spark.createDataFrame(m, METRIC), spark.createDataFrame(c, CHANGE)


def test_correlation_equals_the_pairs(spark):
    m, c = odd_tables(spark)
    horizon = 70
    lat = m.where("name like '%lat%'").select("service", "event_time", "value").collect()
    once = {}
    for x in c.collect():
        key = (x.service is not None, x.service or "", x.event_time is not None, x.event_time or 0)
        once[x.change_id] = min(once.get(x.change_id, (key, x)), (key, x), key=lambda y: y[0])
    out = joins.correlation(m, c, horizon)
    assert "Join" not in plan(out)
    got = {r.change_id: r for r in out.collect()}
    assert len(got) == len(once)
    size = lambda v: (math.isnan(v), v)

    def p99(v):
        v = sorted(v, key=size)
        at = 0.99 * (len(v) - 1)
        x, y = v[math.floor(at)], v[math.ceil(at)]
        return x if math.floor(at) == math.ceil(at) or x == y else (math.ceil(at) - at) * x + (at - math.floor(at)) * y

    same = lambda a, b: a == b or a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b))
    for i, (_, x) in once.items():
        near = sorted((t, v) for s, t, v in lat if None not in (x.service, x.event_time, t, v) and s == x.service and abs(t - x.event_time) <= horizon)
        before, after = [v for t, v in near if t < x.event_time], [v for t, v in near if t >= x.event_time]
        b, a, g = p99(before) if before else None, p99(after) if after else None, got[i]
        assert same(g.p99_before, b) and same(g.p99_after, a) and g.windows == len(after), (i, g, b, a)
        limit = 1.5 * (b if b is not None and (math.isnan(b) or b > 1) else 1.0)
        first = min((t for t, v in near if t >= x.event_time and size(v) > size(limit)), default=None)
        assert g.first_anomaly == first and g.anomaly_delay_ns == (None if first is None else first - x.event_time)


@pytest.mark.parametrize("listed", [7, 2**18])
def test_matches_of_changes_equal_those_of_the_join(spark, monkeypatch, listed):
    monkeypatch.setattr(joins, "LISTED", listed)
    m, c = odd_tables(spark)
    c = c.unionByName(c.where("event_id in ('x1', 'x2')").withColumn("event_id", F.lit("again")))
    p99 = spark.createDataFrame([(s, t, t + 50, float(abs(t) % 7)) for s in "ab" for t in range(-300, 300, 50)], "service string, window_start long, window_end long, p99 double")
    emits = joins.change_join(m, c, 40, 25).select("change_id", "service", "change_time", F.col("event_id").alias("telemetry_ref"))
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    want = key(joins.emit_correlation(emits, p99).collect())
    assert key(joins.change_correlation(m, c, p99, 40, 25).collect()) == want and want


@pytest.mark.parametrize("name", ["emit_correlation", "deploy_correlation"])
def test_no_pair_of_a_change_and_a_sample_is_a_row(spark, name):
    """Nothing is shuffled after changes and samples have met, and they don't meet in a join."""
    out = QUERIES[name](spark, SF)
    above = plan(out).split("MapInArrow")[0]
    assert "MapInArrow" in plan(out) and not any(x in above for x in ("Join", "Aggregate", "Repartition", "Sort"))
    compare(spark, name, QUERIES[name], ORACLES[name], SF)


def test_a_service_without_changes_and_changes_without_samples(spark):
    m, c = metrics(spark, SF), changes(spark, SF)
    assert joins.correlation(m, c.where("1 = 0"), 10).count() == 0
    none = joins.correlation(m.where("1 = 0"), c, 10)
    assert none.count() == c.select("change_id").distinct().count() and none.where("windows > 0 or p99_before is not null").count() == 0


COUNTED = [
    "SELECT service, change_type, COUNT(*) AS n, AVG(value) AS mean, SUM(value) AS total, MIN(value) AS low, MAX(event_time) AS last, COUNT(value) AS some FROM t {} JOIN deployments ON service = service GROUP BY service, change_type",
    "SELECT COUNT(*) AS n, SUM(value * 2) AS total FROM t {} JOIN deployments ON service = service WHERE name LIKE '%lat%'",
    "SELECT change_id, version_after, COUNT(*) AS n FROM t {} JOIN deployments ON service = service WHERE value > 1 AND version_after = 'v' GROUP BY change_id, version_after",
    "SELECT TUMBLE(event_time, '100ns') AS w, name, COUNT(*) AS n, AVG(value) AS mean FROM t {} JOIN deployments ON service = service WHERE name LIKE 'nothing' OR change_type = 'deployment' GROUP BY name, TUMBLE(event_time, '100ns')",
    "SELECT COUNT(*) AS n, AVG(value) AS mean, SUM(value) AS total FROM t {} JOIN deployments ON service = service WHERE name LIKE 'nothing'",
]


@pytest.mark.parametrize("text", COUNTED)
def test_aggregates_over_counted_joins_equal_those_over_pairs(spark, monkeypatch, text):
    from tracewarp.plans.dialect import Session

    m, c = odd_tables(spark)
    m = m.where("value is null or abs(value) < 100")
    c = c.withColumn("change_type", F.when(F.col("event_time") % 3 == 0, None).when(F.col("event_time") % 3 == 1, "flag").otherwise("deployment"))
    s = Session(spark, {"t": m, "deployments": c}, lookback_ns=30, lookahead_ns=80)
    out = s.query(text.format("INNER"))
    assert "Join" not in plan(out)
    monkeypatch.setattr(Session, "_counted", lambda self, s, df: None)
    want = s.query(text.format("INNER"))
    assert "Join" in plan(want) and out.dtypes == want.dtypes
    key = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    assert key(out) == key(want) and key(want)


@pytest.mark.parametrize("text", ["SELECT service, MAX(delay_ns) AS d FROM t {} JOIN deployments ON service = service GROUP BY service", "SELECT service, P50(value) AS p FROM t {} JOIN deployments ON service = service GROUP BY service", "SELECT event_id FROM t {} JOIN deployments ON service = service"])
def test_what_needs_pairs_keeps_them(spark, text):
    from tracewarp.plans.dialect import Session

    m, c = odd_tables(spark)
    assert "Join" in plan(Session(spark, {"t": m, "deployments": c}, lookback_ns=30, lookahead_ns=80).query(text.format("INNER")))
    assert "Join" in plan(Session(spark, {"t": m, "deployments": c}).query(COUNTED[1].format("LEFT")))
