"""Queries over all traces, not a sample."""

from tracewarp.operators import graph
from tracewarp.plans.catalogue import ORACLES, QUERIES
from tracewarp.sources.telemetry import spans

SF = "/root/testdata/sf0.001"


def test_all_failed_traces_are_compared(spark):
    cohorts = graph.healthy_cohorts(spans(spark, SF)).where("median_trace_id is not null")
    want = {r.failed_trace_id for r in cohorts.select("failed_trace_id").collect()}
    df = QUERIES["trace_compare"](spark, SF)
    name = "failed_trace_id"
    assert {r[0] for r in df.select(name).distinct().collect()} == want and want


def test_the_view_has_peers_orphans_and_cycles(spark):
    s = spans(spark, SF)
    reach = {(r.service, r.caller) for r in graph.reach(graph.service_edges(s)).collect()}
    assert ("svc-2", "svc-2") in reach and ("db-0", "svc-0") in reach and ("svc-0", "svc-1") not in reach
    assert graph.traces(s).where("incomplete").count() > 0


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
