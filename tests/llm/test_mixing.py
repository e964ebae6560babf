from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarp.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, lang string, rate string, copies string, __copies int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "r", "c", 1) for r in rows], SCHEMA)


def raked(rows, shares, rounds=5000):
    """Rates by iterative proportional fitting over documents: (categories, tokens) rows, shares by constraint."""
    r, t = np.ones(len(rows)), np.array([x[-1] for x in rows], float)
    for _ in range(rounds):
        for c, s in enumerate(shares):
            for v, x in s.items():
                at = np.array([row[c] == v for row in rows])
                r[at] *= x * t.sum() / (r[at] @ t[at])
    return r


def test_equals_proportional_fitting(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out, tilt = M.rated(df)
    rows = out.withColumn("band", M.length_band(F.col("tokens"))).collect()
    keys = [(r.source, r.lang, r.band, r.tokens) for r in rows]
    shares = []
    for i, p in enumerate((M.TEMPER, M.TEMPER, 1.0)):
        s = {}
        for k in keys:
            s[k[i]] = s.get(k[i], 0) + k[-1]
        s = {v: (x / sum(s.values())) ** p for v, x in s.items()}
        shares.append({v: x / sum(s.values()) for v, x in s.items()})
    want = raked(keys, shares, 300)
    assert tilt.error < 1e-9 and tilt.steps < 30
    assert np.allclose([r.rate for r in rows], want, rtol=1e-5)
    assert all(np.floor(r.rate) <= r.copies <= np.floor(r.rate) + 1 for r in rows)
    total = sum(r.tokens for r in rows)
    assert abs(sum(r.tokens * r.copies for r in rows) / total - 1) < 0.1


def test_targets_are_met(spark):
    rows = [(i, "w " * (10 + i % 50), f"s{i % 3}", "en") for i in range(3000)]
    frame = docs(spark, rows)
    out, tilt = M.rated(frame, targets={"source": {"s0": 3, "s1": 1, "nowhere": 5}})
    got = {r.source: (r.rated, r.copied) for r in out.groupBy("source").agg(F.sum(F.expr("tokens * rate")).alias("rated"), F.sum(F.expr("tokens * copies")).alias("copied")).collect()}
    total = sum(10 + i % 50 for i in range(3000))
    assert tilt.error < 1e-9
    assert got["s0"][0] / total == pytest.approx(0.75) and got["s1"][0] / total == pytest.approx(0.25) and got["s2"] == (0, 0)
    assert got["s0"][1] / total == pytest.approx(0.75, abs=0.03)
    again = M.mixed(frame, targets={"source": {"s0": 3, "s1": 1}})
    assert again.columns == frame.columns and {r.rate for r in again.collect()} == {"r"}
    assert again.count() == out.agg(F.sum("copies")).first()[0]


def test_edge_cases(spark):
    rows = [(1, "a b c", None, "en"), (1, "a b c", None, "en"), (2, None, "s", None), (3, "", "s", "fr"), (None, "x \n y", "null", "fr"), (5, "w " * 300_000, "s", "fr"), (6, " ", None, None)]
    out, tilt = M.rated(docs(spark, rows))
    got = {(r.doc_id, r.source): (r.tokens, r.rate, r.copies) for r in out.collect()}
    assert [got[k][0] for k in ((1, None), (2, "s"), (3, "s"), (None, "null"), (5, "s"), (6, None))] == [3, 0, 0, 2, 300_000, 0]
    assert out.count() == 7 and all(np.isfinite(v[1]) for v in got.values())
    assert M.mixed(docs(spark, rows)).columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


@pytest.mark.parametrize("rows", [[], [(1, None, "a", "b"), (2, "", None, None)]])
def test_no_tokens(spark, rows):
    out, tilt = M.rated(docs(spark, rows))
    assert [r.copies for r in out.collect()] == [0] * len(rows) and M.mixed(docs(spark, rows)).count() == 0


def test_coins_are_even(spark):
    u = [r[0] for r in spark.range(4000).select(M.coin("id")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.03


def test_targets_that_cant_be_met_are_refused(spark):
    rows = [(i, "w " * 10, "ab"[i % 2], "xy"[i % 2]) for i in range(100)]
    with pytest.raises(M.UnmetTargets, match="source"):
        M.rated(docs(spark, rows), targets={"source": {"nowhere": 1}})
    with pytest.raises(M.UnmetTargets, match="together"):
        M.mixed(docs(spark, rows), targets={"source": {"a": 1, "b": 3}, "lang": {"x": 3, "y": 1}})


def test_tokens_are_counted_once_a_pass(spark):
    df = M.mixed(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count") + plan.count("regexp_extract_all") == 1 and "regexp_replace" not in plan


def test_tokens_are_runs_between_white_space(spark):
    texts = ["a  b\t\nc", " ", "", None, "\u00a0x y", "one", " lead and trail \n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(M.token_count()).collect()] == [3, 0, 0, 0, 2, 1, 3]
