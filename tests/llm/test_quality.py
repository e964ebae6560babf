from __future__ import annotations

import numpy as np

from tracewarp.llm import quality as Q

SCHEMA = "doc_id long, text string, score string, label int, __id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 7) for i, t in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def corpus(n=120):
    rng = np.random.default_rng(0)
    w = [f"word{i}" for i in range(60)]
    good = [" ".join(rng.choice(w, 30)) + "." for _ in range(n)]
    bad = [" ".join(x + "!!" for x in rng.choice(w, 30)) if i % 2 else " ".join([w[i % 60]] * 30) for i in range(n)]
    return [(i, t) for i, t in enumerate(good + bad)], [(i, int(i < n)) for i in range(2 * n)]


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, held = lab.where("doc_id % 2 = 0"), lab.where("doc_id % 2 = 1")
    w = Q.fit(d, train)
    rows = Q.scored(d.join(held, "doc_id"), w).select("quality", "score").collect()
    right = [(r.score >= Q.THRESHOLD) == bool(r.quality) for r in rows]
    good = [r.score >= Q.THRESHOLD for r in rows if r.quality]
    assert len(rows) > 1000 and np.mean(right) > 0.98 and np.mean(good) > 0.99


def test_scores_equal_dense_products():
    texts = ["a b c a", "b b b", "", None, "  ", "c!!! a"]
    w = np.random.default_rng(1).normal(size=Q.DIM + 1).astype(np.float32)
    row, feature, value = Q.features(texts)
    for i, t in enumerate(texts):
        x = np.zeros(Q.DIM)
        np.add.at(x, feature[row == i], value[row == i])
        if t and t.strip():
            assert abs((x**2).sum() - 1) < 1e-9
            assert abs(Q.scores(texts, w)[i] - 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))) < 1e-9
        else:
            assert Q.scores(texts, w)[i] == 0


def test_repeated_token_is_one_feature_whatever_the_token():
    a, b = (set(Q.features([t])[1]) for t in ("x x x", "y y y"))
    assert len(a & b) == 1


def test_bound_order_and_edge_cases(spark):
    d, lab = corpus()
    lab = lab + [(None, 1), (5, None), (999, 0), (3, 0)]
    extra = [(1000, None), (1001, ""), (1002, " \n"), (None, "word1 word2 word3."), (1003, "word1 " * 100_000), (0, d[0][1])]
    frame, labs = docs(spark, d + extra), labels(spark, lab)
    k = Q.kept(frame, labs)
    assert k.columns == ["doc_id", "text", "label", "__id", "score"]
    got = [r.doc_id for r in k.collect()]
    assert not {1000, 1001, 1002, 1003} & set(got) and None in got and got.count(0) == 2
    assert np.mean([i in got for i in range(120)]) > 0.97 and np.mean([i in got for i in range(120, 240)]) < 0.03
    a, b = Q.fit(frame, labs), Q.fit(frame.repartition(7), labs)
    assert np.array_equal(a, b)
    assert not np.array_equal(a, Q.fit(frame, labs, max_labelled=40))


def test_empty_tables_and_one_class(spark):
    d, lab = corpus(5)
    assert Q.kept(docs(spark, []), labels(spark, lab)).count() == 0
    for x in ([], [(i, 1) for i in range(10)]):
        assert {r.score for r in Q.kept(docs(spark, d), labels(spark, x)).collect()} == {1.0}


def brute_kept(spark, rows, labels, most=Q.MAX_LABELLED):
    """(doc_id, score) that the query keeps, by dictionaries and loops: features, updates and scores are written anew."""
    import math
    import re

    import xxhash
    from pyspark.sql import functions as F

    whole = 2**64

    def vector(text):
        h = [xxhash.xxh3_64_intdigest(w) for w in re.findall(r"\w+|[^\w\s]+", text)]
        both = h + [0x5851F42D4C957F2D if a == b else (a * 0x9E3779B97F4A7C15 % whole) ^ ((b * 0xC2B2AE3D27D4EB4F + (a >> 7)) % whole) for a, b in zip(h, h[1:])]
        count = {}
        for x in both:
            f = (x * 0x9E3779B97F4A7C15 % whole) >> 46
            count[f] = count.get(f, 0) + 1
        norm = math.sqrt(sum(c * c for c in count.values()))
        return {f: c / norm for f, c in count.items()}

    said = {}
    for i, y in labels:
        said.setdefault(i, set()).add(y)
    fine = [i for i, y in said.items() if len(y) == 1]
    order = {r.i: r.h for r in spark.createDataFrame([(i,) for i in fine], "i long").select("i", F.xxhash64("i").alias("h")).collect()}
    chosen = set(sorted(fine, key=lambda i: (order[i], i))[:most])
    seen = [(xxhash.xxh3_64_intdigest(str(i)), vector(t), next(iter(said[i]))) for i, t in rows if i in chosen and t and t.strip()]
    z, n = {}, {}

    def weight(f):
        if abs(z.get(f, 0.0)) <= Q.L1:
            return 0.0
        return -(z[f] - math.copysign(Q.L1, z[f])) / ((Q.BETA + math.sqrt(n[f])) / Q.ALPHA + Q.L2)

    for _ in range(Q.EPOCHS):
        for _, v, y in sorted(seen, key=lambda s: s[0]):
            x = {**v, "bias": 1.0}
            w = {f: weight(f) for f in x}
            p = 1 / (1 + math.exp(-sum(w[f] * x[f] for f in x)))
            for f in x:
                g = (p - y) * x[f]
                sigma = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / Q.ALPHA
                z[f] = z.get(f, 0.0) + g - sigma * w[f]
                n[f] = n.get(f, 0.0) + g * g
    out = []
    for i, t in rows:
        v = vector(t or "")
        s = 1 / (1 + math.exp(-sum(weight(f) * x for f, x in v.items()) - weight("bias"))) if v else 0.0
        out.append((i, s))
    return out


def test_query_equals_loops_over_dictionaries(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    want = dict(brute_kept(spark, rows, labels))
    from tracewarp.llm.queries import QUERIES

    got = {r.doc_id: r.score for r in QUERIES["op4_quality_classifier"](spark, sf).collect()}
    assert len({y for _, y in labels}) == 2 and 0 < len(got) < len(rows)
    assert set(got) == {i for i, s in want.items() if s >= Q.THRESHOLD}
    assert max(abs(got[i] - want[i]) for i in got) < 1e-4


def test_names_with_dots(spark):
    d, lab = corpus(20)
    frame = spark.createDataFrame(d, "`doc.id` long, `a.text` string")
    labs = spark.createDataFrame(lab, "`doc.id` long, `the.label` int")
    assert Q.fit(frame, labs, "doc.id", "a.text", "the.label") is not None
