"""The pipeline against a brute-force version of all its stages."""

from __future__ import annotations

import hashlib
import inspect

import corpus_pipeline as P
import numpy as np
import pytest
import test_bpe
import test_linededup
import test_mixing
import test_simhash
import xxhash
from pyspark.sql import functions as F

from tracewarp.llm import mixing, quality

SF = "/root/testdata/sf0.01"


def train(spark, docs, labels):
    """The classifier, from features and labels on the driver."""
    ids = spark.createDataFrame([(i,) for i in labels], "i long").select("i", F.xxhash64("i").alias("h")).collect()
    chosen = {r.i for r in sorted(ids, key=lambda r: (r.h, r.i))[: quality.MAX_LABELLED]}
    rows = []
    for i, t in docs.items():
        if i in chosen:
            _, f, v = quality.features([t])
            rows.append((xxhash.xxh3_64_intdigest(str(i)), f.astype(np.int32).tobytes(), f, v.astype(np.float32).astype(float), labels[i]))
    return quality.train([r[2:] for r in sorted(rows, key=lambda r: r[:2])])


def coin(i):
    return int(hashlib.md5(f"{i}:{mixing.SEED}".encode()).hexdigest()[:13], 16) / 16**13


def test_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts, meta = {r.doc_id: r.text for r in table}, {r.doc_id: (r.source, r.lang) for r in table}
    w = train(spark, texts, {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()})
    score = quality.scores(list(texts.values()), w)
    kept = [(i, t) for (i, t), s in zip(texts.items(), score) if s >= quality.THRESHOLD]
    lined = test_linededup.brute(kept)[0]
    gone = {i for i, _ in test_simhash.brute(lined)}
    left = sorted((i, t) for i, t in lined if i not in gone)
    n = [len(t.split()) for _, t in left]
    keys = [(*meta[i], str(sum(c > b for b in mixing.BANDS)), c) for (i, _), c in zip(left, n)]
    shares = []
    for c, p in enumerate((mixing.TEMPER, mixing.TEMPER, 1.0)):
        s = {}
        for k in keys:
            s[k[c]] = s.get(k[c], 0) + k[-1] / sum(n)
        s = {v: x**p for v, x in s.items() if x}
        shares.append({v: x / sum(s.values()) for v, x in s.items()})
    copies = np.floor(test_mixing.raked(keys, shares, 300) + [coin(i) for i, _ in left] + 1e-12).astype(int)
    want = sorted((i, test_bpe.TIK.encode_ordinary(t), t) for (i, t), c in zip(left, copies) for _ in range(c))
    got = sorted((r.doc_id, r.ids, r.decoded) for r in P.run(spark, SF).collect())
    assert 0 < len(lined) < len(kept) < len(table) and gone
    assert got == want


def test_stages_name_the_operators_and_take_three_arguments():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in P.STAGES)


@pytest.mark.parametrize("stage", range(4))
def test_stages_bear_nulls_repeats_extra_columns_and_empty_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, __doc int, rate string, `a.b` int, _0 int"
    long = "mot " * 200_000
    rows = [
        (1, "That is a text of some words.\nAnd more.", "en", "a"), (1, "That is a text of some words.\nAnd more.", "en", "a"),
        (None, "It is another text, of other words.", None, None), (2, None, "fr", "b"), (3, "", "fr", "b"), (4, long, "fr", None), (5, "x", None, "a"),
    ]
    full = [(*r, len(r[1] or ""), "s", 1, "r", 2, 3) for r in rows]
    name, f = P.STAGES[stage]
    for data in (full, []):
        df = spark.createDataFrame(data, schema)
        out = f(spark, df, SF)
        assert out.columns == df.columns
        got = out.collect()
        assert bool(got) == bool(data)
        assert {r.score for r in got} <= {"s"} and {r.rate for r in got} <= {"r"}


def test_last_stage_bears_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, "", "en", "a"), (1, "a b", "en", "a"), (1, "a b", "en", "a")], "doc_id long, text string, lang string, source string")
    got = P.encode(spark, df, SF).collect()
    assert len(got) == 4 and sorted(str(r.decoded) for r in got) == ["", "None", "a b", "a b"]
    assert P.encode(spark, df.limit(0), SF).count() == 0
