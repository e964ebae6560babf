from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewarp.llm.cuckoo import Cuckoo, CuckooFull
from tracewarp.llm import linededup
from tracewarp.llm.linededup import LineIndex, deduped, deduped_in_batches

SCHEMA = "h1 int, doc_id long, text string, __doc string, pos int, `__gone.x` string"


def docs(spark, rows):
    return spark.createDataFrame([(1, i, t, "d", 2, "k") for i, t in rows], SCHEMA)


def out(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def brute(rows, seen=()):
    """The same by a loop over documents in order of id (distinct ids)."""
    seen, result = set(seen), []
    for i, t in sorted(rows):
        lines = t.split("\n")
        kept = []
        for x in lines:
            k = x.strip(" ")
            if not k or k not in seen:
                kept.append(x)
            if k:
                seen.add(k)
        if any(x.strip(" ") for x in kept) or not any(x.strip(" ") for x in lines):
            result.append((i, "\n".join(kept)))
    return sorted(result, key=repr), seen


def state(index):
    refs = sorted((r.h1, r.h2, r.doc) for r in index.refs().collect())
    counts = sorted((r.h1, r.h2, r["count"]) for r in index.counts().collect())
    return refs, counts, sum(len(Cuckoo.load(bytes(r["filter"]))) for r in index.filters().collect())


def test_cuckoo_insert_find_delete():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 100_000))
    f = Cuckoo.sized(len(a))
    f.insert(a, b)
    assert f.contains(a, b).all() and len(f) == len(a)
    x, y = rng.integers(-(2**63), 2**63 - 1, (2, 100_000))
    assert f.contains(x, y).mean() < 0.001
    g = Cuckoo.load(f.dump())
    g.delete(a[:60_000], b[:60_000])
    assert g.contains(a[60_000:], b[60_000:]).all() and len(g) == 40_000
    assert g.contains(a[:60_000], b[:60_000]).mean() < 0.001


def test_cuckoo_keys_that_look_alike_and_full():
    same = np.full(6, 5, np.int64), (np.int64(9) << 48) + np.arange(6)
    f = Cuckoo(np.zeros((64, 4), np.uint16))
    f.insert(*same)
    f.delete(same[0][:4], same[1][:4])
    assert len(f) == 2
    with pytest.raises(CuckooFull):
        Cuckoo(np.zeros((1, 4), np.uint16)).insert(np.arange(9), np.arange(9) << 48)


@given(st.lists(st.tuples(st.integers(-(2**62), 2**62), st.integers(-(2**62), 2**62)), unique=True, max_size=200), st.integers(0, 200))
@settings(max_examples=60, deadline=None)
def test_cuckoo_deletes_are_exact(keys, cut):
    a = np.array([k[0] for k in keys], np.int64)
    b = np.array([k[1] for k in keys], np.int64)
    f = Cuckoo.sized(max(8, len(keys)))
    f.insert(a, b)
    f.delete(a[:cut], b[:cut])
    assert len(f) == max(0, len(keys) - cut) and f.contains(a[cut:], b[cut:]).all()


def test_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert out(deduped(df)) == brute(rows)[0]


def test_batches_and_deletion_are_reversible(spark):
    a = [(1, "x\ny\nz"), (2, "y\n\nw"), (3, "x\ny")]
    b = [(10, "w\nnew"), (11, "z\n x "), (12, "new\nnewer")]
    index = LineIndex(spark)
    got, seen = brute(a)
    assert out(index.insert(docs(spark, a))) == got == [(1, "x\ny\nz"), (2, "\nw")]
    before = state(index)
    assert out(index.insert(docs(spark, b))) == brute(b, seen)[0] == [(10, "new"), (12, "newer")]
    assert state(index)[2] == 6
    index.delete(spark.createDataFrame([(10,), (11,), (12,), (99,), (None,)], "doc_id long"))
    assert state(index) == before
    index.delete(spark.createDataFrame([(1,), (3,)], "doc_id long"))
    again = LineIndex(spark, index.path)
    assert out(again.insert(docs(spark, [(20, "x\ny\nw")]))) == [(20, "x")]


def test_a_line_passes_to_its_next_holder(spark):
    index = LineIndex(spark)
    a, b, c = [(1, "L\nx")], [(2, "y\n L"), (4, "L\ny")], [(3, "L\nz")]
    index.insert(docs(spark, a))
    assert out(index.insert(docs(spark, b))) == [(2, "y")]
    assert out(index.insert(docs(spark, c))) == [(3, "z")]
    place = lambda df: sorted((r.doc_id, r.pos) for r in df.collect())
    assert place(index.delete(spark.createDataFrame([(4,)], "doc_id long"))) == []
    assert place(index.delete(spark.createDataFrame([(1,)], "doc_id long"))) == [(2, 1)]
    assert out(index.texts(docs(spark, b[:1] + c))) == [(2, "y\n L"), (3, "z")]
    assert out(index.insert(docs(spark, [(5, "L\nq")]))) == [(5, "q")]
    assert place(index.delete(spark.createDataFrame([(2,)], "doc_id long"))) == [(3, 0)]
    assert out(index.texts(docs(spark, c + [(5, "L\nq")]))) == [(3, "L\nz"), (5, "q")]


def test_filters_grow_with_the_index(spark):
    index = LineIndex(spark)
    first, second = ([(i, f"{w}{i}") for i in range(n)] for w, n in (("a", 300), ("b", 3000)))
    index.insert(docs(spark, first))
    assert len(out(index.insert(docs(spark, second)))) == 3000
    assert state(index)[2] == 3300
    assert out(index.insert(docs(spark, [(9999, "a7\nb2999\nc")]))) == [(9999, "c")]


def test_edge_cases(spark):
    long = "\n".join(f"l{i}" for i in range(100_000))
    rows = [
        (1, "a\na\n\nb"), (1, "a\na\n\nb"), (2, None), (3, ""), (4, "\n \n"), (5, " a "), (None, "a\nq"), (None, None),
        (6, long), (7, long + "\nend"), (8, "b\nc"), (8, "c\nd"),
    ]
    df = deduped(docs(spark, rows))
    assert df.columns == ["h1", "doc_id", "text", "__doc", "pos", "__gone.x"]
    got = out(df)
    assert [t for i, t in got if i == 1] == ["a\n\nb"] * 2 and (5, " a ") not in got
    assert {(2, None), (3, ""), (4, "\n \n"), (None, "q"), (None, None), (6, long), (7, "end")} <= set(got)
    assert sorted("\n".join(t for i, t in got if i == 8).split("\n")) == ["c", "d"]


def test_empty_table(spark):
    index = LineIndex(spark)
    assert out(index.insert(docs(spark, []))) == []
    index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert state(index) == ([], [], 0)


def rows_in(spark, index, what):
    return {v: spark.read.parquet(f"{index.path}/{what}/{v}").count() for v in index.parts[what]}


def test_a_change_costs_what_its_batch_has(spark):
    index = LineIndex(spark)
    index.insert(docs(spark, [(i, f"a{i}\nb{i}") for i in range(2000)]))
    index.insert(docs(spark, [(5000, "a7\nnew")]))
    assert index.parts["refs"] == [1, 2] and rows_in(spark, index, "refs") == {1: 4000, 2: 2} and rows_in(spark, index, "lines") == {1: 4000, 2: 2}
    assert rows_in(spark, index, "filters") == {1: linededup.LEAST_SHARDS, 2: 1}
    restored = index.delete(spark.createDataFrame([(7,)], "doc_id long"))
    assert [(r.doc_id, r.pos) for r in restored.collect()] == [(5000, 0)]
    assert rows_in(spark, index, "gone") == {3: 1} and index.parts["refs"] == [1, 2] and rows_in(spark, index, "filters")[3] == 1
    scan = index._some(index._read("refs", index.REFS), "shard", spark.createDataFrame([(3,)], "shard int"))
    assert "PushedFilters: [In(shard" in scan._jdf.queryExecution().toString() or "EqualTo(shard,3)" in scan._jdf.queryExecution().toString()


def test_compaction_leaves_the_index_as_it_was(spark, monkeypatch):
    index = LineIndex(spark)
    index.insert(docs(spark, [(i, f"a{i}\nb{i % 7}") for i in range(300)]))
    index.delete(spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long"))
    before = state(index)
    index.compact()
    assert state(index) == before and index.parts["gone"] == []
    monkeypatch.setattr(linededup, "SHARD_LINES", 8)
    index.compact()
    assert state(index) == before and index.parts["shards"] == 32 and index.filters().count() == 32
    again = LineIndex(spark, index.path)
    assert again.parts == index.parts
    assert out(again.insert(docs(spark, [(900, "a1\na3\nb2\nc")]))) == [(900, "a3\nc")]
    monkeypatch.setattr(linededup, "COMPACT_AT", 1)
    got = again.insert(docs(spark, [(901, "c\nd")]))
    assert len(again.parts["refs"]) == 1 and out(got) == [(901, "d")]


def test_a_deleted_document_may_come_again(spark):
    index, one = LineIndex(spark), spark.createDataFrame([(1,)], "doc_id long")
    index.insert(docs(spark, [(1, "x\ny"), (2, "y\nz")]))
    index.delete(one)
    assert out(index.insert(docs(spark, [(1, "x\ny\nz")]))) == [(1, "x")]
    index.delete(one)
    assert sorted(r["count"] for r in index.counts().collect()) == [1, 1]


def test_batches_give_what_one_gives(spark):
    rows = [(i * 3, f"l{i % 11}\nm{i % 5}\nn{i}") for i in range(64)] + [(None, "l3\nq"), (4, None), (190, "")]
    assert out(deduped_in_batches(docs(spark, rows))) == out(deduped(docs(spark, rows)))
    assert out(deduped_in_batches(docs(spark, []))) == [] and out(deduped_in_batches(docs(spark, [(None, "a\na")]))) == [(None, "a")]
    assert out(deduped_in_batches(docs(spark, [(1, "a\na")]))) == [(1, "a")]
