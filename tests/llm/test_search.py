from __future__ import annotations

import numpy as np
import pytest

from tracewarp.llm import additive as A
from tracewarp.llm import topk as T

SCHEMA = "s string, vec_id long, embedding array<float>, ids int, v string"


def frame(spark, rows):
    return spark.createDataFrame([("s", i, v, 1, "v") for i, v in rows], SCHEMA)


def brute(rows, k):
    rows = sorted(rows)
    u = T.unit(np.array([v for _, v in rows], np.float32))
    ids, out = np.array([i for i, _ in rows]), []
    s = np.round(u @ u.T, 9)
    for a in range(len(rows)):
        order = [b for b in np.lexsort((ids, -s[a])) if b != a][:k]
        out += [(int(ids[a]), r + 1, int(ids[b]), float(s[a, b])) for r, b in enumerate(order)]
    return out


def got(df):
    return sorted((r.query_id, r["rank"], r.neighbour_id, r.score) for r in df.collect())


def same(a, b):
    return [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b])


def random_rows(n, dim=12, seed=0):
    return list(enumerate(np.random.default_rng(seed).normal(size=(n, dim)).round(3).tolist()))


@pytest.mark.parametrize("shard", [8192, 50])
def test_exact_equals_brute_force_over_many_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(T, "SHARD", shard)
    monkeypatch.setattr(T, "FAN", 3)
    monkeypatch.setattr(T, "BLOCK", 17)
    rows = random_rows(500)
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties beyond k
    assert same(got(T.top_k(frame(spark, rows), k=5)), brute(rows, 5))


def test_best_with_ties_and_few():
    ids, s = np.array([5, 3, 9, 1]), np.array([[1.0, 1.0, 1.0, 1.0], [0.5, -np.inf, 0.7, -np.inf]])
    i, v = T.best(ids, s, 3)
    assert i.tolist() == [[1, 3, 5], [9, 5, -1]] and v[1, 2] == -np.inf


def test_recall_of_additive_quantisation(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want, have = {}, {}
    for out, d in ((want, T.top_k(df)), (have, A.neighbours(df))):
        for q, _, i, _ in got(d):
            out.setdefault(q, set()).add(i)
    assert want.keys() == have.keys()
    assert np.mean([len(want[q] & have[q]) / len(want[q]) for q in want]) >= 0.95


def test_queries_divisible_by_fifty_against_all_rows(spark):
    """The registered query: every 50th vector and no other asks, all rows answer, and nothing of the brute-force lists is lost."""
    from tracewarp.llm.queries import QUERIES

    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = [x for x in brute([(r.vec_id, list(r.embedding)) for r in df.collect()], 10) if x[0] % 50 == 0]
    have = got(QUERIES["op5_additive_quantisation"](spark, "/root/testdata/sf0.1"))
    assert len(want) == 400 and any(x[2] % 50 for x in want) and same(have, want)


def test_queries_over_several_shards_negative_ids_and_none(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD", 60)
    monkeypatch.setattr(A, "BLOCK", 7)
    rows = [(i - 100, v) for i, v in random_rows(300)] + [(1000, random_rows(1)[0][1])]
    assert same(got(A.neighbours(frame(spark, rows), k=5, every=4)), [x for x in brute(rows, 5) if x[0] % 4 == 0])
    assert got(A.neighbours(frame(spark, [(i, v) for i, v in rows if i % 50]), k=5, every=50)) == []


@pytest.mark.parametrize("sample", [100, 16384])
def test_books_are_fitted_to_a_bounded_sample_and_every_row_is_coded(spark, monkeypatch, sample):
    monkeypatch.setattr(A, "SAMPLE", sample)
    monkeypatch.setattr(A, "ENTRIES", 16)
    rows = random_rows(3000)
    vecs, dim = T.vectors(frame(spark, rows))
    seen = spark.sparkContext.accumulator(0)
    fit = A.fit

    def counted(x):
        seen.add(len(x))
        return fit(x, entries=16)

    monkeypatch.setattr(A, "fit", counted)
    books = A.train(vecs, dim)
    assert books.shape == (A.BOOKS, 16, dim)
    assert seen.value == 3000 if sample > 3000 else 50 < seen.value < 150  # in one pass
    assert (books == A.train(vecs.repartition(7), dim)).all()
    u = T.unit(np.array([v for _, v in rows]))
    assert A.errors(u, A.encode(u, books)[0], books).mean() < 0.5


def test_books_take_in_few_and_equal_vectors():
    for x in (np.eye(3), np.ones((50, 3)) / 3**0.5):
        books = A.fit(x)
        assert books.shape == (A.BOOKS, A.ENTRIES, 3) and A.errors(x, A.encode(x, books)[0], books).max() < 1e-5


@pytest.mark.parametrize("n", [3, 30, 500, 3000])
def test_products_equal_double_precision(n):
    """Scores that single precision can't tell apart, copies, and places that aren't asked for."""
    rng = np.random.default_rng(n)
    s = rng.normal(size=(n, 24))
    s[: n // 2 : 7] = s[0] + rng.normal(size=(len(s[: n // 2 : 7]), 24)) * 1e-7
    s[n // 2 :: 97] = s[n // 2]
    s = T.unit(s)
    q = np.concatenate([s[:20], T.unit(rng.normal(size=(20, 24)))])
    ids = np.sort(rng.permutation(10 * n)[:n])
    own = np.arange(min(n, 20)), np.arange(min(n, 20))
    want = q @ s.T
    want[own] = -np.inf
    i, v = T.best(ids, want, 10)
    j, w = A.product(q, s, ids, own, 10)
    assert (i == j).all() and np.allclose(v, w, rtol=0, atol=1.1e-9)


def test_products_of_many_dimensions_copy_few_rows_at_once():
    """Copies enough that 10,000 pairs of 4,096 dimensions are computed in double: at once their rows would be 330 MB a side."""
    import tracemalloc

    rng = np.random.default_rng(5)
    s = T.unit(rng.normal(size=(2000, 4096)))
    q = T.unit(rng.normal(size=(512, 4096)))
    s[:30] = q[0]
    q[1:300] = q[0]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    tracemalloc.start()
    i, v = A.product(q, s, np.arange(2000), none, 10)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    j, w = T.best(np.arange(2000), q @ s.T, 10)
    assert (i == j).all() and np.allclose(v, w, rtol=0, atol=1.1e-9) and most < 250


def test_shards_whose_codes_rule_out_little_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(A, "TRIAL", 5)
    monkeypatch.setattr(A, "BLOCK", 50)
    rows = random_rows(4000, dim=64) + [(5000 + i, v) for i, v in random_rows(300, dim=64)]
    assert same(got(A.neighbours(frame(spark, rows), every=3)), [x for x in brute(rows, 10) if x[0] % 3 == 0])


@pytest.mark.parametrize("dense", [A.DENSE, 2.0])
def test_full_shards_and_groups_of_copies_lose_nothing(spark, monkeypatch, dense):
    """A shard of 8,000, with 400 near copies and 300 exact ones, and so more than are compared at first."""
    monkeypatch.setattr(A, "DENSE", dense)
    rng = np.random.default_rng(7)
    n = 8000 if dense < 1 else 2000
    v = rng.normal(size=(n, 64))
    v[100:500] = v[100] + rng.normal(size=(400, 64)) * 0.01
    v[500:800] = v[500]
    rows = list(enumerate(v.tolist()))
    df = frame(spark, rows).cache()
    assert same(got(A.neighbours(df)), got(T.top_k(df)))


def test_bound_holds():
    rng = np.random.default_rng(1)
    u, books = T.unit(rng.normal(size=(500, 8))), rng.normal(size=(2, 16, 8)).astype(np.float32) * 0.5
    codes, norms = A.encode(u, books)
    total = sum(books[m][codes[:, m]] for m in range(2))
    score = u @ u.T
    least = np.sort(score, axis=1)[:, -20]
    open_ = A.reachable((2 * u @ total.T - norms).astype(np.float32), norms, A.errors(u, codes, books), least)
    assert open_[score >= least[:, None]].all() and not open_.all()


def test_beam_is_no_worse_than_greedy_and_norms_fit():
    rng = np.random.default_rng(3)
    x, books = rng.normal(size=(300, 8)), rng.normal(size=(4, 16, 8)).astype(np.float32)
    error = {}
    for beam in (1, 8):
        codes, norms = A.encode(x, books, beam)
        total = sum(books[m][codes[:, m]] for m in range(4))
        assert np.allclose((total**2).sum(1), norms, rtol=1e-4)
        error[beam] = ((x - total) ** 2).sum(1)
    assert error[8].mean() < error[1].mean()


@pytest.mark.parametrize("f", [T.top_k, A.neighbours])
def test_edge_cases(spark, f):
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, []), (6, [None, 1.0]),
        (7, [float("nan"), 1.0]), (8, [0.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (-10, [-1e30, 1e30]), (11, [float("inf"), 0.0]),
    ]
    clean = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (-10, [-1e30, 1e30])]
    assert same(got(f(frame(spark, rows), k=10)), brute(clean, 10))
    assert got(f(frame(spark, []))) == [] == got(f(frame(spark, [(1, [1.0, 2.0])])))


def test_doubles_beyond_single_precision(spark):
    rows = [(1, [1e39, 1e39]), (2, [1e300, 0.9e300]), (3, [-1.0, 1.0]), (4, [1.0, 1.0 + 1e-9]), (5, [1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = got(T.top_k(df, k=4))
    u = {i: np.array(v) / max(map(abs, v)) for i, v in rows}
    for q, _, n, score in found:
        assert score == pytest.approx(u[q] @ u[n] / np.sqrt((u[q] @ u[q]) * (u[n] @ u[n])), abs=1e-9)
    assert len(found) == 20 and found[0][:3] == (1, 1, 4)


def test_tiles_score_few_pairs_in_double_precision(monkeypatch):
    rows = random_rows(3000, dim=16, seed=5)
    ids, u = np.arange(3000), T.unit(np.array([v for _, v in rows]))
    packed = {"s": 0, "ids": ids.tobytes(), "v": u.tobytes()}
    best, widths = T.best, []
    monkeypatch.setattr(T, "best", lambda i, s, k: widths.append(s.shape[1]) or best(i, s, k))
    out = [(int(q), r + 1, int(i), float(s)) for a, b, c in T.tile(packed, packed, 16, 10) for q, i_, s_ in zip(a, b, c) for r, (i, s) in enumerate(zip(i_, s_))]
    assert same(sorted(out), brute(rows, 10)) and max(widths) < 300
