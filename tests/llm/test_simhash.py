from __future__ import annotations

import numpy as np
import pytest

from tracewarp.llm import simhash as S

SCHEMA = "key string, doc_id long, text string, f0 string, duplicate_of int"


def docs(spark, rows):
    return spark.createDataFrame([("x", i, t, "y", 3) for i, t in rows], SCHEMA)


def brute(rows):
    """Groups by comparing every pair of fingerprints."""
    rows = [(i, t) for i, t in rows if i is not None and t is not None]
    fp, ok = S.fingerprint_texts([t for _, t in rows])
    ids, fp = [i for (i, _), k in zip(rows, ok) if k], fp[ok]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in np.array(ids)[S.distances(fp, fp[k]) <= S.MAX_DISTANCE]:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return sorted((i, find(i)) for i in set(ids) if find(i) != i)


def got(df):
    return sorted((r.doc_id, r.duplicate_of) for r in df.collect())


def test_equals_brute_force_on_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(S.near_duplicates(df)) == brute(rows)


def test_pairs_at_every_distance_meet_in_one_bucket():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, (4000, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    y = x.copy()
    for i in range(len(x)):
        for bit in rng.choice(128, i % (S.MAX_DISTANCE + 1), replace=False):
            y[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    m = S.meeting_key(x, y)
    kx, ky = S.ball_keys(x), S.ball_keys(y)
    assert (kx == m[:, None]).any(1).all() and (ky == m[:, None]).any(1).all()


@pytest.mark.parametrize("most", [0, 5, 1000])
def test_forest_and_pairs_give_equal_groups(spark, monkeypatch, most):
    monkeypatch.setattr(S, "FOREST_FROM", most)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (6, 2), dtype=np.uint64)
    fp = np.repeat(base, 20, axis=0)
    for i in range(len(fp)):
        for bit in rng.choice(128, 5, replace=False):
            fp[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    keys, n = S.ball_keys(fp), len(fp)
    e = S.bucket_edges(keys.ravel(), np.repeat(np.arange(n), keys.shape[1]), np.repeat(fp, keys.shape[1], axis=0))
    assert (S.distances(fp[e[:, 0]], fp[e[:, 1]]) <= S.MAX_DISTANCE).all()
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(n)] == [i // 20 * 20 for i in range(n)]


def test_edge_cases(spark):
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    rows = [
        (5, "one two three four"), (3, "One, two; three four."), (None, "one two three four"), (7, None), (8, ""), (9, ""),
        (10, " \n "), (11, "!!! ."), (12, "!!! ."), (20, long), (21, long + " end"), (5, "one two three four"), (30, "of the"),
    ]
    assert got(S.near_duplicates(docs(spark, rows))) == [(5, 3), (21, 20)] == brute(rows)
    kept = S.keep_one(docs(spark, rows))
    assert kept.columns == ["key", "doc_id", "text", "f0", "duplicate_of"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("3 None 7 8 9 10 11 12 20 30".split())


def test_rows_that_repeat_an_id_link_the_groups_of_their_texts(spark):
    a, b = "alpha beta gamma delta", "red green blue yellow"
    assert got(S.near_duplicates(docs(spark, [(1, a), (2, a), (2, b), (3, b)]))) == [(2, 1), (3, 1)]


def test_empty_table(spark):
    assert got(S.near_duplicates(docs(spark, []))) == []
    assert S.keep_one(docs(spark, [])).count() == 0


@pytest.mark.parametrize("prefix", [1, 5, 10, 21])
def test_groups_give_all_keys_of_the_balls(prefix):
    fp = np.random.default_rng(4).integers(0, 2**63, (50, 2), dtype=np.uint64) * np.uint64(2)
    groups, found = S.group_numbers(fp, prefix), {i: set() for i in range(50)}
    for g in np.unique(groups):
        at = np.flatnonzero((groups == g).any(1))
        for row, key in zip(*S.group_keys(int(g), fp[at], prefix)):
            assert key not in found[at[row]]
            found[at[row]].add(key)
    assert all(found[i] == set(k) for i, k in enumerate(S.ball_keys(fp)))


def test_groups_stay_as_large_however_many_entries():
    for n in (0, 10**5, 10**7, 10**9):
        bits = S.prefix_bits(n)
        assert n * (1 + bits) / 2**bits <= S.GROUP_ROWS
    assert S.prefix_bits(5 * 10**10) == min(w for _, _, w in S.SEGMENTS)


@pytest.mark.parametrize("prefix", [1, 21])
def test_any_number_of_groups_gives_the_same(spark, monkeypatch, prefix):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    monkeypatch.setattr(S, "prefix_bits", lambda n: prefix)
    assert got(S.near_duplicates(df)) == want


def test_fingerprint_is_the_sign_of_the_weighted_sum_of_word_vectors():
    import math

    import xxhash

    text = "The cat, the dog; the END! cat"
    sums = [0.0] * 128
    for word, weight in (("the", 1 + math.log(3)), ("cat", 1 + math.log(2)), ("dog", 1.0), ("end", 1.0)):
        digest = int.from_bytes(xxhash.xxh3_128_digest(word), "big")
        for k in range(128):
            sums[k] += weight if digest >> (127 - k) & 1 else -weight
    bits = int("".join("1" if x > 0 else "0" for x in sums), 2)
    fp, ok = S.fingerprint_texts([text])
    assert ok[0] and [int(x) for x in fp[0]] == [bits >> 64, bits & (2**64 - 1)]


def test_large_buckets_of_few_near_pairs_are_compared_in_tiles(monkeypatch):
    """All equal in one segment: the pairs within the distance are those that comparing all finds, and no forest walks over the rest."""
    rng = np.random.default_rng(7)
    fp = rng.integers(0, 2**63, (3000, 2), dtype=np.uint64) * np.uint64(2)
    fp[:, 0] &= ~np.uint64((1 << 22) - 1)
    # Near pairs that differ by 0, 1 and 2 bits in the segment.
    for i, bits in enumerate([(), (3,), (3, 17), (0, 1), (21,)]):
        near = fp[i] ^ np.array([sum(1 << b for b in bits), 0b10110 << 30], np.uint64)
        fp[2000 + i] = near
    monkeypatch.setattr(S, "forest", None)
    keys, n = S.ball_keys(fp)[:, :23], len(fp)
    e = S.bucket_edges(keys.ravel(), np.repeat(np.arange(n), 23), np.repeat(fp, 23, axis=0))
    assert e.tolist() == [[i, 2000 + i] for i in range(5)]


def test_edges_are_thinned_to_a_forest(monkeypatch):
    rng = np.random.default_rng(8)
    edges = rng.integers(0, 300, (2000, 2))
    edges = edges[edges[:, 0] != edges[:, 1]]
    few = S.thinned(edges)
    assert len(few) == len(np.unique(edges)) - 1 and {tuple(x) for x in few} <= {tuple(x) for x in edges}
    # Of a group with more near pairs than it keeps: rows of one cluster, whatever the bound.
    monkeypatch.setattr(S, "EDGES", 50)
    monkeypatch.setattr(S, "FOREST_FROM", 10**9)
    fp = np.repeat(rng.integers(0, 2**63, (1, 2), dtype=np.uint64), 200, axis=0) ^ (np.uint64(1) << rng.integers(0, 60, (200, 2), dtype=np.uint64))
    keys = S.ball_keys(fp)
    e = S.bucket_edges(keys.ravel(), np.repeat(np.arange(200), keys.shape[1]), np.repeat(fp, keys.shape[1], axis=0))
    assert len(S.thinned(e)) == 199 and len(e) < 1000 and (S.distances(fp[e[:, 0]], fp[e[:, 1]]) <= S.MAX_DISTANCE).all()
