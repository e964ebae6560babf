"""Approximate nearest neighbours by additive quantisation.

A vector is coded as one entry of each of ``BOOKS`` full-dimensional codebooks, whose sum approximates it. Codebook m
is the k-means of what codebooks before m leave over of a bounded sample of the vectors. Every vector is encoded, by a
beam search over the books. A query scores a code by adding looked-up products of the query with the chosen
entries, and the stored norm of the sum. The ``RERANK`` best codes of each shard are compared exactly, which gives a
score that the k-th nearest has at least; then every code that can still reach it is compared exactly, as the stored
length of the vector's quantisation error bounds its score. Where that rules out too little of a shard for its first
queries, the others are compared with all of it. The lists of the shards are merged in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarp.llm.common import map_arrow, written
from tracewarp.llm.topk import BLOCK, DENSE, best, matrix, merged, pairs, product, shards, unit, vectors

BOOKS, ENTRIES, BEAM = 8, 256, 8
#: Vectors that the books are fitted to, about: all, or as many picked by a hash of the id, and fewer where they would
#: have more bytes. Every vector is coded.
SAMPLE, SAMPLE_BYTES = 16384, 2**26
#: Steps of Lloyd's a book.
LLOYD_STEPS = 4
#: Codes of each shard that are compared exactly at first, per query.
RERANK = 128
#: What single precision and the rounding of scores may take from a bound.
SLACK = 1e-5
#: Queries that try a shard's codes before the others.
TRIAL = 64


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmax(2 * (x @ book.T) - (book * book).sum(1), axis=1)


def _step(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The means of the rows nearest to each entry; an entry that no row is nearest to stays as it was."""
    total = np.zeros((len(book), x.shape[1] + 1))
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        code = _nearest(part, book)
        order = np.argsort(code, kind="stable")
        some, first = np.unique(code[order], return_index=True)
        total[some, :-1] += np.add.reduceat(part[order].astype(np.float64), first, axis=0)
        total[:, -1] += np.bincount(code, minlength=len(book))
    return np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), book).astype(np.float32)


def fit(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, steps: int = LLOYD_STEPS) -> np.ndarray:
    """(books, entries, dim) codebooks of the rows; the entries of each start at what the books before leave of some of the rows."""
    left, out = x.astype(np.float32), np.zeros((books, entries, x.shape[1]), np.float32)
    start = np.random.default_rng(0).permutation(len(x))[:entries]
    for book in out:
        book[: len(start)] = left[start]
        for _ in range(steps):
            book[:] = _step(left, book)
        for at in range(0, len(left), 4096):
            left[at : at + 4096] -= book[_nearest(left[at : at + 4096], book)]
    return out


def train(vecs: DataFrame, dim: int) -> np.ndarray:
    """Codebooks of the unit vectors of (id, v), fitted in one task to those that a hash of the id picks."""
    most = max(ENTRIES, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    rows = vecs.count()
    some = vecs.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rows)) < most) if rows > most else vecs

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in it if b.num_rows]
        ids = np.concatenate([b.column(0).to_numpy() for b in found])
        x = unit(np.concatenate([matrix(b.column(1), dim) for b in found]))[np.argsort(ids)]
        yield pa.RecordBatch.from_pydict({"books": pa.array([fit(x).tobytes()], pa.binary())})

    got = map_arrow(some.select("id", "v").repartition(1), run, "books binary").collect()
    return np.frombuffer(bytes(got[0].books), np.float32).reshape(BOOKS, ENTRIES, dim)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(n, books) codes of the rows, and the squared norms of their sums, by a search that keeps the ``beam`` best prefixes."""
    m, k, dim = books.shape
    lengths = (books * books).sum(2)
    codes, norms = np.zeros((len(x), m), np.uint8 if k <= 256 else np.uint16), np.zeros(len(x), np.float32)
    for at in range(0, len(x), 256):
        v = x[at : at + 256].astype(np.float32)
        left, chosen = v[:, None, :], np.zeros((len(v), 1, 0), np.int64)
        error = (v * v).sum(1)[:, None]
        for book, length in zip(books, lengths):
            e = left.reshape(-1, dim) @ (-2 * book.T)
            e += length
            e += error.reshape(-1, 1)
            flat = e.reshape(len(v), -1)
            w = min(beam, flat.shape[1])
            pick = np.argpartition(flat, w - 1, axis=1)[:, :w]
            rows = np.arange(len(v))[:, None]
            was, entry = pick // k, pick % k
            chosen = np.concatenate([chosen[rows, was], entry[:, :, None]], axis=2)
            left, error = left[rows, was] - book[entry], flat[rows, pick]
        one = np.argmin(error, axis=1)
        codes[at : at + 256] = chosen[np.arange(len(v)), one]
        total = v - left[np.arange(len(v)), one]
        norms[at : at + 256] = (total * total).sum(1)
    return codes, norms


def errors(u: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Lengths of what the codes leave over of the rows."""
    left = u.copy()
    for m, book in enumerate(books):
        left -= book[codes[:, m]]
    return np.sqrt((left * left).sum(1)).astype(np.float32)


def reachable(approx: np.ndarray, norms: np.ndarray, error: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which codes' vectors can have a score of ``least`` (queries,) or more, by ``approx`` (queries, codes).

    A unit query q and a vector x of code c have q.x <= q.c + |x - c|, and |q - x| >= |q - c| - |x - c|; approx is
    2 q.c - |c|^2 = 1 - |q - c|^2.
    """
    far = np.sqrt(np.maximum(2 - 2 * least, 0) + SLACK).astype(np.float32)[:, None] + error
    low = 2 * (least[:, None].astype(np.float32) - error) - norms
    return (approx >= np.maximum(1 - far * far, low) - SLACK) & (approx > -np.inf)


def neighbours(df: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = RERANK, every: int = 1) -> DataFrame:
    """(query_id, rank, neighbour_id, score): for every vector its k nearest others by cosine, best first.

    Queries are the vectors whose id is divisible by ``every``; each is compared with all vectors. Codes only rule out what can't be among the nearest, so the result is that of
    :func:`tracewarp.llm.topk.top_k`, also in what rows take part, ties, repeated rows, small and empty tables.
    """
    found, dim = vectors(df, id_col, vec_col)
    vecs = written(found, "vectors")
    books = train(vecs, dim) if dim else np.zeros((BOOKS, ENTRIES, 0), np.float32)

    def pack(ids: np.ndarray, v: np.ndarray) -> dict[str, bytes]:
        u = unit(v)
        codes, norms = encode(u, books)
        return {"v": u.tobytes(), "codes": codes.tobytes(), "norms": norms.tobytes(), "errors": errors(u, codes, books).tobytes()}

    packed, n = shards(vecs, dim, pack, "v binary, codes binary, norms binary, errors binary")
    asked = shards(vecs.where(F.col("id") % every == 0), dim, lambda i, v: {"v": unit(v).tobytes()}, "v binary")

    def search(x: dict, y: dict):
        qi, si = np.frombuffer(x["ids"], np.int64), np.frombuffer(y["ids"], np.int64)
        q, s = (np.frombuffer(z["v"], np.float64).reshape(-1, dim) for z in (x, y))
        codes = np.ascontiguousarray(np.frombuffer(y["codes"], np.uint8).reshape(-1, BOOKS).T)
        norms, error = (np.frombuffer(y[c], np.float32) for c in ("norms", "errors"))
        decide = True
        for at in [0, *range(TRIAL, len(qi), BLOCK)]:
            to = at + BLOCK if at else TRIAL
            part, asking = q[at:to], qi[at:to]
            # A query is no neighbour of itself; the ids of a shard are sorted.
            place = np.minimum(np.searchsorted(si, asking), len(si) - 1)
            here = np.flatnonzero(si[place] == asking)
            own = here, place[here]
            if not decide:
                yield asking, *product(part, s, si, own, k)
                continue
            table = 2 * np.einsum("qd,mkd->mqk", part.astype(np.float32), books, optimize=True)
            approx = np.repeat(-norms[None, :], len(part), axis=0)
            for m in range(BOOKS):
                approx += np.take(table[m], codes[m], axis=1)
            approx[own] = -np.inf
            r = min(rerank, len(si))
            cand = np.argpartition(approx, len(si) - r, axis=1)[:, len(si) - r :]
            exact = np.einsum("qd,qrd->qr", part, s[cand])
            exact[np.take_along_axis(approx, cand, 1) == -np.inf] = -np.inf
            if r < len(si):
                least = np.partition(exact, r - k, axis=1)[:, r - k] if r >= k else np.full(len(part), -1.0)
                open_ = reachable(approx, norms, error, np.maximum(least, -1.0))
                most = int(open_.sum(1).max())
                if most > DENSE * len(si):
                    decide = False
                    yield asking, *product(part, s, si, own, k)
                    continue
                # Those that can reach the score, the first of each row, filled up with others.
                cand = np.argpartition(~open_, most - 1, axis=1)[:, :most] if most else cand
                exact = np.einsum("qd,qrd->qr", part, s[cand])
                exact[~np.take_along_axis(open_, cand, 1)] = -np.inf
            yield asking, *best(si[cand], exact, k)

    return merged(pairs(packed, n, k, search, asked), n, k)
