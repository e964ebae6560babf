"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of the per-query lists.

Vectors are packed into shards of at most ``SHARD`` rows, written once. Every pair of shards is one row of work: the
cosines of one shard's vectors with the other's, of which each query keeps the best k: in single precision, and in
double for the pairs that its bounded error leaves among the best. The lists of a query from
different shards are merged in a tree, ``FAN`` at a time, so no task ever holds more than ``FAN`` lists a query.
Scores are compared at nine decimals, ties by id, which makes the result independent of how rows are spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarp.llm.common import map_arrow, quoted, written

SHARD = 8192
#: Queries of a product at a time: bounds its memory to BLOCK x SHARD scores.
BLOCK = 512
FAN = 8
DECIMALS = 9
#: Share of a tile's pairs from which on the exact scores of all are computed as one product.
DENSE = 0.02
LISTS = "q int, s int, query binary, id binary, score binary"


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, v) of the rows that can be compared, and their dimension.

    Left out are null ids, null or empty vectors, ones with a null, NaN or infinite element, zero vectors, and vectors
    of another length than the most frequent one (of equally frequent ones the longest). Of rows that share an id the
    smallest vector counts.
    """
    src = df.select(quoted(id_col).cast("long").alias("id"), quoted(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    src = src.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    lengths = src.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = lengths["n"] if lengths else 0
    return src.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")), dim


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; the scaling first brings the largest element to 1."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def shards(vecs: DataFrame, dim: int, pack: Callable[[np.ndarray, np.ndarray], dict[str, bytes]], fields: str) -> tuple[DataFrame, int]:
    """The vectors as rows (s, ids, ...) of at most about ``SHARD`` each, spread by a hash of the id, and their number.

    ``pack(ids, vectors)`` gives the further binary fields, named in ``fields``.
    """
    spark = vecs.sparkSession
    n = max(1, -(-vecs.count() // SHARD))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in it if b.num_rows]
        if not found:
            return
        t = pa.Table.from_batches(found).combine_chunks()
        at, ids, v = t["s"].to_numpy(), t["id"].to_numpy(), matrix(t["v"].combine_chunks(), dim)
        for s in np.unique(at):
            rows = np.flatnonzero(at == s)
            rows = rows[np.argsort(ids[rows])]
            packed = {"s": int(s), "ids": ids[rows].astype(np.int64).tobytes(), **pack(ids[rows], v[rows])}
            yield pa.RecordBatch.from_pydict({k: pa.array([x], pa.int32() if k == "s" else pa.binary()) for k, x in packed.items()})

    placed = vecs.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("s"), "id", "v").repartition(n, "s")
    return written(map_arrow(placed, run, f"s int, ids binary, {fields}"), "shards"), n


def best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its k largest scores (at ``DECIMALS``, ties by id), largest first; ids are (columns,) or like score.

    Scores of -inf are no candidates; rows with fewer than k are filled with id -1 and -inf.
    """
    q, n = score.shape
    out_i, out_s = np.full((q, k), -1, np.int64), np.full((q, k), -np.inf)
    if not n:
        return out_i, out_s
    # All that may round to the k-th largest score or more; ties may make them more than k.
    kth = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(q, -np.inf)
    row, col = np.nonzero((score >= kth[:, None] - 2.0 * 10.0**-DECIMALS) & (score > -np.inf))
    s = np.round(score[row, col], DECIMALS)
    i = ids[col] if ids.ndim == 1 else ids[row, col]
    order = np.lexsort((i, -s, row))
    row, s, i = row[order], s[order], i[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    out_i[row[keep], rank[keep]], out_s[row[keep], rank[keep]] = i[keep], s[keep]
    return out_i, out_s


def product(q: np.ndarray, s: np.ndarray, ids: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists :func:`best` gives of all scores of unit vectors but those of the places ``own``.

    Single precision, whose error is bounded, leaves few pairs to be computed in double.
    """
    score = q.astype(np.float32) @ s.astype(np.float32).T
    score[own] = -np.inf
    # A score that k of each row have at least: the k-th of the maxima of groups of columns.
    wide, most = 16 * k, score
    if len(s) >= 2 * wide:
        most = score[:, :wide].copy()
        for at in range(wide, len(s) - wide + 1, wide):
            np.maximum(most, score[:, at : at + wide], out=most)
    least = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k] if most.shape[1] > k else np.full(len(q), -np.inf, np.float32)
    near = 2 * (q.shape[1] + 8) * 2.0**-24 + 2 * 10.0**-DECIMALS
    flat = np.flatnonzero(score >= (least - np.float32(near))[:, None])
    if len(flat) > DENSE * score.size:
        exact = q @ s.T
        exact[own] = -np.inf
        return best(ids, exact, k)
    row, col = np.divmod(flat, len(s))
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    cand, exact = np.zeros((len(q), rank.max(initial=-1) + 1), np.int64), np.full((len(q), rank.max(initial=-1) + 1), -np.inf)
    cand[row, rank] = col
    step = max(1, 2**22 // q.shape[1])  # bounds the copied rows to 32 MB a side
    for at in range(0, len(row), step):
        r, c = row[at : at + step], col[at : at + step]
        exact[r, rank[at : at + step]] = np.where(score[r, c] > -np.inf, np.einsum("nd,nd->n", q[r], s[c]), -np.inf)
    return best(ids[cand], exact, k)


def pairs(
    packed: DataFrame, n: int, k: int, search: Callable[[dict, dict], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], asked: tuple[DataFrame, int] | None = None
) -> DataFrame:
    """Lists (q, s, query, id, score) of all pairs of shards: ``search(queries, shard)`` yields blocks of (ids, best ids, scores).

    ``asked`` are the shards of the queries and their number, if these aren't all vectors.
    """
    queries, n_queries = asked or (packed, n)
    left = queries.select(F.col("s").alias("q"), F.struct("*").alias("a")).repartition(n_queries, "q")
    right = packed.select("s", F.struct("*").alias("b")).repartition(n, "s")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                x, y = b.column(1)[r].as_py(), b.column(3)[r].as_py()
                got = list(search(x, y))
                row = {"query": np.concatenate([g[0] for g in got]), "id": np.concatenate([g[1] for g in got]), "score": np.concatenate([g[2] for g in got])}
                yield pa.RecordBatch.from_pydict(
                    {"q": pa.array([x["s"]], pa.int32()), "s": pa.array([y["s"]], pa.int32())} | {c: pa.array([v.tobytes()], pa.binary()) for c, v in row.items()}
                )

    return map_arrow(left.crossJoin(right), run, LISTS)


def merged(lists: DataFrame, n: int, k: int) -> DataFrame:
    """(query_id, rank, neighbour_id, score) of lists from ``n`` shards, merged ``FAN`` at a time."""

    def merge(t: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, k) for x in t["id"].to_pylist()], axis=1)
        score = np.concatenate([np.frombuffer(x, np.float64).reshape(-1, k) for x in t["score"].to_pylist()], axis=1)
        i, s = best(ids, score, k)
        one = {"q": pa.array([t["q"][0].as_py()], pa.int32()), "s": pa.array([t["s"][0].as_py()], pa.int32()), "query": pa.array([t["query"][0].as_py()], pa.binary())}
        return pa.table(one | {"id": pa.array([i.tobytes()], pa.binary()), "score": pa.array([s.tobytes()], pa.binary())})

    while n > 1:
        lists = lists.withColumn("s", F.floor(F.col("s") / FAN).cast("int")).groupBy("q", "s").applyInArrow(merge, LISTS)
        n = -(-n // FAN)

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                query = np.frombuffer(b.column(2)[r].as_py(), np.int64)
                ids, score = (np.frombuffer(b.column(c)[r].as_py(), t).reshape(-1, k) for c, t in ((3, np.int64), (4, np.float64)))
                row, rank = np.nonzero(np.isfinite(score))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query[row]), pa.array(rank.astype(np.int64) + 1), pa.array(ids[row, rank]), pa.array(score[row, rank])],
                    ["query_id", "rank", "neighbour_id", "score"],
                )

    return map_arrow(lists, spread, "query_id long, rank long, neighbour_id long, score double")


def tile(x: dict, y: dict, dim: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (ids, best ids, scores) of one shard's vectors against another's."""
    qi, si = np.frombuffer(x["ids"], np.int64), np.frombuffer(y["ids"], np.int64)
    q, s = (np.frombuffer(z["v"], np.float64).reshape(-1, dim) for z in (x, y))
    for at in range(0, len(qi), BLOCK):
        asking = qi[at : at + BLOCK]
        # A vector is no neighbour of itself; it has the same place in its shard.
        own = np.arange(len(asking)) if x["s"] == y["s"] else np.zeros(0, np.int64)
        yield asking, *product(q[at : at + BLOCK], s, si, (own, own + at), k)


def top_k(df: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbour_id, score): for every vector its k nearest others by cosine, best first.

    Fewer than k where there are no more vectors; of equal scores the smaller ids come first, and a vector is no
    neighbour of itself. :func:`vectors` tells which rows take part. An empty table gives no row; other columns,
    whatever their names, are ignored.
    """
    vecs, dim = vectors(df, id_col, vec_col)
    packed, n = shards(written(vecs, "vectors"), dim, lambda i, v: {"v": unit(v).tobytes()}, "v binary")

    def search(x: dict, y: dict):
        return tile(x, y, dim, k)

    return merged(pairs(packed, n, k, search), n, k)
