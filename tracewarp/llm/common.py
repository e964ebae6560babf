"""Shared pieces: the cluster's shared folder, written tables that cut lineage, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarp.tables import delete as release
from tracewarp.tables import fresh_path as new_path
from tracewarp.tables import shared_dir, stored, written

__all__ = ["batches", "connected_components", "map_arrow", "new_path", "partitions_for", "quoted", "release", "shared_dir", "stored", "text_chunks", "trim", "unused", "written"]


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until it clashes with none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between stages, beside those of the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with a worker that is trimmed after each task; Spark bounds the bytes of a batch, however long the texts."""

    def trimmed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(it)
        finally:
            trim()

    return df.mapInArrow(trimmed, schema)


def text_chunks(batch: pa.RecordBatch, column: int, chars: int) -> Iterator[tuple[int, list]]:
    """(offset, texts) runs of an Arrow batch of at most ``chars`` characters, or of one text if that is longer."""
    start, size, out = 0, 0, []
    for first in range(0, batch.num_rows, 256):
        for i, t in enumerate(batch.column(column).slice(first, 256).to_pylist(), first):
            n = len(t) if t else 0
            if out and size + n > chars:
                yield start, out
                start, size, out = i, 0, []
            out.append(t)
            size += n
    if out:
        yield start, out


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Shuffle partitions that keep about ``per_partition`` rows each, at least the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node of an edge, the component being its smallest node.

    Alternates large-star and small-star steps until nothing changes: every step replaces edges by edges to the
    smallest neighbour, so a chain halves each round and the largest table stays as large as the input. Each
    round is written to the shared folder.
    """
    e, path = stored(
        edges.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )

    def mark(df: DataFrame):
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    before = mark(e)
    while before[0]:
        # Large star: each node points its larger neighbours to its smallest one.
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
        large = both.join(m, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # Small star: each node's smaller neighbours, and the node, point to the smallest of them.
        s = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(s, F.col("u") == F.col("w"))
        nxt = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(s.select(F.col("w").alias("u"), F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        old, (e, path) = path, stored(nxt, "edges")
        release(edges.sparkSession, old)
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def batches(rows: Iterable[dict], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of dict rows."""
    buf: list[dict] = []
    for r in rows:
        buf.append(r)
        if len(buf) >= size:
            yield pa.RecordBatch.from_pylist(buf, schema=schema)
            buf = []
    if buf:
        yield pa.RecordBatch.from_pylist(buf, schema=schema)
