"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader updates.

A text is cut into words and runs of punctuation. Its features are hashes of the tokens and of the pairs of adjacent
tokens (a token that repeats its predecessor counts as one feature whatever the token), with counts scaled to unit
length. Training sees a bounded sample of labelled rows in one task; scoring is one pass over all documents, a
sparse dot product each, with the weights shipped in the closure (a fixed 2**18 floats at most).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracewarp.llm.common import map_arrow, quoted, text_chunks

DIM_BITS = 18
DIM = 1 << DIM_BITS
#: Most labelled rows that training reads: those with the smallest hashes of their ids.
MAX_LABELLED = 8192
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 1e-4
THRESHOLD = 0.5
TOKEN = re.compile(r"\w+|[^\w\s]+")
_C1, _C2, _SAME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x5851F42D4C957F2D)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value): sparse rows of unit length, in order of text and feature; none for a text without token."""
    index: dict[str, int] = {}
    ids: list[int] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            ids.extend([index.setdefault(w, len(index)) for w in TOKEN.findall(t)])
        ends[i + 1] = len(ids)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in index], np.uint64)
    h = hashes[np.array(ids, np.int64)]
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    inside = row[1:] == row[:-1]
    a, b = h[:-1][inside], h[1:][inside]
    pair = a * _C1 ^ (b * _C2 + (a >> np.uint64(7)))
    pair[a == b] = _SAME
    both = np.concatenate([h, pair])
    feature = ((both * _C1) >> np.uint64(64 - DIM_BITS)).astype(np.int64)
    key, count = np.unique(np.concatenate([row, row[1:][inside]]) << DIM_BITS | feature, return_counts=True)
    row, feature = key >> DIM_BITS, key & (DIM - 1)
    norm = np.sqrt(np.bincount(row, (count * count).astype(np.float64), len(texts)))
    return row, feature, count / norm[row]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights, with the bias last, of rows of (features, values, label) seen in their order ``epochs`` times."""
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(epochs):
        for feature, value, label in rows:
            i, x = np.append(feature, DIM), np.append(value, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(DIM + 1)).astype(np.float32)


def scores(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Probability of good quality of each text; 0 for one without a token."""
    row, feature, value = features(texts)
    total = np.bincount(row, value * weights[feature], len(texts)) + weights[-1]
    out = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
    out[np.bincount(row, minlength=len(texts)) == 0] = 0.0
    return out


def _feature_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for at, texts in text_chunks(b, 2, 1_000_000):
            row, feature, value = features(texts)
            cut = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), *lists], ["id", "label", "feature", "value"]
            )


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> np.ndarray | None:
    """Weights of a model of ``labels`` (id, 0/1), or None where they don't show both classes.

    Of the labels, at most ``max_labelled`` are used, chosen by a hash of the id. Null ids and labels, and ids with
    contrary labels, are left out.
    """
    good = (
        labels.select(quoted(id_col).cast("long").alias("__id"), quoted(label_col).cast("int").alias("__label"))
        .where("__id is not null and __label in (0, 1)")
        .groupBy("__id")
        .agg(F.min("__label").alias("__label"), F.max("__label").alias("__most"))
        .where("__label = __most")
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_labelled)
        .select("__id", "__label")
    )
    src = docs.select(quoted(id_col).cast("long").alias("__doc"), quoted(text_col).cast("string").alias("__text")).where("__text is not null")
    found = src.join(F.broadcast(good), F.col("__doc") == F.col("__id")).select("__id", "__label", "__text")
    rows = map_arrow(found, _feature_batches, "id long, label int, feature array<int>, value array<float>")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for b in it:
            ids, labels_ = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(b.num_rows):
                f, v = (np.asarray(b.column(k)[i].values) for k in (2, 3))
                if len(f):
                    seen.append((xxhash.xxh3_64_intdigest(str(ids[i])), f.tobytes(), f.astype(np.int64), v.astype(np.float64), labels_[i]))
        if len({s[-1] for s in seen}) == 2:
            seen.sort(key=lambda s: s[:2])  # the same order however the rows were spread
            w = train([s[2:] for s in seen])
            yield pa.RecordBatch.from_pydict({"w": pa.array([w.tobytes()], pa.binary())})

    # Many small tasks make the features; one reads them, as the updates are sequential.
    got = map_arrow(rows.repartition(1), run, "w binary").collect()
    return np.frombuffer(bytes(got[0].w), np.float32) if got else None


def scored(docs: DataFrame, weights: np.ndarray | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """The documents, with ``out`` (replacing a column of that name): the probability of good quality.

    A null, empty or blank text scores 0; without a model every text with a token scores 1.
    """
    keep = [c for c in docs.columns if c != out]
    src = docs.select(*map(quoted, keep))
    at = keep.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            parts = [np.zeros(0)]
            for _, texts in text_chunks(b, at, 1_000_000):
                parts.append(scores(texts, weights) if weights is not None else np.array([float(bool(t and t.strip())) for t in texts]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts))], [*keep, out])

    schema = StructType([*(src.schema[c] for c in keep), StructField(out, DoubleType())])
    return map_arrow(src, run, schema)


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents that the classifier doesn't reject, with ``score``: those that score at least ``THRESHOLD``.

    Null, empty and blank texts are rejected. If the labels don't show both classes there is no model, and all other
    texts are kept with score 1. Rows that repeat are scored alike; a null id is no matter for scoring. Columns stay
    as they are, but for one named ``score``, which is replaced.
    """
    w = fit(docs, labels, id_col, text_col, label_col)
    return scored(docs, w, text_col).where(quoted("score") >= THRESHOLD)
