"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 128 bits: the signs of the sum of a pseudo-random +-1 vector per distinct word, weighted by
1 + ln(count). It is cut into six segments of 21 or 22 bits. Two fingerprints within 17 bits differ by at most 2 in
some segment (six segments with 3 or more would make 18), so the radius-1 Hamming balls around their values of that
segment meet. Each fingerprint is put into a table under every value of its balls, one shuffle brings equal values
together, and each bucket's pairs are verified by their whole distance. The search is exact up to
``MAX_DISTANCE``: it finds what comparing all pairs would find.

Fingerprints that are equal are one entry, so exact copies add nothing to the buckets; a bucket with many near pairs
yields a spanning forest of them instead of all, which leaves the groups as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarp.llm.common import connected_components, map_arrow, partitions_for, quoted, text_chunks, unused, written

BITS = 128
#: (word, shift, width) of each segment; no segment crosses a 64-bit word.
SEGMENTS = ((0, 0, 22), (0, 22, 21), (0, 43, 21), (1, 0, 22), (1, 22, 21), (1, 43, 21))
MAX_DISTANCE = 3 * len(SEGMENTS) - 1
#: Least number of leading bits of a segment that choose its group. All values of a ball that differ in other bits are
#: in one group, so an entry is sent once for them, and once for each leading bit flipped: 6 (1 + bits) rows an entry for
#: 134 bucket values. The more entries, the more bits, up to the whole segment, so that a group stays about as large.
PREFIX = 5
#: Rows of a group on average, from which on it takes another bit, and of a partition of the sent table.
GROUP_ROWS, SENT_ROWS = 250_000, 500_000
#: Buckets of more entries than this give a forest, if so large a share of so many sampled pairs is near.
FOREST_FROM = 48
DENSE, SAMPLED = 0.1, 64
#: Pairs of a run of rows from which on it is compared in tiles, pairs of a tile, and edges of a group that are kept before they are thinned to a forest.
TILED, TILE, EDGES = 2048, 32768, 1_000_000
STRIP = ".,;:!?"


def words(text: str | None) -> dict[str, int]:
    """Lower-case words of a text, split at white space and stripped of sentence punctuation, with their counts."""
    out: dict[str, int] = {}
    for w, n in Counter((text or "").lower().split()).items():
        w = w.strip(STRIP)
        if w:
            out[w] = out.get(w, 0) + n
    return out


def fingerprint_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) uint64 fingerprints, and which texts have one: those with a word."""
    index: dict[str, int] = {}
    ids, weights, ends = [], [], []
    for t in texts:
        c = words(t)
        ids.extend([index.setdefault(w, len(index)) for w in c])
        weights.extend([1.0 if n == 1 else 1.0 + log(n) for n in c.values()])
        ends.append(len(ids))
    out, ok = np.zeros((len(texts), 2), np.uint64), np.zeros(len(texts), bool)
    if not index:
        return out, ok
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in index]), np.uint8).reshape(-1, BITS // 8)
    signs = np.unpackbits(digests, axis=1).astype(np.float32)
    signs *= 2
    signs -= 1
    ids_, weights_, start = np.array(ids, np.int64), np.array(weights, np.float32), 0
    for i, end in enumerate(ends):
        if end > start:
            total = np.zeros(BITS, np.float32)
            for k in range(start, end, 65536):  # bounds the memory of very long texts
                k2 = min(end, k + 65536)
                total += weights_[k:k2] @ signs[ids_[k:k2]]
            out[i], ok[i] = np.packbits(total > 0).view(">u8"), True
        start = end
    return out, ok


def _fingerprint_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for at, texts in text_chunks(b, 1, 1_000_000):
            fp, ok = fingerprint_texts(texts)
            fp = fp[ok].view(np.int64)
            ids = b.column(0).slice(at, len(texts)).filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.ascontiguousarray(fp[:, 0])), pa.array(np.ascontiguousarray(fp[:, 1]))], ["id", "f0", "f1"]
            )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0, f1) of each document with an id and at least one word."""
    src = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    return map_arrow(src.where("id is not null and text is not null"), _fingerprint_batches, "id long, f0 long, f1 long")


def ball_keys(fp: np.ndarray) -> np.ndarray:
    """(n, 134) int64 bucket keys: for each segment its value and all values at distance 1, tagged by the segment."""
    cols = []
    for s, (word, shift, width) in enumerate(SEGMENTS):
        v = ((fp[:, word] >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        flips = np.concatenate([[0], 1 << np.arange(width, dtype=np.int64)])
        cols.append((v[:, None] ^ flips[None, :]) | (s << 32))
    return np.concatenate(cols, axis=1)


def prefix_bits(entries: int) -> int:
    """Leading bits that choose a group, for so many entries: groups of at most about ``GROUP_ROWS`` rows."""
    bits = PREFIX
    while bits < min(width for _, _, width in SEGMENTS) and entries * (1 + bits) > GROUP_ROWS << bits:
        bits += 1
    return bits


def group_numbers(fp: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """(n, 6 (1 + prefix)) int64 groups that an entry is sent to: a segment and the leading bits of the values of its ball there."""
    cols = []
    for s, (word, shift, width) in enumerate(SEGMENTS):
        top = ((fp[:, word] >> np.uint64(shift + width - prefix)) & np.uint64((1 << prefix) - 1)).astype(np.int64)
        flips = np.concatenate([[0], 1 << np.arange(prefix, dtype=np.int64)])
        cols.append((top[:, None] ^ flips[None, :]) | (s << 32))
    return np.concatenate(cols, axis=1)


def group_keys(group: int, fp: np.ndarray, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and bucket keys of a group's entries: those of :func:`ball_keys` whose leading bits are the group's."""
    s, top = group >> 32, group & ((1 << prefix) - 1)
    word, shift, width = SEGMENTS[s]
    low = width - prefix
    v = ((fp[:, word] >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
    # An entry with other leading bits has used its one flip on them.
    rest = (v & ((1 << low) - 1)) | (top << low) | (s << 32)
    same = np.flatnonzero(v >> low == top)
    flips = 1 << np.arange(low, dtype=np.int64)
    rows = np.concatenate([np.arange(len(v)), np.repeat(same, low)])
    return rows, np.concatenate([rest, (rest[same][:, None] ^ flips[None, :]).ravel()])


def _sender(prefix: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 1000):
                c = b.slice(at, 1000)
                cols = [c.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                groups = group_numbers(np.stack(cols[1:], axis=1).view(np.uint64), prefix)
                n = groups.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(groups.ravel()), *(pa.array(np.repeat(x, n)) for x in cols)], ["g", "id", "f0", "f1"])

    return run


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of 64-bit words."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def meeting_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The one bucket in which a pair within ``MAX_DISTANCE`` counts: first segment within 2, smallest shared value."""
    out = np.full(len(x), -1, np.int64)
    for s, (word, shift, width) in enumerate(SEGMENTS):
        mask = np.uint64((1 << width) - 1)
        u = ((x[:, word] >> np.uint64(shift)) & mask).astype(np.int64)
        v = ((y[:, word] >> np.uint64(shift)) & mask).astype(np.int64)
        diff = u ^ v
        low = diff & -diff
        # Distance 2: the shared values flip either differing bit of u; distance 1 or 0: u and v are both shared.
        shared = np.where(np.bitwise_count(diff) == 2, np.minimum(u ^ low, u ^ (diff ^ low)), np.minimum(u, v))
        now = (out < 0) & (np.bitwise_count(diff) <= 2)
        out[now] = shared[now] | (s << 32)
    return out


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of rows within ``MAX_DISTANCE``; compares no pair twice."""
    left, edges = np.arange(len(fp)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = distances(fp[left], fp[i]) <= MAX_DISTANCE
            found = left[near]
            edges.extend((int(i), int(j)) for j in found)
            queue.extend(found)
            left = left[~near]
    return edges


def thinned(edges: np.ndarray) -> np.ndarray:
    """A spanning forest of the edges (m, 2), of some of them."""
    nodes, at = np.unique(edges, return_inverse=True)
    u, v = at.reshape(edges.shape).T
    root, kept, rows = np.arange(len(nodes)), [], np.arange(len(edges))
    while len(rows):
        # Each root that has an edge to a smaller one takes one such edge, so no cycle closes.
        x, y = root[u[rows]], root[v[rows]]
        apart = x != y
        rows, high, low = rows[apart], np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        high, first = np.unique(high, return_index=True)
        kept.append(rows[first])
        root[high] = low[first]
        while (root[root] != root).any():
            root = root[root]
    return edges[np.sort(np.concatenate(kept))] if kept else edges


def _within(a: np.ndarray, first: int, last: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row of [first, last) and one of [low, high) of the words ``a`` that are within ``MAX_DISTANCE``."""
    found = []
    for c in range(low, high, TILE):
        cols = a[c : min(high, c + TILE)]
        step = max(1, TILE // len(cols))
        for r in range(first, last, step):
            x = a[r : min(last, r + step), None] ^ cols
            hit = np.flatnonzero(np.bitwise_count(x) <= MAX_DISTANCE)
            if len(hit):
                row, col = np.divmod(hit, len(cols))
                found.append((row + r, col + c))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def bucket_edges(key: np.ndarray, ids: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """(m, 2) near pairs of ids among rows with equal keys, whose closure is that of all such pairs.

    A pair counts in one bucket only, that of :func:`meeting_key`. So a row that is here by a flip of a bit is compared
    with the rows of lower flips and of none, if the bit is 0 in the key, and with no row of the same flip; a row whose
    own value is the key is compared with others of that value. By words, the one without the segment comes first, as
    it tells more.
    """
    value, word = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    for s in np.unique(key >> 32):
        rows = np.flatnonzero(key >> 32 == s)
        w, shift, width = SEGMENTS[s]
        value[rows], word[rows] = ((fp[rows, w] >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64), w
    flip = value ^ (key & 0xFFFFFFFF)
    order = np.argsort((key << 22) | flip)
    key, flip, ids, fp, word = key[order], flip[order], ids[order], fp[order], word[order]
    n = np.arange(len(key))
    far, own = fp[n, 1 - word], fp[n, word]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    begins = np.concatenate([[True], (key[1:] != key[:-1]) | (flip[1:] != flip[:-1])])
    start = np.maximum.accumulate(np.where(first, n, 0))
    until = np.where(flip == 0, n, np.where(key & flip == 0, np.maximum.accumulate(np.where(begins, n, 0)), start))
    out: list[np.ndarray] = []
    kept, most = 0, EDGES

    # Large buckets in which a sample of pairs is often near give a forest.
    starts = np.flatnonzero(first)
    counts = np.diff(np.concatenate([starts, [len(key)]]))
    big = counts > FOREST_FROM
    if big.any():
        pick = np.random.default_rng(0).integers(0, 2**62, (2, big.sum(), SAMPLED)) % counts[big][:, None] + starts[big][:, None]
        dense = (distances(fp[pick[0]], fp[pick[1]]) <= MAX_DISTANCE).mean(1) >= DENSE
        for b, c in zip(starts[big][dense], counts[big][dense]):
            if e := forest(fp[b : b + c]):
                out.append(ids[b : b + c][np.array(e)])
            until[b : b + c] = start[b]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal out, kept, most
        near = np.bitwise_count(far[i] ^ far[j]) + np.bitwise_count(own[i] ^ own[j]) <= MAX_DISTANCE
        i, j = i[near], j[near]
        here = meeting_key(fp[i], fp[j]) == key[i]
        out.append(np.stack([ids[i[here]], ids[j[here]]], axis=1))
        kept += len(out[-1])
        if kept > most:
            out = [thinned(np.concatenate(out))]
            kept, most = len(out[0]), max(EDGES, 2 * len(out[0]))

    # Runs of rows with the same range are compared as tiles where they are large, pair by pair where not.
    run = np.flatnonzero(begins)
    end = np.concatenate([run[1:], [len(key)]])
    pairs = np.add.reduceat(until - start, run)
    for r in np.flatnonzero(pairs >= TILED):
        if flip[run[r]]:
            add(*_within(far, run[r], end[r], start[run[r]], until[run[r]]))
        else:
            for at in range(run[r], end[r], 1024):
                to = min(end[r], at + 1024)
                i, j = _within(far, at, to, start[at], to)
                add(i[j < i], j[j < i])
    small = np.repeat(pairs < TILED, end - run)
    rows = np.flatnonzero(small & (until > start))
    upto = np.concatenate([[0], np.cumsum((until - start)[rows])])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + 2**18, "right")) - 1)
        some, c = rows[at:to], (until - start)[rows[at:to]]
        i = np.repeat(some, c)
        j = np.arange(len(i)) + np.repeat(start[some] - (upto[at:to] - upto[at]), c)
        near = np.bitwise_count(far[i] ^ far[j]) <= MAX_DISTANCE
        add(i[near], j[near])
        at = to
    if not out:
        return np.zeros((0, 2), np.int64)
    return np.unique(np.sort(np.concatenate(out), axis=1), axis=0)


def _edge_finder(prefix: int):
    """Edges of each group of a partition sorted by group; one group is in memory at a time."""

    def found(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        group, ids, f0, f1 = (np.concatenate(x) for x in zip(*parts))
        fp = np.stack([f0, f1], axis=1).view(np.uint64)
        rows, keys = group_keys(int(group[0]), fp, prefix)
        e = bucket_edges(keys, ids[rows], fp[rows])
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for b in it:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            starts = np.flatnonzero(np.diff(cols[0], prepend=parts[-1][0][-1] if parts else -1))
            # All but the first run begin a group.
            for k, (at, end) in enumerate(zip([0, *starts], [*starts, b.num_rows])):
                if k and parts:
                    yield found(parts)
                    parts = []
                if end > at:
                    parts.append([c[at:end] for c in cols])
        if parts:
            yield found(parts)

    return run


def near_edges(entries: DataFrame) -> DataFrame:
    """(a, b) id pairs whose transitive closure is that of all pairs of ``entries`` (id, f0, f1) within the distance."""
    count = entries.count()
    prefix = prefix_bits(count)
    n = partitions_for(entries.sparkSession, count * len(SEGMENTS) * (1 + prefix), SENT_ROWS)
    table = map_arrow(entries, _sender(prefix), "g long, id long, f0 long, f1 long")
    return map_arrow(table.repartition(n, "g").sortWithinPartitions("g"), _edge_finder(prefix), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, duplicate_of): each document that goes, with the one of its group that stays.

    Groups are the connected components of "fingerprints within ``MAX_DISTANCE`` bits"; the smallest id stays and has
    no row. Documents without an id, or whose text is null or has no word (empty, or sentence punctuation only), have
    no fingerprint and are in no group. Rows that repeat an id are one document; if their texts differ it is in the
    groups of all of them. An empty table gives no row. Other columns, whatever their names, are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    entries = written(fps.groupBy("f0", "f1").agg(F.min("id").alias("id")).select("id", "f0", "f1"), "entries")
    # Two fingerprints may share their smallest id only where rows repeat an id: then the id links them.
    comp = connected_components(
        near_edges(entries).union(
            fps.join(entries.toDF("e", "f0", "f1"), ["f0", "f1"]).where("id != e").select("id", "e").toDF("a", "b")
        ),
        "a",
        "b",
    )
    return comp.where("node != component").select(
        F.col("node").alias("doc_id"), F.col("component").alias("duplicate_of")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that :func:`near_duplicates` tells to go; columns as they are."""
    gone = written(near_duplicates(docs, id_col, text_col), "duplicates")
    name = unused(docs.columns, "__gone")
    return docs.join(gone.select(F.col("doc_id").alias(name)), quoted(id_col).cast("long") == F.col(name), "left_anti")
