"""Many traces at once as arrays: their roots, critical paths and causal paths.

The rows of a chunk are whole traces, in order of (keys, start, id). What :func:`tracewarp.operators.graph.critical_segments`
tells of one trace is computed here for all traces of a chunk, a level of their trees at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows from which on a chunk is complete; it ends with a trace.
CHUNK = 50_000


def chunks(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows in chunks of whole traces; a trace is a run of equal first ``keys`` columns."""
    parts: list[pa.Table] = []
    rows = 0
    for b in it:
        if b.num_rows:
            parts.append(pa.Table.from_batches([b]))
            rows += b.num_rows
        if rows >= CHUNK:
            t = pa.concat_tables(parts).combine_chunks()
            last = int(starts(t, keys)[-1])
            if last:
                yield t.slice(0, last).combine_chunks()
            parts, rows = [t.slice(last)], t.num_rows - last
    if parts:
        yield pa.concat_tables(parts).combine_chunks()


def starts(t: pa.Table, keys: int) -> np.ndarray:
    """First rows of the runs of equal first ``keys`` columns."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in range(keys):
        code = _one(t.column(c)).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _one(c) -> pa.Array:
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _codes(*columns) -> tuple[list[np.ndarray], pa.Array]:
    """Places of the values in the sorted array of all distinct ones, -1 for null; and that array."""
    d = pa.concat_arrays([_one(c).cast(pa.string()) for c in columns]).dictionary_encode()
    order = pc.sort_indices(d.dictionary).to_numpy()
    place = np.full(len(order) + 1, -1, np.int64)
    place[order] = np.arange(len(order))
    code = place[d.indices.fill_null(len(order)).to_numpy(zero_copy_only=False)]
    ends = np.cumsum([0, *(len(c) for c in columns)])
    return [code[a:b] for a, b in zip(ends, ends[1:])], d.dictionary.take(pa.array(order))


class Traces:
    """The traces of a chunk. Arrays are by row unless said otherwise; ``trace`` numbers the traces."""

    def __init__(self, t: pa.Table, keys: int):
        self.t, self.first = t, starts(t, keys)
        self.n = len(self.first)
        self.trace = np.repeat(np.arange(self.n), np.diff([*self.first, t.num_rows]))
        self.start, self.end = (_one(t[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start_time_ns", "end_time_ns"))
        (self.id, parent), words = _codes(t["span_id"], t["parent_span_id"])
        self.known = len(words) + 1
        self.key = np.where(self.id < 0, -1, self.trace * self.known + self.id)
        wanted = np.where(parent < 0, -2, self.trace * self.known + parent)
        order = np.argsort(self.key, kind="stable")
        at = np.searchsorted(self.key[order], wanted, "right") - 1
        #: The row of the parent, of spans that share its id the last; -1 where the trace has none.
        self.parent = np.where((at >= 0) & (self.key[order][at] == wanted), order[at], -1)
        self.wanted = wanted
        (self.service,), self.services = _codes(t["service"])
        self.failed = np.zeros(self.n, bool)
        self.failed[self.trace[pc.fill_null(pc.equal(_one(t["status"]), "error"), False).to_numpy(zero_copy_only=False)]] = True

    def roots(self, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each trace that has spans without a parent the first of these: the traces, and rows."""
        rows = np.flatnonzero(self.parent < 0)
        rows = rows[np.lexsort((*(o[rows] for o in reversed(order)), self.trace[rows]))]
        return np.unique(self.trace[rows], return_index=True)[0], rows[np.unique(self.trace[rows], return_index=True)[1]]

    def own_time(self) -> tuple[np.ndarray, np.ndarray]:
        """The time of each span on its trace's critical path, and by trace the length of the root."""
        start, end = self.start, self.end
        has, root = self.roots(start - end, start, self.id)
        width = np.zeros(self.n, np.int64)
        width[has] = np.maximum(end[root] - start[root], 0)
        kids = np.flatnonzero(self.parent >= 0)
        kids = kids[np.lexsort((self.id[kids], -end[kids], self.wanted[kids]))]
        of = self.wanted[kids]
        moments, moment = np.unique(start, return_inverse=True)
        own = np.zeros(len(start), np.int64)
        row = root[end[root] > start[root]]
        limit = end[row]
        for _ in range(int(np.diff([*self.first, len(start)]).max(initial=0))):
            if not len(row):
                break
            np.add.at(own, row, limit - start[row])
            low = np.searchsorted(of, self.key[row])
            n = np.searchsorted(of, self.key[row], "right") - low
            up = np.repeat(np.arange(len(row)), n)
            kid = kids[np.arange(len(up)) + np.repeat(low - np.cumsum(n) + n, n)]
            fits = (start[kid] >= start[row[up]]) & (start[kid] < limit[up])
            up, kid = up[fits], kid[fits]
            # What the children before, the ones that end later, leave: their earliest begin.
            shift = up * (len(moments) + 1)
            least = np.minimum.accumulate(moment[kid] - shift) if len(kid) else shift
            cursor = limit[up]
            later = np.flatnonzero(up[1:] == up[:-1]) + 1
            cursor[later] = np.minimum(cursor[later], moments[least[later - 1] + shift[later]])
            taken = start[kid] < cursor
            up, kid, cursor = up[taken], kid[taken], cursor[taken]
            until = np.minimum(end[kid], cursor)
            np.subtract.at(own, row[up], until - start[kid])
            deeper = until > start[kid]
            row, limit = kid[deeper], until[deeper]
        return own, width

    def key_columns(self, keys: int, trace: np.ndarray) -> list[pa.Array]:
        rows = pa.array(self.first[trace])
        return [_one(self.t.column(c).take(rows)) for c in range(keys)]

    def services_of(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a trace and a service that it has, in order."""
        some = self.service >= 0
        wide = len(self.services) + 1
        return np.divmod(np.unique(self.trace[some] * wide + self.service[some]), wide)


def services(t: pa.Table, keys: int) -> list[pa.Array]:
    """Columns of :func:`tracewarp.operators.graph.trace_services`."""
    x = Traces(t, keys)
    own, width = x.own_time()
    names = x.services.to_pylist()
    unknown = names.index("unknown") if "unknown" in names else len(names)
    names = names if unknown < len(names) else [*names, "unknown"]
    wide = len(names) + 1
    on, has = np.flatnonzero(own > 0), np.flatnonzero(x.service >= 0)
    paid = x.trace[on] * wide + np.where(x.service[on] < 0, unknown, x.service[on])
    there = np.unique(x.trace[has] * wide + x.service[has])
    pairs = np.union1d(paid, there)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, np.searchsorted(pairs, paid), own[on])
    # A trace of neither has a row without a service.
    bare = np.setdiff1d(np.arange(x.n), pairs // wide)
    pairs, total = np.concatenate([pairs, bare * wide + wide - 1]), np.concatenate([total, np.zeros(len(bare), np.int64)])
    order = np.argsort(pairs)
    pairs, total = pairs[order], total[order]
    trace, name = np.divmod(pairs, wide)
    return [
        *x.key_columns(keys, trace), pa.array(names, pa.string()).take(pa.array(name, mask=name == wide - 1)), pa.array(total, mask=total == 0), pa.array(width[trace]), pa.array(x.failed[trace]),
        pa.array(np.isin(pairs, there)), pa.array(np.diff(trace, prepend=-1) != 0),
    ]


def summaries(t: pa.Table, keys: int) -> list[pa.Array]:
    """A row of each trace: operation and start of its widest root (ties by id; null without one), the root's length, services, failed, and of the critical path the sum and the envelope."""
    x = Traces(t, keys)
    own, width = x.own_time()
    total = np.zeros(x.n, np.int64)
    np.add.at(total, x.trace, own)
    (operation,), words = _codes(t["operation"])
    has, rows = x.roots(x.start - x.end, x.id, operation, x.start)
    row, none = np.zeros(x.n, np.int64), np.ones(x.n, bool)
    row[has], none[has] = rows, False
    trace, service = x.services_of()
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(trace, np.arange(x.n + 1)).astype(np.int32)), x.services.take(pa.array(service)))
    op = operation[row]
    return [
        *x.key_columns(keys, np.arange(x.n)), words.take(pa.array(op, mask=none | (op < 0))), pa.array(x.start[row], mask=none), pa.array(np.maximum(x.end - x.start, 0)[row], mask=none), lists, pa.array(x.failed), pa.array(total), pa.array(width),
    ]


def paths(t: pa.Table, keys: int) -> list[pa.Array]:
    """Of each span its path of service:operation from the root, its number among the trace's of that path, its id and duration.

    A span on a cycle of parents has a path of as many spans as its trace has, and one.
    """
    x = Traces(t, keys)
    (operation,), words = _codes(t["operation"])
    pair, label = np.unique((x.service + 1) * (len(words) + 1) + operation + 1, return_inverse=True)
    ops, names = ["None", *words.to_pylist()], ["?", *x.services.to_pylist()]
    labels = [f"{names[p // len(ops)]}:{ops[p % len(ops)]}" for p in pair]
    path, made = np.full(len(label), -1), []

    def number(rows: np.ndarray, key: np.ndarray, text) -> None:
        some, at = np.unique(key, return_inverse=True)
        path[rows] = len(made) + at
        made.extend([text(k) for k in some.tolist()])

    rows = np.flatnonzero(x.parent < 0)
    number(rows, label[rows], lambda k: labels[k])
    left = np.flatnonzero(x.parent >= 0)
    while len(rows):
        now = path[x.parent[left]] >= 0
        rows, left = left[now], left[~now]
        number(rows, path[x.parent[rows]] * len(labels) + label[rows], lambda k: f"{made[k // len(labels)]} > {labels[k % len(labels)]}")
    sizes = np.diff([*x.first, len(label)])
    for r in left.tolist():
        steps, at = [], r
        while at >= 0 and len(steps) <= sizes[x.trace[r]]:
            steps.append(labels[label[at]])
            at = int(x.parent[at])
        path[r] = len(made)
        made.append(" > ".join(reversed(steps)))
    if len(left):
        made, at = np.unique(np.array(made, object), return_inverse=True)
        path, made = at[path], made.tolist()
    order = np.lexsort((path, x.trace))
    key = x.trace[order] * len(made) + path[order]
    begin = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, np.arange(len(key)), 0)) if len(key) else key
    ordinal = np.empty(len(key), np.int64)
    ordinal[order] = np.arange(len(key)) - begin
    return [*(_one(t.column(c)) for c in range(keys)), pa.array(made, pa.string()).take(pa.array(path)), pa.array(ordinal), _one(t["span_id"]), pa.array(x.end - x.start)]


def paths_and_summaries(t: pa.Table, keys: int) -> list[pa.Array]:
    """:func:`paths` with the columns of :func:`summaries` on the first span of each trace, null on others."""
    first = starts(t, keys)
    at, none = np.zeros(t.num_rows, np.int64), np.ones(t.num_rows, bool)
    at[first], none[first] = np.arange(len(first)), False
    return [*paths(t, keys), *(c.take(pa.array(at, mask=none)) for c in summaries(t, keys)[keys:])]
