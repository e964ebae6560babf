"""Traces as arrays against the walk over one trace, a span at a time."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from tracewarp.operators import graph, whole_traces

COLUMNS = ["trace_id", *graph._NEEDED]
KINDS = pa.schema([(c, pa.int64() if c.endswith("_ns") else pa.string()) for c in COLUMNS])


def services_of(group):
    root, found = graph.critical_segments(group)
    total = {}
    for a, b, s in found:
        name = s["service"] if s["service"] is not None else "unknown"
        total[name] = total.get(name, 0) + b - a
    present = {s["service"] for s in group} - {None}
    failed = any(s["status"] == "error" for s in group)
    width = max(0, root["end_time_ns"] - root["start_time_ns"]) if root else 0
    for i, name in enumerate(sorted(total.keys() | present) or [None]):
        yield name, total.get(name), width, failed, name in present, i == 0


def paths_of(group):
    ids, seen = {s["span_id"]: s for s in group}, {}
    for s in group:
        path, at = [], s
        while at is not None and len(path) <= len(group):
            path.append(f"{'?' if at['service'] is None else at['service']}:{at['operation']}")
            at = ids.get(at["parent_span_id"])
        key = " > ".join(reversed(path))
        n = seen[key] = seen.get(key, -1) + 1
        yield key, n, s["span_id"], s["end_time_ns"] - s["start_time_ns"]


def summary_of(group):
    ids = {s["span_id"] for s in group}
    roots = [s for s in group if s["parent_span_id"] not in ids]
    best = min(roots, key=lambda s: (s["start_time_ns"] - s["end_time_ns"], s["span_id"], s["operation"] or "", s["start_time_ns"])) if roots else None
    root, found = graph.critical_segments(group)
    length = lambda s: max(0, s["end_time_ns"] - s["start_time_ns"])
    own = (best["operation"], best["start_time_ns"], length(best)) if best else (None, None, None)
    return (*own, sorted({s["service"] for s in group} - {None}), any(s["status"] == "error" for s in group), sum(b - a for a, b, _ in found), length(root) if root else 0)


def traces(n=400):
    """Trees with ties, orphans, spans without a service or that end before they begin, repeated ids of leaves, cycles, and a deep and a wide one."""
    r = random.Random(11)
    out = []
    for t in range(n):
        size = 300 if t in (5, 6) else r.randint(1, 9)
        group = []
        for i in range(size):
            parent = None if i == 0 or r.random() < 0.1 else f"s{i - 1 if t == 5 else 0 if t == 6 else r.randint(0, i - 1)}" if r.random() < 0.9 else "gone"
            a = r.randint(0, 40)
            group.append([f"s{i}", parent, r.choice(["a", "b", "unknown", "c", None]), r.choice(["x", "y", None]), a, a + r.choice([0, 1, 5, 20, 20, 60, -3 if t % 7 == 0 else 9]), r.choice(["ok", "ok", "error", None])])
        if t % 10 == 0:
            group.append(["s0x", "s0", "a", "x", 3, 9, "ok"])
            group.append(["s0x", "s0", "b", "x", 4, 9, "ok"])
        if t % 13 == 0:
            group += [["k1", "k2", "a", "x", 0, 9, "ok"], ["k2", "k1", "b", "y", 1, 9, "ok"], ["k3", "k3", "c", "x", 2, 3, "ok"]]
        if t % 17 == 0:
            group = [["k1", "k2", None, "x", 0, 9, "ok"], ["k2", "k1", None, "y", 1, 9, "error"]]
        group.sort(key=lambda s: (s[4], s[0]))
        out.append((f"t{t}", [dict(zip(graph._NEEDED, s)) for s in group]))
    return out


def table(some):
    return pa.Table.from_pylist([{"trace_id": t} | s for t, g in some for s in g], schema=KINDS)


def rows(columns):
    return [tuple(x) for x in zip(*(c.to_pylist() for c in columns))]


@pytest.mark.parametrize("f, plain", [(whole_traces.services, services_of), (whole_traces.paths, paths_of), (whole_traces.summaries, lambda g: [summary_of(g)])])
def test_arrays_equal_the_walk(f, plain):
    some = traces()
    want = [(t, *r) for t, g in some for r in plain(g)]
    got = rows(f(table(some), 1))
    assert len(got) == len(want) and [x for x in zip(got, want) if x[0] != x[1]] == []


def test_chunks_are_whole_traces(monkeypatch):
    monkeypatch.setattr(whole_traces, "CHUNK", 40)
    t = table(traces(60))
    parts = list(whole_traces.chunks(iter(t.to_batches(max_chunksize=7)), 1))
    assert pa.concat_tables(parts) == t and len(parts) > 3
    ids = [set(p["trace_id"].to_pylist()) for p in parts]
    assert all(not a & b for i, a in enumerate(ids) for b in ids[i + 1 :])


def test_one_pass_gives_paths_and_summaries():
    t = table(traces(50))
    both, paths, summaries = (f(t, 1) for f in (whole_traces.paths_and_summaries, whole_traces.paths, whole_traces.summaries))
    assert rows(both[:5]) == rows(paths)
    assert [r for r in rows([both[0], *both[5:]]) if r[5] is not None] == rows(summaries)


def test_no_span_becomes_a_python_object(monkeypatch):
    """A pass over many traces walks no trace by itself."""
    monkeypatch.setattr(graph, "critical_segments", None)
    t = table(traces(100))
    assert len(rows(whole_traces.services(t, 1))) > 100 and not hasattr(graph, "_services_of")
