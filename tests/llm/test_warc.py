from __future__ import annotations

import gzip
import io
import json
import zlib

import pytest

from tracewarp.llm import warc as W

SCHEMA = "file string, page_id long, url string, html string, offset int, path string"


def frame(spark, rows):
    return spark.createDataFrame([("f", *r, 1, "p") for r in rows], SCHEMA)


def record(i, body=b"x"):
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def run(data):
    out = io.BytesIO()
    return list(W.normalise_stream(io.BytesIO(data), out)), out.getvalue()


def test_each_record_becomes_a_member_of_its_own():
    bodies = [b"", b"a", b"WARC/1.0\r\n\r\n", bytes(range(256)) * 20_000, b"\r\n\r\n\r\n"]
    raw = b"".join(record(i, b) for i, b in enumerate(bodies))
    for data in (gzip.compress(raw), b"".join(gzip.compress(record(i, b)) for i, b in enumerate(bodies)), gzip.compress(raw) + b"\0" * 1000):
        entries, out = run(data)
        assert [e["ordinal"] for e in entries] == list(range(5)) and gzip.decompress(out) == raw
        for e, b in zip(entries, bodies):
            h, got = W.read_member(io.BytesIO(out), e["offset"], e["length"])
            assert got == b and e["payload_length"] == len(b)
            alone = zlib.decompressobj(31)
            alone.decompress(out[e["offset"] :])
            assert alone.eof and len(out[e["offset"] :]) - len(alone.unused_data) == e["length"]


@pytest.mark.parametrize(
    "data,good,why",
    [
        (gzip.compress(record(1) + record(2))[:-12], 1, "ends within"), (gzip.compress(record(1) + b"junk\r\n\r\n"), 1, "no WARC record"),
        (gzip.compress(record(1) + b"WARC/1.0\r\nA: b\r\n\r\n"), 1, "no Content-Length"), (gzip.compress(record(1)) + b"garbage", 1, "header"),
        (gzip.compress(record(1) + record(2, b"a long body")[:-8]), 1, "within a record"), (gzip.compress(b"WARC/1.0" + b"x" * 3_000_000), 0, "head doesn't end"),
    ],
)
def test_damaged_files_keep_what_came_before(data, good, why):
    entries, out = run(data)
    assert len([e for e in entries if e["type"] != W.DAMAGED]) >= good and entries[-1]["type"] == W.DAMAGED and why in entries[-1]["record_id"]


def test_empty_files():
    assert run(b"")[0] == [] and run(gzip.compress(b""))[0] == [] and run(gzip.compress(b"\r\n\r\n"))[0] == []


def test_round_trip_with_edge_cases(spark):
    rows = [
        (1, "https://a/é", "<p>ü</p>\r\n\r\nWARC/1.1\r\n"), (1, "https://a/é", "<p>ü</p>\r\n\r\nWARC/1.1\r\n"), (2, None, "x"), (None, "u", None), (3, "", ""),
        (4, " a\r\nContent-Length: 3 ", "y"), (5, "long", "é" * 3_000_000), (None, None, None), (6, "with %0a and space", "\x00\x1f"),
    ]
    got = W.through_archive(frame(spark, rows)).collect()
    assert sorted(((r.page_id, r.url, r.html) for r in got), key=repr) == sorted(rows, key=repr)
    assert all(r.payload_length == len((r.html or "").encode()) for r in got)
    assert W.through_archive(frame(spark, [])).count() == 0


def test_heads_of_any_length(spark, monkeypatch):
    rows = [(1, "https://a/" + "x" * 3_000_000, "a"), (2, "\n" + "é" * 1_000_000, "b"), (3, "u", "c")]
    got = W.through_archive(frame(spark, rows).coalesce(1)).collect()
    assert sorted((r.page_id, r.url, r.html) for r in got) == rows
    monkeypatch.setattr(W, "normalise_stream", lambda f, out: iter([{"ordinal": 0, "type": W.DAMAGED, "record_id": "why"}]))
    with pytest.raises(RuntimeError, match="damaged at record 0: why"):
        W.through_archive(frame(spark, rows[2:]))


def test_sidecars_equal_the_index_and_names_may_clash(spark, tmp_path):
    for d in "ab":
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.warc.gz").write_bytes(gzip.compress(record(d) + record(d + "2")))
    (tmp_path / "bad.warc.gz").write_bytes(b"no gzip")
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    paths = [str(tmp_path / p) for p in ("a/x.warc.gz", "b/x.warc.gz", "bad.warc.gz", "empty.warc.gz", "a/x.warc.gz")] + [None]
    index = W.normalise(spark, spark.createDataFrame([(p, 1) for p in paths], "path string, file int"), str(tmp_path / "out"))
    rows = sorted(index.collect(), key=str)
    assert rows == sorted(W.sidecars(spark, str(tmp_path / "out")).collect(), key=str)
    assert sorted(r.record_id for r in rows if r.type != W.DAMAGED) == ["<a2>", "<a>", "<b2>", "<b>"]
    assert [r.source for r in rows if r.type == W.DAMAGED] == [paths[2]]
    side = [json.loads(x) for p in (tmp_path / "out").glob("*.idx") for x in p.read_text().splitlines()]
    assert len(side) == 5
