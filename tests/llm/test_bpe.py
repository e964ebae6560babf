from __future__ import annotations

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewarp.llm import bpe as B

PIECES = B.read_ranks(B.VOCABULARY)
CODEC = B.Codec(PIECES, B.serialised_model(PIECES))
TIK = tiktoken.Encoding("t", pat_str=B.PATTERN, mergeable_ranks={b: i for i, b in enumerate(PIECES)}, special_tokens={})
ODD = ["", " ", "\n\n \t x", "don't we'll", "naïve café 北京 🎉👨‍👩‍👧", "½ Ⅷ ² a1b2", "\x00\x01�", "<unk> <|endoftext|> ▁", "a" * 5000, "  two  spaces  "]


def docs(spark, rows):
    return spark.createDataFrame([("s", i, t, 1, "d") for i, t in rows], "__source string, doc_id long, text string, ids int, decoded string")


def test_ids_equal_tiktoken():
    assert CODEC.encode(ODD).to_pylist() == [TIK.encode_ordinary(t) for t in ODD]


@given(st.lists(st.text(), max_size=5))
@settings(max_examples=200, deadline=None)
def test_round_trip_of_any_text(texts):
    ids = CODEC.encode(texts).to_pylist()
    assert ids == [TIK.encode_ordinary(t) for t in texts] and [CODEC.decode(i) for i in ids] == texts


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 3)
    c = B.Codec(PIECES, B.serialised_model(PIECES))
    for _ in range(3):
        assert c.encode(ODD).to_pylist() == CODEC.encode(ODD).to_pylist()


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in B.round_trip(df).collect():
        assert r.decoded == r.text and r.ids == TIK.encode_ordinary(r.text)


def test_edge_cases(spark):
    long = "word und été " * 100_000
    rows = [(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, long)]
    e = B.encode(docs(spark, rows))
    assert e.columns == ["__source", "doc_id", "text", "decoded", "ids"]
    got = {(r.doc_id, r.text): r.ids for r in e.collect()}
    assert e.count() == 6 and got[2, None] is None and got[3, ""] == [] and got[1, "a b"] == TIK.encode_ordinary("a b")
    back = B.decode(e.select("doc_id", "ids"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(rows, key=repr)
    assert B.round_trip(docs(spark, [])).count() == 0
    assert B.encode(docs(spark, rows), out="text").schema["text"].dataType.simpleString() == "array<int>"


def test_decoding_what_no_text_gives():
    assert CODEC.decode([len(PIECES), -1, None]) == "�" * 3
    assert CODEC.decode([PIECES.index(b"\xff")]) == "�" and CODEC.decode(None) is None and CODEC.decode([]) == ""


def test_lists_are_decoded_at_once_as_one_by_one():
    import pyarrow as pa

    ranks = B.read_ranks(B.VOCABULARY)
    codec = B.Codec(ranks, B.serialised_model(ranks))
    byte = {b: i for i, b in enumerate(ranks)}
    good = [[1, 2, 3], [], None, codec.encode(["naïve 東京 🙂 \n\t x"]).to_pylist()[0]]
    for lists in (good, [], [None], [*good, [byte[b"\xe6"]]], [[byte[b"\xf0"]], [byte[b"\x9f"]]], [*good, [len(ranks)]], [[-1, 5]], [[5, None]]):
        got = codec.decode_all(pa.array(lists, pa.list_(pa.int32())))
        assert got.to_pylist() == [codec.decode(x) for x in lists]
    part = pa.array(good, pa.list_(pa.int32())).slice(1)
    assert codec.decode_all(part).to_pylist() == [codec.decode(x) for x in good[1:]]


def test_the_round_trip_makes_no_list_of_a_text(monkeypatch):
    """Ids of ordinary texts are decoded from the array that encoding gives, without a Python object an id."""
    monkeypatch.setattr(B.Codec, "decode", None)
    ranks = B.read_ranks(B.VOCABULARY)
    codec = B.Codec(ranks, B.serialised_model(ranks))
    texts = ["one two", None, "", "drei  vier"]
    assert codec.decode_all(codec.encode(texts)).to_pylist() == texts
