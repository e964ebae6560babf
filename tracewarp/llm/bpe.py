"""Byte-level BPE by a sentencepiece model serialised straight from a rank vocabulary.

Each byte string of the vocabulary becomes a piece whose characters stand for its bytes, scored by its negative rank,
under an identity normaliser; piece ids are the ranks. Texts are cut into pre-tokens, each distinct pre-token of a
chunk is encoded once, and decoding joins the byte strings of the ids. Nothing is trained and nothing is shuffled:
encoding is one narrow pass, with the serialised model (its size is the vocabulary's) in the task's closure.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2

from tracewarp.llm.common import map_arrow, quoted, text_chunks, unused

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are cut into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a chunk, and pre-tokens that a worker remembers.
CHUNK, REMEMBERED = 1_000_000, 150_000
UNKNOWN = "�".encode()


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


CHARACTERS = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})


def read_ranks(path: str) -> list[bytes]:
    """Byte strings in order of rank from lines of "base64 rank"; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(r): base64.b64decode(b) for b, r in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def serialised_model(vocabulary: list[bytes]) -> bytes:
    """The vocabulary as a sentencepiece BPE model; the piece after the last rank is the obligatory unknown one."""
    m = sentencepiece_model_pb2.ModelProto()
    for rank, b in enumerate(vocabulary):
        p = m.pieces.add()
        p.piece, p.score, p.type = b.decode("latin-1").translate(CHARACTERS), -float(rank), p.NORMAL
    p = m.pieces.add()
    p.piece, p.score, p.type = "<unk>", 0.0, p.UNKNOWN
    t, n = m.trainer_spec, m.normalizer_spec
    t.model_type, t.vocab_size, t.unk_id, t.bos_id, t.eos_id, t.pad_id = t.BPE, len(m.pieces), len(vocabulary), -1, -1, -1
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return m.SerializeToString()


class Codec:
    """Encodes and decodes within one worker."""

    def __init__(self, vocabulary: list[bytes], model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(PATTERN).findall
        self.bytes = vocabulary
        self.pieces = pa.array(vocabulary, pa.binary())
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """Lists of ids; null for null."""
        if len(self.index) > REMEMBERED:
            self._forget()
        index, known, flat, ends = self.index, len(self.index), [], np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                flat.extend([index[p] for p in self.cut(t)])
            ends[i + 1] = len(flat)
        if len(index) > known:
            new = [p.encode().decode("latin-1").translate(CHARACTERS) for p in list(index)[known:]]
            got = self.model.encode(new, num_threads=1)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(g) for g in got])])
            self.ids = np.concatenate([self.ids, np.array([i for g in got for i in g], np.int32)])
        at = np.array(flat, np.int64)
        n = self.starts[at + 1] - self.starts[at] if len(at) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(self.starts[at] - total[:-1], n) + np.arange(total[-1])
        null = np.array([t is None for t in texts] + [False])
        return pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32), mask=null), pa.array(self.ids[where]))

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of ids; bytes that are no UTF-8, and ids outside the vocabulary or null, become U+FFFD."""
        if ids is None:
            return None
        b, n = self.bytes, len(self.bytes)
        try:
            joined = b"".join([b[i] for i in ids]) if not ids or min(ids) >= 0 else None
        except (IndexError, TypeError):
            joined = None
        if joined is None:
            joined = b"".join([b[i] if i is not None and 0 <= i < n else UNKNOWN for i in ids])
        return joined.decode("utf-8", "replace")


    def decode_all(self, ids: pa.ListArray) -> pa.StringArray:
        """:meth:`decode` of each list; of all at once, unless ids are outside the vocabulary or null, or bytes no UTF-8."""
        try:
            joined, at = self.pieces.take(ids.values), ids.offsets.to_numpy()
            if not joined.null_count:
                ends = np.frombuffer(joined.buffers()[1], np.int32)[at]
                out = pa.StringArray.from_buffers(len(ids), pa.py_buffer(ends), joined.buffers()[2], pa.array(np.packbits(ids.is_valid().to_numpy(zero_copy_only=False), bitorder="little")).buffers()[1])
                out.validate(full=True)
                return out
        except pa.ArrowException:
            pass
        return pa.array([self.decode(x) for x in ids.to_pylist()], pa.string())


def _with(docs: DataFrame, source: str, out: dict, vocabulary: str, make) -> DataFrame:
    """The documents with the columns ``out`` (replacing those of these names) that ``make(codec, values)`` gives."""
    pieces = read_ranks(vocabulary)
    model = serialised_model(pieces)
    keep = [c for c in docs.columns if c not in out]
    src = docs.select(*map(quoted, keep), quoted(source).alias(unused(keep, "__source")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces, model)
        for b in it:
            k = b.num_columns - 1
            chunks = text_chunks(b, k, CHUNK) if pa.types.is_string(b.column(k).type) else ((i, b.column(k).slice(i, 500).to_pylist()) for i in range(0, b.num_rows, 500))
            for at, values in chunks:
                part = b.slice(at, len(values))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(codec, values)], [*keep, *out])

    schema = StructType([*(src.schema[c] for c in keep), *(StructField(n, t) for n, t in out.items())])
    return map_arrow(src, run, schema)


def encode(docs: DataFrame, text_col: str = "text", out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with ``out``, the ids of the whole text: null for null, an empty list for an empty text.

    ``out`` replaces a column of that name; the others stay. The text column may be replaced by its ids.
    """
    return _with(docs, text_col, {out: ArrayType(IntegerType(), False)}, vocabulary, lambda c, v: [c.encode(v)])


def decode(docs: DataFrame, ids_col: str = "ids", out: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with ``out``, the text of the ids: null for null; see :meth:`Codec.decode` for ids that fit no text."""
    return _with(docs, ids_col, {out: StringType()}, vocabulary, lambda c, v: [pa.array([c.decode(x) for x in v], pa.string())])


def round_trip(docs: DataFrame, text_col: str = "text", ids_out: str = "ids", text_out: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """:func:`encode` and, from the ids alone, :func:`decode`, in one pass over the documents."""

    def make(codec: Codec, texts):
        ids = codec.encode(texts)
        return [ids, codec.decode_all(ids)]

    out = {ids_out: ArrayType(IntegerType(), False), text_out: StringType()}
    return _with(docs, text_col, out, vocabulary, make)
