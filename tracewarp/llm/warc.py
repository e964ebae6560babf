"""WARC: a normaliser for archives that were gzipped as one stream.

A monolithic ``.warc.gz`` can only be read from its start. The normaliser inflates such a file once, as a stream of
bounded memory, rewrites each record as a gzip member of its own, and writes a sidecar index of the members' offsets,
so that any record can be read alone. A file is the unit of work, as a gzip stream can't be split; files are
independent, and each is written under a temporary name and then renamed, so a task that runs again does no harm.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarp.llm.common import map_arrow, new_path, quoted, release, written

PIECE = 1 << 20
LEVEL, MONOLITHIC_LEVEL = 4, 1
INDEX = "file string, source string, ordinal long, offset long, length long, type string, record_id string, uri string, date string, payload_length long, payload_md5 string"
_INDEX_SCHEMA = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in INDEX.split(", ")])
DAMAGED = "damaged"


#: Compressed bytes of a record that are held back until it is known to be whole; longer ones are written as they come.
HELD = 64 << 20
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark takes it: without a scheme it is of the cluster's default file system, on executors too."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def filesystem(path: str, default: str = "file:///") -> tuple[pafs.FileSystem, str]:
    """The file system of a path and its place there; one without a scheme is of the ``default``."""
    if "://" not in path and not path.startswith("file:"):
        path = default.rstrip("/") + "/" + path.lstrip("/") if not default.startswith("file:") else path
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def inflated(f) -> Iterator[bytes]:
    """Pieces of the content of a gzip file of one member or more; EOFError where it ends early, zlib.error where it is broken."""
    d, begun = zlib.decompressobj(31), False
    while piece := f.read(PIECE):
        while piece:
            if not begun and not (piece := piece.lstrip(b"\0")):  # padding
                break
            begun = True
            out = d.decompress(piece, 4 * PIECE)
            if out:
                yield out
            piece = d.unconsumed_tail
            if d.eof:
                piece, d, begun = d.unused_data, zlib.decompressobj(31), False
    if begun:
        if out := d.flush():
            yield out
        if not d.eof:
            raise EOFError("the stream ends within a member")


class _Reader:
    """Reads lines and bodies from a stream of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.have = pieces, bytearray()

    def more(self) -> bool:
        if (p := next(self.pieces, None)) is None:
            return False
        self.have += p
        return True

    def head(self) -> bytes | None:
        """Bytes to the empty line that ends a record's head, however long, with it; None at the end of the stream."""
        while True:
            skip = len(self.have) - len(self.have.lstrip(b"\r\n"))
            if skip:
                del self.have[:skip]
            if self.have or not self.more():
                break
        if not self.have:
            return None
        at = 0
        while (end := self.have.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(self.have) - 3)
            if not self.more():
                raise ValueError("a record's head doesn't end")
        out = bytes(self.have[: end + 4])
        del self.have[: end + 4]
        return out

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.have and not self.more():
                raise EOFError("the stream ends within a record")
            out = bytes(self.have[:n])
            del self.have[:n]
            n -= len(out)
            yield out


def headers(head: bytes) -> dict[str, str]:
    """Fields by lower-case name; ValueError where it is no WARC head or has no length."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    out = {}
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    if not out.get("content-length", "").isdigit():
        raise ValueError("no Content-Length")
    return out


def _write(out, parts: list[bytes]) -> int:
    for p in parts:
        out.write(p)
    return sum(map(len, parts))


def normalise_stream(f, out) -> Iterator[dict]:
    """Writes each record of the gzip file ``f`` to ``out`` as a member of its own; yields their index entries.

    A record that is cut off or is no WARC record, or a broken stream, ends the file: the records before it are
    written, and the last entry has type ``damaged``, no offset, and the reason as its record_id.
    """
    reader, at, ordinal = _Reader(inflated(f)), 0, 0
    try:
        while head := reader.head():
            h = headers(head)
            digest, z = hashlib.md5(), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            packed, held, n = [z.compress(head)], 0, 0
            try:
                for piece in reader.body(int(h["content-length"])):
                    digest.update(piece)
                    packed.append(z.compress(piece))
                    held += len(packed[-1])
                    if held > HELD:
                        n += _write(out, packed)
                        packed, held = [], 0
            except (EOFError, zlib.error):
                if n:  # a part is written: its member is ended, so that the file can still be read through
                    _write(out, [*packed, z.flush()])
                raise
            n += _write(out, [*packed, z.compress(b"\r\n\r\n"), z.flush()])
            yield {
                "ordinal": ordinal, "offset": at, "length": n, "type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "uri": h.get("warc-target-uri"),
                "date": h.get("warc-date"), "payload_length": int(h["content-length"]), "payload_md5": digest.hexdigest(),
            }
            ordinal, at = ordinal + 1, at + n
    except (ValueError, EOFError, zlib.error) as e:
        yield {"ordinal": ordinal, "type": DAMAGED, "record_id": str(e)}


def normalise(spark: SparkSession, files: DataFrame, out_dir: str, path_col: str = "path") -> DataFrame:
    """Normalises the files named in ``path_col`` into ``out_dir``; the index of all records.

    For each file there is a ``.warc.gz`` of one member a record and, beside it, the ``.idx`` sidecar of JSON lines.
    Null and repeated paths count once or not at all; names in ``out_dir`` come from a hash of the path, so files of
    equal names don't clash. What the stream of a damaged file still gives is kept, see :func:`normalise_stream`; an
    empty file has no records. The index is computed once.
    """
    paths = files.select(quoted(path_col).cast("string").alias("path")).where("path is not null").distinct()
    n = max(1, paths.count())
    out_dir, default = qualified(spark, out_dir), qualified(spark, "/")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, base = filesystem(out_dir)
        to.create_dir(base, recursive=True)
        for b in it:
            for path in b.column(0).to_pylist():
                fs, p = filesystem(path, default)
                name, tmp = hashlib.md5(path.encode()).hexdigest(), uuid.uuid4().hex
                target, entries, chars = f"{out_dir.rstrip('/')}/{name}.warc.gz", [], 0
                with fs.open_input_stream(p, compression=None) as f, to.open_output_stream(f"{base}/.{tmp}.gz", compression=None) as o, to.open_output_stream(f"{base}/.{tmp}.idx") as side:
                    for e in normalise_stream(f, o):
                        e = {"file": target, "source": path} | e
                        side.write(json.dumps(e).encode() + b"\n")
                        entries.append(e)
                        chars += len(e.get("uri") or "")
                        if len(entries) == 10_000 or chars > 32 * PIECE:
                            yield pa.RecordBatch.from_pylist(entries, schema=_INDEX_SCHEMA)
                            entries, chars = [], 0
                to.move(f"{base}/.{tmp}.gz", f"{base}/{name}.warc.gz")
                to.move(f"{base}/.{tmp}.idx", f"{base}/{name}.idx")
                if entries:
                    yield pa.RecordBatch.from_pylist(entries, schema=_INDEX_SCHEMA)

    return written(map_arrow(paths.repartition(n), run, INDEX), "warc-index")


def sidecars(spark: SparkSession, out_dir: str) -> DataFrame:
    """The index as its sidecar files have it."""
    return spark.read.schema(INDEX).option("mode", "FAILFAST").option("maxStringLen", 2**31 - 1).json(f"{out_dir.rstrip('/')}/*.idx")


def read_member(f, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record of an open normalised file."""
    f.seek(offset)
    content = zlib.decompress(f.read(length), 31)
    end = content.index(b"\r\n\r\n") + 4
    h = headers(content[:end])
    return h, content[end : end + int(h["content-length"])]


# Pages as records.


def _record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A response record. What a header can't carry as it is (null, line ends, spaces around) goes into fields of ours."""
    body = (html or "").encode()
    plain = url is not None and url == url.strip() and url.isprintable()
    fields = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        *([("WARC-Target-URI", url)] if plain else []),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(body))),
        ("X-Page", json.dumps([page_id, html is None, *([] if plain else [url])])),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(path) of archives of one gzip stream each, one a task, that hold the pages as records; written once."""
    out_dir = qualified(pages.sparkSession, out_dir)
    src = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).cast("string").alias("url"), quoted(html_col).cast("string").alias("html"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(out_dir)
        name, out = f"{uuid.uuid4().hex}.warc.gz", None
        for b in it:
            for start in range(0, b.num_rows, 500):
                for row in zip(*(c.to_pylist() for c in b.slice(start, 500).columns)):
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        z, out = zlib.compressobj(MONOLITHIC_LEVEL, zlib.DEFLATED, 31), fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(z.compress(_record(*row)))
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{out_dir.rstrip('/')}/{name}"]})

    return written(map_arrow(src, run, "path string"), "warc-files")


def read_pages(index: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_length, payload_md5) of indexed page records, each read at its offset alone."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in it:
            for start in range(0, b.num_rows, 500):
                rows = []
                for e in b.slice(start, 500).to_pylist():
                    if e["file"] != name:
                        name, (fs, p) = e["file"], filesystem(e["file"])
                        f = fs.open_input_file(p)
                    h, body = read_member(f, e["offset"], e["length"])
                    page_id, null, *url = json.loads(h["x-page"])
                    rows.append((page_id, url[0] if url else h["warc-target-uri"], None if null else body.decode(), e["payload_length"], e["payload_md5"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))],
                    ["page_id", "url", "html", "payload_length", "payload_md5"],
                )

    found = index.where(F.col("offset").isNotNull()).select("file", "offset", "length", "payload_length", "payload_md5")
    return map_arrow(found, run, "page_id long, url string, html string, payload_length long, payload_md5 string")


def through_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages after archiving, normalising and reading each record by its sidecar entry: rows as in :func:`read_pages`.

    Every row comes back as it was, nulls, repeats and empty texts included (a null html counts as an empty payload);
    other columns are left out. An empty table gives none. An archive that can't be read to its end is a RuntimeError.
    """
    spark = pages.sparkSession
    mono, out = new_path(spark, "monolithic"), new_path(spark, "warc")
    files = write_monolithic(pages, mono, id_col, url_col, html_col)
    index = normalise(spark, files, out)
    if bad := index.where(F.col("type") == DAMAGED).first():
        raise RuntimeError(f"the archive {bad.source} is damaged at record {bad.ordinal}: {bad.record_id}")
    release(spark, mono)
    return read_pages(sidecars(spark, out)) if index.limit(1).count() else read_pages(index)
