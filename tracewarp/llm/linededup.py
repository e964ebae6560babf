"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference tables.

An index is a set of tables, of which each change adds its own part and none is rewritten by it:

* ``refs``: the exact reference table, a row per (line, document), sorted by shard of the line's 128-bit hash; the number
  of a line's rows is its count, and the first by batch, document and place in the text keeps the line;
* ``lines``: the same by document, as the texts had them, so that a document's lines are found without the others;
* ``gone``: the documents that were deleted, which takes out their references of earlier batches;
* ``filters``: a cuckoo filter of the lines present, a blob per shard, rewritten only for the shards a change touches.

Inserting a batch of documents asks the filters which of its lines may be known; only those are looked up in the
reference table, in the shards that they are in. Known lines go from the batch, and of lines repeated within it the first
stays, in the order of document id and position. Deleting documents drops their references, and takes lines left without
any out of the filters, so a batch inserted and deleted leaves the index as it was. A line whose keeper goes passes to
its next holder, which gets it back. After ``COMPACT_AT`` changes, and when lines have become too many for the shards,
the parts are put together. Each change ends with a mark that lists the parts; an index is opened at its last marked
version, so a change that was cut short didn't happen.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracewarp.llm.common import map_arrow, new_path, quoted, release, unused, written
from tracewarp.llm.cuckoo import Cuckoo, CuckooFull

#: Lines of a shard on average, and the least number of shards, a power of two. An index with more than twice as many
#: lines a shard takes more shards when it is next compacted.
SHARD_LINES, LEAST_SHARDS = 1 << 18, 16
#: Changes after which the parts are put together.
COMPACT_AT = 16
#: Most ids or shards that are named in a filter of a scan; beyond, the scan reads the range between the least and the largest.
NAMED = 1000
_LAST_ID = 2**63 - 1


def _identity(id_col: str, text_col: str) -> tuple[F.Column, F.Column]:
    """What tells documents apart: the id, last of all where null, and a hash of the text."""
    return F.coalesce(quoted(id_col).cast("long"), F.lit(_LAST_ID)), F.xxhash64(quoted(text_col))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, doc, th, pos) of each line that isn't blank; spaces around a line don't count."""
    doc, th = _identity(id_col, text_col)
    src = docs.select(doc.alias("doc"), th.alias("th"), F.posexplode(F.split(quoted(text_col), "\n")).alias("pos", "line"))
    line = F.trim("line")
    return src.where(line != "").select(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), "doc", "th", "pos")


def _by_shard(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """(shard, newest filter or nothing, keys by op) of a partition sorted by shard; one shard is in memory at a time.

    Rows are (shard, h1, h2, op, version, filter): a key, or a filter of a version.
    """
    shard, blob, newest, keys = None, [], -1, {}

    def done():
        both = {op: tuple(np.concatenate(c) for c in zip(*parts)) for op, parts in keys.items()}
        none = np.zeros(0, np.int64)
        return int(shard), blob, {op: both.get(op, (none, none)) for op in (-1, 0, 1)}

    for b in it:
        at = b.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(at)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(at)]):
            if end == start:
                continue
            if shard is not None and at[start] != shard:
                yield done()
                blob, newest, keys = [], -1, {}
            shard, part = at[start], b.slice(start, end - start)
            op, h1, h2 = (part.column(i).to_numpy(zero_copy_only=False) for i in (3, 1, 2))
            for k in np.unique(op):
                if k == 9:
                    for v, f in zip(part.column(4).to_pylist(), part.column(5).to_pylist()):
                        if f is not None and v > newest:
                            blob, newest = [f], v
                else:
                    keys.setdefault(int(k), []).append((h1[op == k], h2[op == k]))
    if shard is not None:
        yield done()


def _change(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filters of the shards that keys are deleted from (op -1) or inserted into (1); null where they don't fit."""
    for shard, blob, keys in _by_shard(it):
        if not len(keys[-1][0]) and not len(keys[1][0]):
            continue
        f = Cuckoo.load(blob[0]) if blob else Cuckoo.sized(len(keys[1][0]))
        f.delete(*keys[-1])
        try:
            if f.room() < len(keys[1][0]):
                raise CuckooFull
            f.insert(*keys[1])
            out = f.dump()
        except CuckooFull:
            out = None
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "filter": pa.array([out], pa.binary())})


def _build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters of twice the size that distinct keys (op 0) need."""
    for shard, _, keys in _by_shard(it):
        f = Cuckoo.sized(2 * len(keys[0][0]))
        f.insert(*keys[0])
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "filter": pa.array([f.dump()], pa.binary())})


def _ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, blob, keys in _by_shard(it):
        h1, h2 = keys[0]
        if blob and len(h1):
            hit = Cuckoo.load(blob[0]).contains(h1, h2)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(int(hit.sum()), shard, np.int32)), "h1": h1[hit], "h2": h2[hit]})


@F.pandas_udf(StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    def cut(t, g):
        if t is None:
            return None
        g = set(g)
        return "\n".join([x for i, x in enumerate(t.split("\n")) if i not in g])

    return pd.Series([cut(t, g) for t, g in zip(text, gone)], dtype=object)


#: Not deterministic by name alone, so that the plan computes it once and not in a filter too.
_without = _without.asNondeterministic()


class LineIndex:
    """The lines of the documents inserted so far. ``path`` is a folder all executors share; by default a new one."""

    REFS = "shard int, h1 long, h2 long, doc long, batch int, th long, pos int"
    LINES = "h1 long, h2 long, doc long, th long, pos int, batch int"
    GONE = "doc long, batch int"
    FILTERS = "shard int, filter binary, version int"
    RESTORED = "doc_id long, text_hash long, pos int"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "line-index")
        self.version = max(self._versions(), default=0)
        self.parts = {"shards": LEAST_SHARDS, "keys": 0, "refs": [], "lines": [], "gone": [], "filters": []}
        if self.version:
            self.parts = json.loads(spark.read.text(f"{self.path}/marks/{self.version}").first()[0])

    def _versions(self) -> list[int]:
        of = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        p = of(f"{self.path}/marks")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [int(x.getName()) for x in found if fs.exists(of(x, "_SUCCESS"))]

    def _read(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{what}/{v}" for v in self.parts[what]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _put(self, what: str, df: DataFrame) -> None:
        """The next version's part of a table; it counts when :meth:`_mark` has listed it."""
        df.write.mode("overwrite").parquet(f"{self.path}/{what}/{self.version + 1}")

    def _mark(self, parts: dict) -> None:
        v = self.version + 1
        self.spark.createDataFrame([(json.dumps(parts),)], "m string").coalesce(1).write.mode("overwrite").text(f"{self.path}/marks/{v}")
        self.version, self.parts = v, parts

    def _live(self, df: DataFrame) -> DataFrame:
        """Rows of (doc, batch, ...) whose document wasn't deleted after their batch."""
        if not self.parts["gone"]:
            return df
        gone = self._read("gone", self.GONE).groupBy(F.col("doc").alias("__d")).agg(F.max("batch").alias("__b"))
        return df.join(gone, (F.col("doc") == F.col("__d")) & (F.col("batch") < F.col("__b")), "left_anti")

    @staticmethod
    def _some(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
        """``df`` without files and pages that can't hold a value of ``wanted``, which the scan tells by their statistics."""
        found = [r[0] for r in wanted.select(column).distinct().limit(NAMED + 1).collect()]
        if len(found) <= NAMED:
            return df.where(F.col(column).isin(found) if found else F.lit(False))
        ends = wanted.agg(F.min(column), F.max(column)).first()
        return df.where(F.col(column).between(ends[0], ends[1]))

    def refs(self) -> DataFrame:
        """(shard, h1, h2, doc, batch, th, pos): which documents hold which lines, and where first."""
        return self._live(self._read("refs", self.REFS))

    def filters(self) -> DataFrame:
        """(shard, filter): the newest of each shard."""
        return self._read("filters", self.FILTERS).groupBy("shard").agg(F.max_by("filter", "version").alias("filter"))

    def counts(self) -> DataFrame:
        """(h1, h2, count): the exact reference counts."""
        return self.refs().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("count"))

    def _shard(self, n: int | None = None) -> F.Column:
        return F.pmod("h1", F.lit(n or self.parts["shards"])).cast("int")

    def _tasks(self) -> int:
        return min(self.parts["shards"], max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.parts["shards"] // 16))

    def _placed(self, keys: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
        """Keys (shard, h1, h2, op) and filters of their shards, sorted by shard."""
        none = F.lit(None).cast("binary").alias("filter")
        rows = keys.select("shard", "h1", "h2", F.col("op").cast("int").alias("op"), F.lit(0).alias("version"), none)
        if blobs is not None:
            zero = F.lit(0).cast("long")
            rows = rows.unionByName(blobs.select("shard", zero.alias("h1"), zero.alias("h2"), F.lit(9).alias("op"), "version", "filter"))
        return rows.repartition(self._tasks(), "shard").sortWithinPartitions("shard")

    def _by_line(self, refs: DataFrame) -> DataFrame:
        """References as they are written: neighbouring shards together, sorted, so that scans can pass others over."""
        return refs.repartition(self._tasks(), self._block()).sortWithinPartitions("shard", "h1", "h2")

    def _block(self) -> F.Column:
        return F.expr(f"(shard * {self._tasks()}L) div {self.parts['shards']}")

    def _changed(self, keys: DataFrame, fresh: DataFrame | None = None) -> list[int]:
        """Writes the filters of the shards of ``keys`` (shard, h1, h2, op) and gives the versions that there are then.

        Filters that are full are built anew, of the exact keys of their shards; ``fresh`` are references to come.
        """
        blobs = self._some(self._read("filters", self.FILTERS), "shard", keys) if self.parts["filters"] else None
        done = written(map_arrow(self._placed(keys, blobs), _change, "shard int, filter binary"), "filters")
        full = done.where("filter is null").select("shard")
        if full.limit(1).count():
            old = self._some(self.refs(), "shard", full).join(full, "shard", "left_semi").select("shard", "h1", "h2")
            new = fresh.join(full, "shard", "left_semi").select("shard", "h1", "h2") if fresh is not None else None
            all_ = (old.unionByName(new) if new is not None else old).distinct().withColumn("op", F.lit(0))
            done = done.where("filter is not null").unionByName(map_arrow(self._placed(all_), _build, "shard int, filter binary"))
        self._put("filters", done.withColumn("version", F.lit(self.version + 1)))
        return [*self.parts["filters"], self.version + 1]

    def known(self, keys: DataFrame) -> DataFrame:
        """Those of the distinct (shard, h1, h2) that are in the index: the filters' answer, made exact by the references."""
        if not self.parts["refs"]:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        blobs = self._some(self._read("filters", self.FILTERS), "shard", keys)
        maybe = written(map_arrow(self._placed(keys.withColumn("op", F.lit(0)), blobs), _ask, "shard int, h1 long, h2 long"), "maybe")
        return maybe.select("h1", "h2").join(self._some(self.refs(), "shard", maybe).select("h1", "h2"), ["h1", "h2"], "left_semi")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds a batch; returns its documents, without the lines that the index held or that came earlier in the batch.

        Columns stay as they are, but for the text. A document that had lines and lost them all goes; one whose text
        is null, empty or blank stays as it is. Blank lines always stay. Rows that repeat id and text are one document
        and are treated alike; of rows that share an id but not the text the order is that of a hash of the text.
        Documents with a null id come last and can't be deleted. An empty batch changes nothing. What is read and
        written follows the batch and the shards that its lines are in, not the index.
        """
        batch = F.lit(self.version + 1)
        self._put("lines", lines_of(docs, id_col, text_col).withColumn("batch", batch))
        occ = self.spark.read.schema(self.LINES).parquet(f"{self.path}/lines/{self.version + 1}").drop("batch")
        keys = written(occ.groupBy("h1", "h2").agg(F.min(F.struct("doc", "th", "pos")).alias("first"), F.count(F.lit(1)).alias("n")), "keys")
        n = keys.count()
        if not self.parts["refs"]:
            self.parts["shards"] = _shards_for(n)
        keys = keys.withColumn("shard", self._shard())
        known = written(self.known(keys.select("shard", "h1", "h2")).withColumn("known", F.lit(True)), "known") if self.parts["refs"] and n else None
        keys = keys.withColumn("known", F.lit(False)) if known is None else keys.join(known, ["h1", "h2"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
        if known is not None:
            keys = written(keys, "keys")
        repeated = keys.where("known or n > 1").select("h1", "h2", "first", "known")
        gone = (
            occ.join(repeated, ["h1", "h2"])
            .where(F.col("known") | (F.struct("doc", "th", "pos") != F.col("first")))
            .groupBy("doc", "th")
            .agg(F.collect_set("pos").alias("gone"))
            .select("doc", "th", "gone")
        )
        if not n:
            return self._apply(docs, written(gone, "gone"), id_col, text_col)
        # Placed as they are written, so bringing a document's repeats of a line together takes no shuffle of its own.
        placed = occ.withColumn("shard", self._shard()).withColumn("block", self._block()).repartition(self._tasks(), "block")
        fresh = placed.groupBy("block", "shard", "h1", "h2", "doc").agg(F.min(F.struct("th", "pos")).alias("at"))
        fresh = fresh.select("shard", "h1", "h2", "doc", batch.alias("batch"), "at.th", "at.pos")
        if known is not None:
            # Only a document that comes again holds lines already: those of the known ones that it has.
            held = self._some(self.refs(), "shard", known.withColumn("shard", self._shard())).select("h1", "h2", "doc").join(known.select("h1", "h2"), ["h1", "h2"], "left_semi")
            held = written(held.join(occ.select("doc").distinct(), "doc", "left_semi"), "held")
            fresh = fresh.join(held, ["h1", "h2", "doc"], "left_anti").select(*(c.split()[0] for c in self.REFS.split(", "))) if held.limit(1).count() else fresh
        self._put("refs", fresh.sortWithinPartitions("shard", "h1", "h2"))
        fresh = self.spark.read.schema(self.REFS).parquet(f"{self.path}/refs/{self.version + 1}")
        filters = self._changed(keys.where("not known").select("shard", "h1", "h2", F.lit(1).alias("op")), fresh)
        # Written, as the parts it is made of may be put together before the result is read.
        gone = written(gone, "gone")
        v, p = self.version + 1, self.parts
        self._mark(p | {"keys": p["keys"] + (n if known is None else keys.where("not known").count()), "refs": [*p["refs"], v], "lines": [*p["lines"], v], "filters": filters})
        self._tidy()
        return self._apply(docs, gone, id_col, text_col)

    @staticmethod
    def _apply(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
        doc, th = _identity(id_col, text_col)
        d, h, g = (unused(docs.columns, n) for n in ("__doc", "__th", "__gone"))
        # Joined by a shuffle at every size: the lists grow with the documents, and so would a broadcast of them.
        j = docs.join(gone.toDF(d, h, g).hint("merge"), (doc == F.col(d)) & (th == F.col(h)), "left")
        some = F.col(g).isNotNull()
        cut = _without(F.when(some, quoted(text_col)), F.coalesce(F.col(g), F.array().cast("array<int>")))
        j = j.withColumn(text_col, F.when(some, cut).otherwise(quoted(text_col)))
        return j.where(~some | quoted(text_col).rlike(r"[^ \n]")).select(*map(quoted, docs.columns))

    @staticmethod
    def _keepers(refs: DataFrame) -> DataFrame:
        """(h1, h2, keeper): of each line the reference that keeps it."""
        return refs.groupBy("h1", "h2").agg(F.min(F.struct("batch", "doc", "th", "pos")).alias("keeper"))

    def texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The texts that documents of the index have in it now, of their original ones: as :meth:`insert` returns them."""
        lines = lines_of(docs, id_col, text_col)
        held = self._some(self.refs(), "shard", lines.select(self._shard().alias("shard"))).join(lines.select("h1", "h2"), ["h1", "h2"], "left_semi")
        keeps = self._keepers(held).select("h1", "h2", "keeper.doc", "keeper.th", "keeper.pos")
        gone = lines.join(keeps, ["h1", "h2", "doc", "th", "pos"], "left_anti")
        return self._apply(docs, gone.groupBy("doc", "th").agg(F.collect_set("pos").alias("gone")), id_col, text_col)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """Takes documents out, by id: their references, and lines left without any from the filters. Unknown and null ids are no matter.

        Lines that they kept pass to their next holders. Returns (doc_id, text_hash, pos) of these: the documents, by id
        and the xxhash64 of their texts, that get back the line at ``pos`` of their original texts; :meth:`texts` does
        it. Only the lines of these documents are looked at, and the other holders of these lines.
        """
        gone = written(ids.select(quoted(id_col).cast("long").alias("doc")).where(f"doc is not null and doc != {_LAST_ID}").distinct(), "gone")
        lines = self._live(self._some(self._read("lines", self.LINES), "doc", gone)).join(gone, "doc", "left_semi")
        hit = written(lines.select(self._shard().alias("shard"), "h1", "h2").distinct(), "hit")
        if not hit.limit(1).count():
            return self.spark.createDataFrame([], self.RESTORED)
        refs = written(self._some(self.refs(), "shard", hit).join(hit.select("h1", "h2"), ["h1", "h2"], "left_semi"), "held")
        left = refs.join(gone, "doc", "left_anti")
        lost = written(hit.join(left.select("h1", "h2"), ["h1", "h2"], "left_anti").select("shard", "h1", "h2", F.lit(-1).alias("op")), "lost")
        passed = self._keepers(refs).join(gone, F.col("keeper.doc") == gone["doc"], "left_semi").select("h1", "h2")
        heirs = self._keepers(left).join(passed, ["h1", "h2"]).select("keeper.*")
        restored = written(heirs.select(F.when(F.col("doc") != _LAST_ID, F.col("doc")).alias("doc_id"), F.col("th").alias("text_hash"), "pos"), "restored")
        v, p = self.version + 1, self.parts
        self._put("gone", gone.withColumn("batch", F.lit(v)))
        filters = self._changed(lost)
        self._mark(p | {"keys": p["keys"] - lost.count(), "gone": [*p["gone"], v], "filters": filters})
        self._tidy()
        return restored

    def _tidy(self) -> None:
        p = self.parts
        if len(p["refs"]) + len(p["gone"]) > COMPACT_AT or p["keys"] > 2 * SHARD_LINES * p["shards"]:
            self.compact()

    def compact(self) -> None:
        """Puts the parts together, without deleted documents, in as many shards as the lines need, and deletes the old ones."""
        old, p = dict(self.parts), self.parts
        n = max(p["shards"], _shards_for(p["keys"]))
        refs, lines = self.refs().withColumn("shard", self._shard(n)), self._live(self._read("lines", self.LINES))
        blobs = self._read("filters", self.FILTERS)
        self.parts = p | {"shards": n}
        self._put("refs", self._by_line(refs))
        self._put("lines", lines)
        v = self.version + 1
        if n == p["shards"]:
            self._put("filters", blobs.groupBy("shard").agg(F.max_by("filter", "version").alias("filter"), F.max("version").alias("version")))
        else:
            keys = self.spark.read.schema(self.REFS).parquet(f"{self.path}/refs/{v}").select("shard", "h1", "h2").distinct().withColumn("op", F.lit(0))
            self._put("filters", map_arrow(self._placed(keys), _build, "shard int, filter binary").withColumn("version", F.lit(v)))
        self._mark({"shards": n, "keys": p["keys"], "refs": [v], "lines": [v], "gone": [], "filters": [v]})
        for what in ("refs", "lines", "gone", "filters"):
            for version in old[what]:
                release(self.spark, f"{self.path}/{what}/{version}")


def _shards_for(lines: int) -> int:
    n = LEAST_SHARDS
    while lines > SHARD_LINES * n:
        n *= 2
    return n


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:meth:`LineIndex.insert` of all documents into a new index."""
    return LineIndex(docs.sparkSession).insert(docs, id_col, text_col)


def deduped_in_batches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as :func:`deduped` gives them, by an index that grows, shrinks and grows again.

    Batches follow the order of ids: the lower half of the range of ids, the next seven sixteenths, and the last
    sixteenth, which is inserted, deleted and inserted again; documents without an id come last.
    """
    index, key = LineIndex(docs.sparkSession), quoted(id_col).cast("long")
    low, high = docs.agg(F.min(key), F.max(key)).first()
    out = []
    if low is not None:
        half, last = low + (high - low) // 2, low + (high - low) * 15 // 16
        newest = docs.where(key > last)
        out = [index.insert(b, id_col, text_col) for b in (docs.where(key <= half), docs.where((key > half) & (key <= last)))]
        index.insert(newest, id_col, text_col)
        index.delete(newest.select(quoted(id_col).alias("id")), "id")
        out.append(index.insert(newest, id_col, text_col))
    nameless = docs.where(key.isNull())
    if not out or nameless.limit(1).count():
        out.append(index.insert(nameless, id_col, text_col))
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result
