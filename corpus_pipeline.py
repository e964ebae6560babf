"""A training corpus from ``documents``: each stage works on all that its predecessor kept.

Quality classifier (documents that it rejects go), line dedup, SimHash near-dedup (one document of each group stays),
mixing sources to target weights (documents become as many rows as they have copies), byte-level BPE.

All stages but the last return the columns of their input. A stage's documents may have nulls in any column and any
further columns; what becomes of such rows is said where the stage's operator is defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarp.llm import bpe, linededup, mixing, quality, simhash
from tracewarp.llm.common import quoted, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on ``labels`` keeps; a column ``score`` of the documents stays as it is."""
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(*(quoted(c).alias(f"_{i}") for i, c in enumerate(docs.columns)))
    at = docs.columns.index("text")
    kept = quality.scored(rows, weights, f"_{at}").where(F.col("score") >= quality.THRESHOLD)
    return kept.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before; ``n_chars`` follows the text."""
    out = linededup.deduped(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; documents without an id or a word all stay.

    Near copies are told by the texts that line dedup left: one of which only the changed lines are left is no longer
    near to its original.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as it has copies, by the tempered shares of sources and languages; one of no copies goes."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, ids, decoded): a row for each row, the text as ids, and the text that the ids give."""
    return bpe.round_trip(docs.select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", "ids", "decoded")


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier's sequential updates, SimHash and BPE can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
