"""Tables in the folder that all executors share, which cut lineage so that a lost executor costs no recomputation of it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's checkpoint folder; a local master without either gets a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _paths:
        try:
            delete(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans up
            return


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The same rows reread from a written table, and the table's path, for :func:`delete`."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, what: str) -> DataFrame:
    return stored(df, what)[0]
