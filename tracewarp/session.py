"""Session settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "tracewarp", cores: int | None = None, shuffle: int = 8) -> SparkSession:
    """A local session with the settings tests and the bench use; on a cluster, use the cluster's own session."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
