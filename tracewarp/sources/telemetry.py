"""Telemetry views over the driver's star-schema tables.

The tables hold no telemetry, so each signal is a fixed projection: metrics, logs and changes come from
``events``; spans come from ``lineitem`` joined to ``orders``. The same projections are spelled as SQL in
:data:`VIEW_SQL` for the oracle, so both sides start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000
DAY_NS = 24 * HOUR_NS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_ns(col: str = "ts") -> F.Column:
    return F.unix_micros(F.col(col).cast("timestamp")) * F.lit(1000)


def _service() -> F.Column:
    return F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_time (ns), service, name, value: one sample per event."""
    return metrics_of(table(spark, sf_dir, "events"))


def metrics_of(events: DataFrame) -> DataFrame:
    name = (
        F.when(F.col("event_type") == "click", "latency_ms")
        .when(F.col("event_type") == "view", "mem_ratio")
        .when(F.col("event_type") == "error", "error_rate")
        .when(F.col("event_type") == "purchase", "cpu_ratio")
        .otherwise("queue_depth")
    )
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        _event_ns().alias("event_time"),
        _service().alias("service"),
        name.alias("name"),
        F.col("value"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups stand for deployments: one change per event."""
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "signup")
        .select(
            F.col("event_id").cast("string").alias("event_id"),
            _event_ns().alias("event_time"),
            _service().alias("service"),
            F.concat(F.lit("chg-"), F.col("event_id").cast("string")).alias("change_id"),
            F.when(F.col("event_id") % 3 == 0, "featureflag").otherwise("deployment").alias("change_type"),
            F.concat(F.lit("v"), (F.col("event_id") % 10).cast("string")).alias("version_after"),
        )
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and purchases as log lines; the body is the event's JSON."""
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin("error", "purchase"))
        .select(
            F.col("event_id").cast("string").alias("event_id"),
            _event_ns().alias("event_time"),
            _service().alias("service"),
            F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"),
            F.col("props").alias("body"),
        )
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace per order: line 1 is the root, line n > 1 a child of line n // 2.

    Services are in three layers by line (0-1, 2-4, 5-7). Of the deepest layer some spans name a peer: a database, or
    svc-2, which closes cycles in the graph. Some spans name a parent that isn't there.
    """
    line, order = F.col("l_linenumber").cast("long"), F.col("l_orderkey")
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    # The data may repeat (order, line); the row with the smallest part and supplier stands for it.
    ids = ["l_orderkey", "l_linenumber"]
    first = items.groupBy(*ids).agg(
        F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")).alias("r")
    )
    joined = first.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    start = _event_ns("o_orderdate") + (line - 1) * F.lit(5_000_000)
    duration = (F.col("r.l_quantity").cast("long") + F.lit(1)) * F.lit(4_000_000)
    part, supplier = F.col("r.l_partkey"), F.col("r.l_suppkey")
    number = F.when(line == 1, supplier % 2).when(line <= 3, 2 + supplier % 3).otherwise(5 + supplier % 3)
    parent = F.when(part % 11 == 0, F.lit("99")).otherwise(F.expr("cast(cast(l_linenumber as bigint) div 2 as string)"))
    peer = F.when((line >= 4) & (part % 7 == 0), "svc-2").when((line >= 4) & (part % 7 == 1), F.concat(F.lit("db-"), (supplier % 2).cast("string")))
    return joined.select(
        F.concat(F.lit("t"), order.cast("string")).alias("trace_id"),
        F.concat(F.lit("t"), order.cast("string"), F.lit("-"), line.cast("string")).alias("span_id"),
        F.when(line > 1, F.concat(F.lit("t"), order.cast("string"), F.lit("-"), parent)).alias("parent_span_id"),
        F.concat(F.lit("svc-"), number.cast("string")).alias("service"),
        F.concat(F.lit("op-"), (part % 5).cast("string")).alias("operation"),
        start.alias("start_time_ns"),
        (start + duration).alias("end_time_ns"),
        duration.alias("duration_ns"),
        F.when(F.col("r.l_returnflag") == "R", "error").otherwise("ok").alias("status"),
        peer.alias("peer_service"),
    )


#: The same projections as DuckDB common table expressions.
VIEW_SQL = {
    "metrics": """metrics AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) * 1000 AS event_time,
         'svc-' || CAST(user_id % 8 AS VARCHAR) AS service,
         CASE event_type WHEN 'click' THEN 'latency_ms' WHEN 'view' THEN 'mem_ratio' WHEN 'error' THEN 'error_rate'
              WHEN 'purchase' THEN 'cpu_ratio' ELSE 'queue_depth' END AS name, value
  FROM events)""",
    "changes": """changes AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) * 1000 AS event_time,
         'svc-' || CAST(user_id % 8 AS VARCHAR) AS service, 'chg-' || CAST(event_id AS VARCHAR) AS change_id,
         CASE WHEN event_id % 3 = 0 THEN 'featureflag' ELSE 'deployment' END AS change_type,
         'v' || CAST(event_id % 10 AS VARCHAR) AS version_after
  FROM events WHERE event_type = 'signup')""",
    "logs": """logs AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) * 1000 AS event_time,
         'svc-' || CAST(user_id % 8 AS VARCHAR) AS service,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, props AS body
  FROM events WHERE event_type IN ('error', 'purchase'))""",
    "spans": """first_items AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                            ORDER BY l_partkey, l_suppkey, l_quantity, l_returnflag) AS rn
  FROM lineitem),
spans AS (
  SELECT 't' || CAST(l_orderkey AS VARCHAR) AS trace_id,
         't' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS span_id,
         CASE WHEN l_linenumber > 1 THEN 't' || CAST(l_orderkey AS VARCHAR) || '-'
              || CASE WHEN l_partkey % 11 = 0 THEN '99' ELSE CAST(CAST(l_linenumber AS BIGINT) // 2 AS VARCHAR) END END AS parent_span_id,
         'svc-' || CAST(CASE WHEN l_linenumber = 1 THEN l_suppkey % 2 WHEN l_linenumber <= 3 THEN 2 + l_suppkey % 3 ELSE 5 + l_suppkey % 3 END AS VARCHAR) AS service,
         'op-' || CAST(l_partkey % 5 AS VARCHAR) AS operation,
         epoch_us(o_orderdate) * 1000 + (CAST(l_linenumber AS BIGINT) - 1) * 5000000 AS start_time_ns,
         epoch_us(o_orderdate) * 1000 + (CAST(l_linenumber AS BIGINT) - 1) * 5000000
           + (CAST(l_quantity AS BIGINT) + 1) * 4000000 AS end_time_ns,
         (CAST(l_quantity AS BIGINT) + 1) * 4000000 AS duration_ns,
         CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'ok' END AS status,
         CASE WHEN l_linenumber >= 4 AND l_partkey % 7 = 0 THEN 'svc-2'
              WHEN l_linenumber >= 4 AND l_partkey % 7 = 1 THEN 'db-' || CAST(l_suppkey % 2 AS VARCHAR) END AS peer_service
  FROM first_items JOIN orders ON l_orderkey = o_orderkey WHERE rn = 1)""",
}


def with_views(names: str, body: str) -> str:
    """Oracle SQL: the named views as common table expressions, then ``body`` (which may add more)."""
    return "WITH RECURSIVE " + ",\n".join(VIEW_SQL[n] for n in names.split()) + body
