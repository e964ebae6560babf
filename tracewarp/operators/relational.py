"""Filters, projections and aggregates over telemetry rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarp.functions.compare import holds, scaled
from tracewarp.functions.eventtime import tumble_start

#: What a projection always keeps, where the input has it.
KEPT = ("event_time", "service", "ingest_sequence")


@dataclass(frozen=True)
class Predicate:
    """``column op value``, or ``and`` / ``or`` of ``parts``. Null never matches."""

    op: str
    column: str | None = None
    value: object = None
    parts: tuple[Predicate, ...] = ()

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate("and", parts=(self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate("or", parts=(self, other))

    def to_column(self) -> Column:
        if self.op in ("and", "or"):
            a, b = (p.to_column() for p in self.parts)
            return a & b if self.op == "and" else a | b
        c = F.col(self.column)
        test = {"eq": lambda: c == self.value, "contains": lambda: c.contains(self.value), "gt": lambda: c > self.value, "lt": lambda: c < self.value}
        return holds(test[self.op]())


def service_is(name: str) -> Predicate:
    return Predicate("eq", "service", name)


def name_contains(part: str) -> Predicate:
    return Predicate("contains", "name", part)


def value_above(x: float) -> Predicate:
    return Predicate("gt", "value", x)


def value_below(x: float) -> Predicate:
    return Predicate("lt", "value", x)


def select_rows(df: DataFrame, p: Predicate) -> DataFrame:
    return df.where(p.to_column())


def project(df: DataFrame, columns: list[str | tuple[str, str] | tuple[str, str, float]]) -> DataFrame:
    """Columns by name, (name, alias) or (name, alias, factor); the columns in ``KEPT`` stay in any case."""
    out, names = [], set()
    for c in columns:
        name, alias, *factor = (c, c) if isinstance(c, str) else c
        out.append((scaled(F.col(name), factor[0]) if factor else F.col(name)).alias(alias))
        names.add(alias)
    return df.select(*(c for c in KEPT if c in df.columns and c not in names), *out)


def aggregate(df: DataFrame, keys: list[str], value: str, kinds: list[str], window_ns: int | None = None) -> DataFrame:
    """One row per combination of keys (and tumbling window of ``event_time``).

    ``count`` counts values, ``sum`` is 0 without any; null values are skipped, null keys are a group of their own.
    """
    v = F.col(value).cast("double")
    make = {"count": F.count(v), "sum": F.coalesce(F.sum(v), F.lit(0.0)), "min": F.min(v), "max": F.max(v), "avg": F.avg(v)}
    by = [F.col(k) for k in keys] + ([tumble_start(F.col("event_time"), window_ns).alias("window_start")] if window_ns else [])
    return df.groupBy(*by).agg(*(make[k].alias(f"{k}_{value}") for k in kinds))


def top_rows(df: DataFrame, order: list[tuple[str, bool]], n: int, tie: list[str]) -> DataFrame:
    """The first n rows by (column, descending) and then by ``tie``, which makes the choice unique."""
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order]
    return df.orderBy(*keys, *tie).limit(n)
