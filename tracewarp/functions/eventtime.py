"""Event-time bucket expressions on integer nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_NS = {"ns": 1, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000}


def tumble_start(t: Column, size_ns: int) -> Column:
    """Start of the tumbling window that holds ``t``; floors toward minus infinity, null for null."""
    if size_ns <= 0:
        raise ValueError("window size must be positive")
    return t - F.pmod(t, F.lit(size_ns))


def hop_starts(t: Column, size_ns: int, slide_ns: int) -> Column:
    """Array of the starts, multiples of the slide and never negative, of the windows ``[start, start + size)`` that hold ``t``.

    The slide may exceed the size: then some times fall in no window and get an empty array.
    """
    if size_ns <= 0 or slide_ns <= 0:
        raise ValueError("window size and slide must be positive")
    last = tumble_start(t, slide_ns)
    below = t - F.lit(size_ns)
    first = F.greatest(below - F.pmod(below, F.lit(slide_ns)) + F.lit(slide_ns), F.lit(0))
    return F.when(first <= last, F.sequence(first, last, F.lit(slide_ns))).when(
        t.isNotNull(), F.array().cast("array<bigint>")
    )
