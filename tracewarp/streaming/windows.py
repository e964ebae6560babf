"""Structured Streaming forms of the window, join and dedupe operators.

Two kinds: the built-in ones, which scale as Spark's watermarks do (a watermark per source, late rows dropped), and
stateful processors that keep the engine's own lifecycle: every row revises its window, the watermark finalises it, and
rows within the grace period revise it once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from tracewarp.functions.ddsketch import ALPHA, SHIFT, TINY, gamma
from tracewarp.operators.inference import WARM, WINDOW, Hysteresis


def with_event_ts(df: DataFrame, lateness_ns: int, time: str = "event_time", grace_ns: int = 0) -> DataFrame:
    """``event_ts`` from nanoseconds, and a watermark on it; buckets stay integer arithmetic on nanoseconds.

    Spark drops what is behind its watermark before any operator sees it, so rows within ``grace_ns`` of lateness must
    not be: its watermark stays behind by the grace too.
    """
    ts = F.timestamp_micros(F.expr(f"{time} div 1000"))
    return df.withColumn("event_ts", ts).withWatermark("event_ts", f"{(lateness_ns + grace_ns) // 1000} microseconds")


def dedupe(df: DataFrame, key: str = "event_id") -> DataFrame:
    """The first row of each key; state lives as long as the watermark delay (see :func:`with_event_ts`)."""
    return df.dropDuplicatesWithinWatermark([key])


def window_average(df: DataFrame, size_ns: int, slide_ns: int | None = None) -> DataFrame:
    """(service, window_start, window_end, value, n) of a frame with ``event_ts``; append mode emits final windows."""
    w = F.window("event_ts", f"{size_ns // 1000} microseconds", *([f"{slide_ns // 1000} microseconds"] if slide_ns else []))
    out = df.where("service is not null and value is not null").groupBy("service", w.alias("w")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return out.select("service", (F.unix_micros("w.start") * 1000).alias("window_start"), (F.unix_micros("w.end") * 1000).alias("window_end"), "value", "n")


def interval_join(left: DataFrame, right: DataFrame, lookback_ns: int, lookahead_ns: int, how: str = "leftOuter") -> DataFrame:
    """Telemetry (event_ts) with changes (change_ts) of the same service; Spark expires state by the bounds themselves."""
    back, ahead = (F.expr(f"interval {n // 1000} microseconds") for n in (lookback_ns, lookahead_ns))
    r = right.withColumnRenamed("service", "change_service")
    cond = (F.col("service") == F.col("change_service")) & (F.col("change_ts") >= F.col("event_ts") - back) & (F.col("change_ts") <= F.col("event_ts") + ahead)
    return left.join(r, cond, how)


_EMIT = [StructField("service", StringType()), StructField("window_start", LongType()), StructField("window_end", LongType())]
REVISION = StructType([*_EMIT, StructField("value", DoubleType()), StructField("count", LongType()), StructField("revision", LongType()), StructField("finalized", BooleanType()), StructField("late", BooleanType())])
PERCENTILES = StructType([*_EMIT, *(StructField(p, DoubleType()) for p in ("p50", "p95", "p99")), StructField("count", LongType()), StructField("revision", LongType()), StructField("finalized", BooleanType()), StructField("late", BooleanType())])


class _Lifecycle(StatefulProcessor):
    """Windows of a service: a revision for each batch that touches one, one more when the watermark passes its end.

    The watermark is that of the allowed lateness; Spark's stays a grace period behind it, see :func:`revisions`. A
    finalised window takes rows until the watermark is a grace period past its end, and is then forgotten. A revision
    is ``late`` where a row of it was at or behind the watermark.
    """

    def __init__(self, size_ns: int, grace_ns: int):
        self.size, self.grace = size_ns, grace_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", StructType([StructField("start", LongType())]), self.state)

    def close(self) -> None:
        pass

    def _timers(self, end_ns: int, spark_ms: int) -> None:
        # A timer fires when Spark's watermark reaches it; round up, so that a window isn't final before its end.
        for t in (-(-(end_ns - self.grace) // 1_000_000), -(-end_ns // 1_000_000)):
            if t > spark_ms:
                self.handle.registerTimer(t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spark_ms = timerValues.getCurrentWatermarkInMs()
        wm = spark_ms * 1_000_000 + self.grace if spark_ms else -(2**62)  # 0: none yet
        out = []
        for pdf in rows:
            pdf = pdf.dropna(subset=["value", "event_time"])
            start = pdf["event_time"] - pdf["event_time"] % self.size
            for s, part in pdf.groupby(start):
                s = int(s)
                end = s + self.size
                if end + self.grace <= wm:
                    continue  # beyond grace
                part = part[part["event_time"] + self.grace >= wm]
                if not len(part):
                    continue
                had = self.windows.containsKey((s,))
                state = tuple(self.windows.getValue((s,))) if had else None
                if had and end <= wm and not state[-1]:  # its timer comes after these rows
                    state = self.finalise(state)
                    out.append((key[0], s, end, *self.emit(state), True, False))
                state = self.push(state, part["value"].tolist(), end <= wm)
                self.windows.updateValue((s,), state)
                if not had:
                    self._timers(end, spark_ms)
                out.append((key[0], s, end, *self.emit(state), end <= wm, bool((part["event_time"] <= wm).any())))
        if out:
            yield pd.DataFrame(out, columns=self.output.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1_000_000 + self.grace
        out = []
        for (s,), state in list(self.windows.iterator()):
            end = s + self.size
            if end + self.grace <= now:
                self.windows.removeKey((s,))
            elif end <= now and not state[-1]:
                state = self.finalise(tuple(state))
                self.windows.updateValue((s,), state)
                out.append((key[0], s, end, *self.emit(state), True, False))
        if out:
            yield pd.DataFrame(out, columns=self.output.names)


class AverageRevisions(_Lifecycle):
    state = StructType([StructField("sum", DoubleType()), StructField("count", LongType()), StructField("revision", LongType()), StructField("final", BooleanType())])
    output = REVISION

    def push(self, old, values, final):
        total, n, revision, was = old or (0.0, 0, 0, final)
        return (total + sum(values), n + len(values), revision + 1, was or final)

    def finalise(self, s):
        return (s[0], s[1], s[2] + 1, True)

    def emit(self, s):
        return s[0] / s[1], s[1], s[2]


class PercentileRevisions(_Lifecycle):
    """Quantiles of buckets of bounded relative error; the state holds the buckets, so a restart is exact."""

    state = StructType([StructField("buckets", StringType()), StructField("low", DoubleType()), StructField("high", DoubleType()), StructField("count", LongType()), StructField("revision", LongType()), StructField("final", BooleanType())])
    output = PERCENTILES

    def push(self, old, values, final):
        import json
        from math import ceil, isfinite, log

        text, low, high, n, revision, was = old or ("{}", float("inf"), float("-inf"), 0, 0, final)
        buckets = json.loads(text)
        for v in filter(isfinite, values):
            k = str(ceil(log(v) / log(gamma(ALPHA))) + SHIFT if v > TINY else -(ceil(log(-v) / log(gamma(ALPHA))) + SHIFT) if v < -TINY else 0)
            buckets[k] = buckets.get(k, 0) + 1
            low, high, n = min(low, v), max(high, v), n + 1
        return (json.dumps(buckets), low, high, n, revision + 1, was or final)

    def finalise(self, s):
        return (*s[:4], s[4] + 1, True)

    def emit(self, s):
        import json
        from math import floor

        buckets, g, out = sorted((int(k), c) for k, c in json.loads(s[0]).items()), gamma(ALPHA), []
        for q in (0.5, 0.95, 0.99):
            upto, value = 0, None
            for k, c in buckets:
                upto += c
                if upto > floor(q * (s[3] - 1)):
                    size = 2 * g ** (abs(k) - SHIFT) / (1 + g)
                    value = min(max(0.0 if k == 0 else size if k > 0 else -size, s[1]), s[2])
                    break
            out.append(value)
        return (*out, s[3], s[4])


def revisions(df: DataFrame, processor: _Lifecycle, lateness_ns: int) -> DataFrame:
    """Revisions of the windows of a streaming frame of ``event_time``, ``service`` and ``value``; update mode."""
    rows = with_event_ts(df.where("service is not null").select("service", "event_time", "value"), lateness_ns, grace_ns=processor.grace)
    return rows.groupBy("service").transformWithStateInPandas(processor, processor.output, "update", "EventTime")


def heatmap(df: DataFrame, size_ns: int, lateness_ns: int, grace_ns: int, above: float | None = None) -> DataFrame:
    """The streaming heatmap: revisions of the means and of the latency p99s of each cell, as one stream; update mode.

    (service, window_start, kind, value, count, revision, finalized, late) with kind ``avg`` or ``p99``;
    :func:`heatmap_cells` makes the heatmap of what was emitted.
    """
    shown = df.where(F.col("name").contains("lat") | F.col("name").contains("err") | F.col("name").contains("mem"))
    cell = ["count", "revision", "finalized", "late"]
    avg = revisions(shown, AverageRevisions(size_ns, grace_ns), lateness_ns).select("service", "window_start", F.lit("avg").alias("kind"), "value", *cell)
    lat = F.col("name").contains("lat") if above is None else F.col("name").contains("lat") & (F.col("value") > above)
    p99 = revisions(df.where(lat), PercentileRevisions(size_ns, grace_ns), lateness_ns).select("service", "window_start", F.lit("p99").alias("kind"), F.col("p99").alias("value"), *cell)
    return avg.unionByName(p99)


def heatmap_cells(emitted: DataFrame) -> DataFrame:
    """(service, window_start, avg_value, p99, value) of the latest revision of each cell; a cell shows its p99 where it has one."""
    last = emitted.groupBy("service", "window_start", "kind").agg(F.max_by("value", "revision").alias("value"))
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("value")))
    out = last.groupBy("service", "window_start").agg(pick("avg").alias("avg_value"), pick("p99").alias("p99"))
    return out.withColumn("value", F.coalesce("p99", "avg_value"))


ANOMALY = StructType([StructField("service", StringType()), StructField("name", StringType()), StructField("start_ns", LongType()), StructField("end_ns", LongType()), StructField("peak_abs_z", DoubleType()), StructField("sample_count", LongType()), StructField("closed", BooleanType())])


class AnomalyStream(StatefulProcessor):
    """Intervals of a (service, name) series as samples come, by the same steps as in batch; a change of the open one emits it again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", StructType([StructField("json", StringType())]))

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        import json
        from math import isfinite

        h, window = Hysteresis(), []
        if self.kept.exists():
            old = json.loads(self.kept.get()[0])
            window, h.entering, h.open, h.exiting = old["window"], [tuple(e) for e in old["entering"]], old["open"], old["exiting"]
        pdf = pd.concat(list(rows)).sort_values(["event_time", "event_id"], kind="stable")
        out = []
        for t, v, ref in zip(pdf["event_time"].tolist(), pdf["value"].tolist(), pdf["event_id"].tolist()):
            if v is None or not isfinite(v):
                continue
            if done := h.push(t, sample_z(window, v), ref):
                out.append(done)
            window = (window + [v])[-WINDOW:]
        if h.open:
            out.append(h.open)
        self.kept.update((json.dumps({"window": window, "entering": h.entering, "open": h.open, "exiting": h.exiting}),))
        if out:
            yield pd.DataFrame([(*key, *(o[c] for c in ANOMALY.names[2:])) for o in out], columns=ANOMALY.names)


def sample_z(window: list[float], x: float) -> float | None:
    """The robust z of ``x`` against the samples before it; as the batch expression has it."""
    if len(window) < WARM:
        return None

    def median(v):
        v = sorted(v)
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2

    m = median(window)
    d = [abs(v - m) for v in window]
    mad, mean = median(d), sum(sorted(d)) / len(d)
    z = 0.6745 * (x - m) / mad if mad > 0 else 0.7979 * (x - m) / mean if mean > 0 else 0.0 if abs(x - m) <= 1e-9 else 8.0 if x > m else -8.0
    return max(-8.0, min(8.0, z))


def anomalies(df: DataFrame) -> DataFrame:
    """Streaming anomaly intervals of metrics (service, name, event_time, event_id, value); update mode."""
    rows = df.where("service is not null").select("service", "name", "event_time", "event_id", "value")
    return rows.groupBy("service", "name").transformWithStateInPandas(AnomalyStream(), ANOMALY, "update", "None")
