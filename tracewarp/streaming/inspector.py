"""What runs: the state of a streaming query by its operators, from Spark's own progress reports."""

from __future__ import annotations

import json
from datetime import datetime


def _ns(text: str | None) -> int | None:
    return None if not text else int(datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp() * 1000) * 1_000_000


def inspect(progress: dict | None, status: dict | None = None) -> dict:
    """A query's last progress as one record: rows and their rate, watermark and lag, operators with their state, sources.

    ``progress`` is ``query.lastProgress`` as a dict, None before the first batch.
    """
    p = progress or {}
    times = p.get("eventTime") or {}
    wm, newest = _ns(times.get("watermark")), _ns(times.get("max"))
    operators = [
        {
            "name": o.get("operatorName"), "state_rows": o.get("numRowsTotal", 0), "updated": o.get("numRowsUpdated", 0), "removed": o.get("numRowsRemoved", 0),
            "late_dropped": o.get("numRowsDroppedByWatermark", 0), "state_bytes": o.get("memoryUsedBytes", 0), "partitions": o.get("numShufflePartitions"),
        }
        for o in p.get("stateOperators", [])
    ]
    return {
        "name": p.get("name"), "batch": p.get("batchId"), "active": bool((status or {}).get("isTriggerActive")), "message": (status or {}).get("message"),
        "input_rows": p.get("numInputRows", 0), "rows_per_s": p.get("processedRowsPerSecond"), "batch_ms": (p.get("durationMs") or {}).get("triggerExecution"),
        "watermark_ns": wm, "lag_ns": newest - wm if wm is not None and newest is not None else None, "late_dropped": sum(o["late_dropped"] for o in operators),
        "operators": operators, "sources": [{"description": s.get("description"), "rows": s.get("numInputRows", 0), "end": s.get("endOffset")} for s in p.get("sources", [])],
    }


def inspect_query(query) -> dict:
    """:func:`inspect` of a running or ended StreamingQuery."""
    p = query.lastProgress
    return inspect(p if p is None or isinstance(p, dict) else json.loads(p.json), query.status)
