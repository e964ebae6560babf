"""Batches of signals: rows of one signal, flushed when they are many enough or have waited long enough."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Batcher:
    """Collects events by signal; a batch is sorted by event time, arrival and id.

    A signal's batch is full with ``max_rows`` rows, or when its oldest row is ``max_age_ns`` old.
    """

    max_rows: int = 256
    max_age_ns: int = 1_000_000_000
    waiting: dict[str, list[tuple[int, int, str, dict]]] = field(default_factory=dict)
    since: dict[str, int] = field(default_factory=dict)
    arrivals: int = 0

    def push(self, signal: str, event_id: str, time_ns: int, now_ns: int, row: dict) -> list[tuple[str, list[dict]]]:
        """Takes a row in; the batches that this, or the time, made full."""
        out = self.advance(now_ns)
        self.arrivals += 1
        self.since.setdefault(signal, now_ns)
        rows = self.waiting.setdefault(signal, [])
        rows.append((time_ns, self.arrivals, event_id, row))
        return out + (self._take(signal) if len(rows) >= self.max_rows else [])

    def advance(self, now_ns: int) -> list[tuple[str, list[dict]]]:
        """The batches that have waited long enough, by signal."""
        return [b for s in sorted(s for s, t in self.since.items() if now_ns - t >= self.max_age_ns) for b in self._take(s)]

    def flush(self) -> list[tuple[str, list[dict]]]:
        """All that waits, at the end of the source."""
        return [b for s in sorted(self.waiting) for b in self._take(s)]

    def _take(self, signal: str) -> list[tuple[str, list[dict]]]:
        rows = self.waiting.pop(signal, [])
        self.since.pop(signal, None)
        return [(signal, [r[3] for r in sorted(rows, key=lambda r: r[:3])])] if rows else []
