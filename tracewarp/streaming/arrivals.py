"""Arrival schedules for tests of event-time operators: out of order, repeated, late, in bursts, and always the same for a seed."""

from __future__ import annotations

import random


def adversarial(events: list[tuple], seed: int, late_ns: int, burst: int, time: int = 1, repeat: float = 0.05, late: float = 0.05) -> list[list[tuple]]:
    """Batches of the events as they arrive.

    Events come in order of time, except that each batch is rotated by a random amount, a share ``late`` comes up to
    ``late_ns`` after its time, and a share ``repeat`` comes again later. No event is lost.
    """
    r = random.Random(seed)
    timed = []
    for i, e in enumerate(sorted(events, key=lambda e: e[time])):
        at = e[time] + (r.randint(1, late_ns) if r.random() < late else 0)
        timed.append((at, i, e))
        if r.random() < repeat:
            timed.append((at + r.randint(1, late_ns), i, e))
    timed.sort(key=lambda x: x[:2])
    out, at = [], 0
    while at < len(timed):
        size = r.randint(1, burst)
        part = [e for _, _, e in timed[at : at + size]]
        turn = r.randrange(len(part))
        out.append(part[turn:] + part[:turn])
        at += size
    return out
