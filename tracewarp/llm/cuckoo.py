"""A cuckoo filter over 128-bit keys on numpy arrays: batch insertion, lookup and deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Share of the slots that may be taken before the filter must be rebuilt larger.
LOAD = 0.85
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


class CuckooFull(Exception):
    """The keys don't fit; build a larger filter from the exact table."""


class Cuckoo:
    """``table[bucket, slot]`` holds 16-bit fingerprints, 0 where free; a key may sit in either of its two buckets."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        need = max(4, int(keys / (LOAD * SLOTS)) + 1)
        return cls(np.zeros((1 << (need - 1).bit_length(), SLOTS), np.uint16))

    @classmethod
    def load(cls, blob: bytes) -> Cuckoo:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def room(self) -> int:
        return int(LOAD * self.table.size) - len(self)

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h1, h2 = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
        fp = (h2 >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        return (_mix(h1 ^ (h2 << np.uint64(16))) & self.mask).astype(np.int64), fp

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return (bucket.astype(np.uint64) ^ (_mix(fp.astype(np.uint64) * _MIX) & self.mask)).astype(np.int64)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key may have been inserted; always so if it was and wasn't deleted."""
        b, fp = self._places(h1, h2)
        here = (self.table[b] == fp[:, None]).any(1)
        return here | (self.table[self._other(b, fp)] == fp[:, None]).any(1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Adds distinct keys that aren't in the filter."""
        b, fp = self._places(h1, h2)
        rng = np.random.default_rng(7)
        for step in range(2000):
            if not len(b):
                return
            order = np.argsort(b, kind="stable")
            b, fp = b[order], fp[order]
            first = np.concatenate([[True], b[1:] != b[:-1]])
            rank = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
            free = self.table[b] == 0
            nth = np.cumsum(free, 1) - 1
            fit = rank < free.sum(1)
            slot = np.argmax(free & (nth == rank[:, None]), 1)
            self.table[b[fit], slot[fit]] = fp[fit]
            b, fp, rank = b[~fit], fp[~fit], rank[~fit]
            if not len(b):
                return
            if step:
                # One key of each full bucket takes the place of another, which moves to its other bucket.
                first = np.concatenate([[True], b[1:] != b[:-1]])
                at, put = b[first], rng.integers(0, SLOTS, int(first.sum()))
                out = self.table[at, put].copy()
                self.table[at, put] = fp[first]
                fp[first] = out
            b = self._other(b, fp)
        raise CuckooFull(f"{len(b)} keys don't fit")

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Removes distinct keys that are in the filter."""
        b, fp = self._places(h1, h2)
        low = np.minimum(b, self._other(b, fp))
        order = np.lexsort((fp, low))
        b, fp, low = b[order], fp[order], low[order]
        new = np.concatenate([[True], (low[1:] != low[:-1]) | (fp[1:] != fp[:-1])]) if len(b) else np.zeros(0, bool)
        rank = np.arange(len(b)) - np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))
        for r in range(int(rank.max(initial=-1)) + 1):  # keys that look alike, one at a time
            i = np.flatnonzero(rank == r)
            # A copy may sit in either bucket; keys sharing a bucket but not a fingerprint touch different slots.
            for other in (False, True):
                bucket = self._other(b[i], fp[i]) if other else b[i]
                hit = self.table[bucket] == fp[i][:, None]
                some = hit.any(1)
                self.table[bucket[some], hit[some].argmax(1)] = 0
                i = i[~some]
