"""Key ranges with inclusive, exclusive or open ends, in unsigned byte order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """Keys from ``low`` to ``high``; None is open. An inverted range is empty."""

    low: bytes | None = None
    high: bytes | None = None
    low_open: bool = False
    high_open: bool = True

    @staticmethod
    def prefix(p: bytes) -> Range:
        """The keys that start with p: up to its successor, so that the ends reach the Parquet scan."""
        return Range(p or None, successor(p))

    def predicate(self, key: str | Column = "key") -> Column:
        c, out = F.col(key) if isinstance(key, str) else key, F.lit(True)
        if self.low is not None:
            out = out & (c > F.lit(self.low) if self.low_open else c >= F.lit(self.low))
        if self.high is not None:
            out = out & (c < F.lit(self.high) if self.high_open else c <= F.lit(self.high))
        return out

    def holds(self, key: bytes) -> bool:
        above = self.low is None or (key > self.low if self.low_open else key >= self.low)
        return above and (self.high is None or (key < self.high if self.high_open else key <= self.high))

    def meets(self, smallest: bytes, largest: bytes) -> bool:
        """May a run of keys from ``smallest`` to ``largest`` hold some of the range?"""
        above = self.low is None or (largest > self.low if self.low_open else largest >= self.low)
        return above and (self.high is None or (smallest < self.high if self.high_open else smallest <= self.high))


def successor(p: bytes) -> bytes | None:
    """The least key above all keys that start with p; None if there is none."""
    p = p.rstrip(b"\xff")
    return p[:-1] + bytes([p[-1] + 1]) if p else None


def overlap(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> bool:
    """Do two closed intervals share a key?"""
    return max(a[0], b[0]) <= min(a[1], b[1])
