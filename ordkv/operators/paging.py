"""Keyset paging over live pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, Row

from ..functions.ranges import Range


def page(pairs: DataFrame, limit: int) -> tuple[list[Row], bool]:
    """The first pairs by key, at most ``limit``, and whether there are more (one row is looked ahead)."""
    rows = pairs.orderBy("key").limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit


def pages(scan: Callable[[Range], DataFrame], over: Range, limit: int) -> Iterator[list[Row]]:
    """All pages of a range of any pairs; see ``each_page``."""
    return each_page(lambda r, n: page(scan(r), n), over, limit)


def each_page(page_of: Callable[[Range, int], tuple[list[Row], bool]], over: Range, limit: int) -> Iterator[list[Row]]:
    """All pages of a range; each starts above the last key of the one before, and sees the state of its time."""
    more = True
    while more:
        rows, more = page_of(over, limit)
        if rows:
            yield rows
            over = replace(over, low=bytes(rows[-1]["key"]) if not isinstance(rows[-1]["key"], str) else rows[-1]["key"], low_open=True)
