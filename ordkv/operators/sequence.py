"""Sequence numbers for batches of any size, without a window over one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number(sorted_parts: DataFrame, order: str | list[str], first: int, name: str = "seqno") -> DataFrame:
    """Rows with ``name`` from ``first`` on in the order of ``order``, which must be unique.

    ``sorted_parts`` has a column __pid: the number of the range, ascending with the order, that each row fell
    into, as written to a table. The ranges' sizes, a row each, are added up on the driver.
    """
    offsets, at = [], first
    for r in sorted_parts.groupBy("__pid").count().orderBy("__pid").collect():
        offsets.append((r["__pid"], at))
        at += r["count"]
    if not offsets:
        return sorted_parts.withColumn(name, F.lit(first).cast("long")).drop("__pid")
    known = sorted_parts.sparkSession.createDataFrame(offsets, "__pid int, __at long")
    inner = F.row_number().over(Window.partitionBy("__pid").orderBy(order)) - 1
    return sorted_parts.join(F.broadcast(known), "__pid").withColumn(name, (F.col("__at") + inner).cast("long")).drop("__pid", "__at")
