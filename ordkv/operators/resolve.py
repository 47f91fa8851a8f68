"""Resolution of versions: the newest entry of each key, over any number of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE, OVERHEAD, PUT


def latest(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The entry of the highest seqno of each key, tombstones included.

    One grouped maximum: combined before the shuffle, so a key written often costs one row a task, and
    predicates on the key pass below it into the scan. Equal seqnos only occur on equal entries.
    """
    keys = keys or ["key"]
    rest = [c for c in entries.columns if c not in keys and c != "seqno"]
    top = entries.groupBy(*keys).agg(F.max(F.struct("seqno", *rest)).alias("e"))
    return top.select(*[F.col("e." + c).alias(c) if c not in keys else F.col(c) for c in entries.columns])


def latest_by_window(entries: DataFrame) -> DataFrame:
    """The same by row_number, which keeps wide values out of the aggregation buffer."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("key").orderBy(F.desc("seqno"))
    return entries.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def live(resolved: DataFrame) -> DataFrame:
    """Pairs whose newest version is a put. Only ever after resolution: earlier it would bring deleted keys back."""
    return resolved.where(F.col("kind") == PUT).select("key", "value")


def tombstones(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("kind") == DELETE).select("key", "seqno")


def merge(runs: list[DataFrame], drop_tombstones: bool = False) -> DataFrame:
    """One run of the newest version of each key in several; tombstones go only where nothing older can lie below."""
    out = latest(reduce(DataFrame.unionByName, runs))
    return out.where(F.col("kind") == PUT) if drop_tombstones else out


def shadowed(entries: DataFrame) -> DataFrame:
    """(key, versions, shadowed): how many versions of a key are stored, and how many no read can see."""
    return entries.groupBy("key").agg(F.count("*").alias("versions"), (F.count("*") - 1).alias("shadowed"))


def multi_get(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, value) of each wanted key, null where it isn't live.

    Entries of other keys go before resolution, by a semi-join for which Spark broadcasts the wanted keys if they are
    few: then only their versions are shuffled.
    """
    wanted = wanted.select("key").distinct()
    return wanted.join(live(latest(entries.join(wanted, "key", "left_semi"))), "key", "left")


def memtable_bytes(entries: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """The size that a write buffer would charge for the entries: key, newest value and a constant for each key."""
    return latest(entries).agg(F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + overhead), F.lit(0)).cast("long").alias("bytes"))
