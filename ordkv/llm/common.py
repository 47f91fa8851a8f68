"""Shared helpers: words, shared scratch tables, skew-safe joins, graph components, adjacency in sorted rows."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import remove, removed_at_exit, shared_root

#: A word: a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: While a table is written: its shuffle files go when it is done, and Python gets batches of bounded bytes however long the texts.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as the empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    """Number of words of a text (long); null has none."""
    return F.size(words(text)).cast("long")


def numbered(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[..., DataFrame]]:
    """docs with columns c0, c1, ..., so that no name can clash; what a name became; and a way back (rows with c0, ... to docs' columns, plus others)."""
    names = docs.columns
    short = {c.lower(): f"c{i}" for i, c in reversed(list(enumerate(names)))}

    def back(df: DataFrame, *more: str) -> DataFrame:
        new = {m.lower() for m in more}
        return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c.lower() not in new], *more)

    return docs.toDF(*[f"c{i}" for i in range(len(names))]), lambda c: short[c.lower()], back


class _Writing:
    """Sets a session's options while any table is written, and puts them back after the last: writers may overlap."""

    lock, writers = threading.Lock(), {}

    def __init__(self, spark: SparkSession):
        self.conf, self.key = spark.conf, id(spark._jsparkSession)

    def __enter__(self) -> None:
        with self.lock:
            n, before = self.writers.get(self.key, (0, None))
            before = before or {k: self.conf.get(k, None) for k in _WHILE_WRITING}
            self.writers[self.key] = (n + 1, before)
            if not n:
                for k, v in _WHILE_WRITING.items():
                    self.conf.set(k, v)

    def __exit__(self, *_: object) -> None:
        with self.lock:
            n, before = self.writers.pop(self.key)
            if n > 1:
                self.writers[self.key] = (n - 1, before)
                return
            for k, v in before.items():
                self.conf.unset(k) if v is None else self.conf.set(k, v)


_scopes = threading.local()


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Deletes, at its end, the tables of all ``Scratch`` made within by this thread: for results that are written elsewhere."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for s in stack.pop():
            s.clear()


class Scratch:
    """Tables written to the shared folder, to cut lineage: what is written survives the loss of any executor.

    Lazy results read from them, so they stay until ``drop``, the end of a ``released`` block around, or that of the driver's process.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/ordkv-{uuid.uuid4().hex}"
        self._n = 0
        removed_at_exit(spark, self.root)
        if stack := _scopes.__dict__.get("stack"):
            stack[-1].append(self)

    def clear(self) -> None:
        """Delete all tables."""
        remove(self.spark, self.root)

    def path(self, tag: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{tag}"

    def write(self, df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
        """Write as Parquet (in folders by a column's values, if given) and read again; the write's own shuffle files are released when it ends."""
        path = self.path(tag)
        self.write_to(df, path, by)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._ordkv_path = path
        return out

    def write_to(self, df: DataFrame, path: str, by: str | None = None) -> None:
        """Write to a path of one's own."""
        with _Writing(self.spark):
            (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)

    def drop(self, *frames: DataFrame, within: str = "") -> None:
        """Delete tables that nothing reads any more, or a folder within them."""
        for df in frames:
            remove(self.spark, f"{df._ordkv_path}/{within}")


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that always shuffles or broadcasts both sides by measured size.

    An added hash column keeps Spark from reusing a partitioning by the keys alone, so that
    adaptive execution sees two plain exchanges and can split a hot key over many tasks.
    """
    mix = F.xxhash64(*[F.col(k) for k in keys])
    a, b = left.withColumn("__mix", mix), right.withColumn("__mix", mix)
    renamed = b.withColumnsRenamed({k: f"__r_{k}" for k in [*keys, "__mix"]})
    on = F.col("__mix") == F.col("__r___mix")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return a.join(renamed, on, how).drop("__mix", "__r___mix", *[f"__r_{k}" for k in keys])


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: long); component is its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. until the edges stop changing.
    Each step is a grouped minimum (combined before the shuffle) and a join that tolerates hot nodes.
    """
    e = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def seen(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    mark = seen(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = scratch.write(skew_join(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = skew_join(large, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.write(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small")
        scratch.drop(e, large)
        e, last, mark = small, mark, seen(small)
        if mark == last:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _neighbours(batches: Iterator[pd.DataFrame], levels: list[list[str]], keep: str) -> Iterator[pd.DataFrame]:
    """Mark rows of one sorted partition whose neighbour agrees on each level's columns; the first and last row get edge."""
    held, first = None, True
    seen = np.zeros((1, len(levels)), bool)

    def same(x: pd.DataFrame) -> np.ndarray:
        """For each row but the first, and level: does it agree with the row before?"""
        out = np.ones((len(x) - 1, len(levels)), bool)
        for j, cols in enumerate(levels):
            for c in cols:
                v = x[c].to_numpy()
                out[:, j] &= v[1:] == v[:-1]
        return out

    def emit(x: pd.DataFrame, dup: np.ndarray, edge: np.ndarray) -> pd.DataFrame:
        x = x.copy()
        for j in range(len(levels)):
            x[f"dup{j}"] = dup[:, j]
        x["edge"] = edge
        return x[dup[:, int(keep)] | edge]

    for x in batches:
        if not len(x):
            continue
        x = x.reset_index(drop=True) if held is None else pd.concat([held, x], ignore_index=True)
        pair = same(x)
        dup = np.zeros((len(x), len(levels)), bool)
        dup[0] = seen[0]
        dup[1:] |= pair
        dup[:-1] |= pair
        edge = np.zeros(len(x), bool)
        edge[0] = first
        if len(x) > 1:
            yield emit(x.iloc[:-1], dup[:-1], edge[:-1])
            first = False
        held, seen = x.iloc[-1:], dup[-1:]
    if held is not None:
        yield emit(held, seen, np.ones(1, bool))


def repeated_rows(scratch: Scratch, df: DataFrame, levels: list[list[str]], tie: list[str], tag: str) -> DataFrame:
    """Rows of ``df`` (longs only, no nulls) that agree with another row on ``levels[0]``.

    Columns dup0, dup1, ... say for each level whether another row agrees on its columns; each level
    extends the one before. One range shuffle by all columns, so that a hot key is spread over as many
    partitions as it has rows for; equal keys are then neighbours. Rows at the partitions' ends are
    compared on the driver: two a partition, however large the input.
    """
    by = [*levels[-1], *tie]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in by], *[T.StructField(f"dup{j}", T.BooleanType()) for j in range(len(levels))], T.StructField("edge", T.BooleanType())])
    parts = df.select(*by).repartitionByRange(n, *by).sortWithinPartitions(*by)
    found = scratch.write(parts.mapInPandas(lambda it: _neighbours(it, levels, "0"), schema), tag)
    ends = sorted(found.where("edge").collect(), key=lambda r: tuple(r[c] for c in by))
    fixed = [[*(r[c] for c in by), *(r[f"dup{j}"] for j in range(len(levels)))] for r in ends]
    for x, y, p, q in zip(ends, ends[1:], fixed, fixed[1:], strict=False):
        for j, cols in enumerate(levels):
            if all(x[c] == y[c] for c in cols):
                p[len(by) + j] = q[len(by) + j] = True
    inner = found.where("NOT edge").drop("edge")
    return inner.unionByName(df.sparkSession.createDataFrame([r for r in fixed if r[len(by)]], inner.schema))


def running_totals(scratch: Scratch, df: DataFrame, order: list[str], sums: dict[str, str], tag: str) -> DataFrame:
    """df with ``__index``, its rows' positions from 0 in the order of ``order``, and for each name of ``sums`` the total of that column in the rows before.

    A range shuffle sorts the rows; each partition is summed, the partitions' totals (one row each) are
    added up on the driver, and each partition adds its offset. Rows that tie in ``order`` must be alike.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    parts = scratch.write(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id()), tag)
    totals = parts.groupBy("__pid").agg(F.count("*").alias("__index"), *[F.sum(c).cast("long").alias(k) for k, c in sums.items()]).orderBy("__pid").collect()
    names, at, offsets = ["__index", *sums], [0] * (1 + len(sums)), []
    for r in totals:
        offsets.append((r["__pid"], *at))
        at = [x + r[k] for x, k in zip(at, names, strict=True)]
    schema = "__pid int, " + ", ".join(f"__at_{k} long" for k in names)
    found = parts.join(F.broadcast(df.sparkSession.createDataFrame(offsets, schema)), "__pid")  # a row for each partition
    before = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = {"__index": F.count(F.lit(1)).over(before), **{k: F.sum(c).over(before) for k, c in sums.items()}}
    return found.withColumns({k: F.col(f"__at_{k}") + F.coalesce(v, F.lit(0)).cast("long") for k, v in inner.items()}).drop("__pid", *[f"__at_{k}" for k in names])
