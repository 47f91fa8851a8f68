"""A versioned, ordered key-value table: immutable sorted Parquet runs under a catalog that is replaced whole."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .errors import CorruptionError, InvalidError, StoreError
from .files import Files
from .functions.codecs import Entry, log_frame, read_log
from .functions.ranges import Range
from .operators import resolve
from .operators.sequence import number
from .options import Options
from .plans.catalog import Catalog, Run
from .operators.paging import page
from .plans.compaction import Step, pick
from .schema import DELETE, ENTRY, MAX_SEQNO, OVERHEAD, PUT

#: What an entry counts in a run besides its bytes. Runs are measured by content, as Parquet's own overhead would dwarf small ones.
ENTRY_OVERHEAD = 16


def _filter_bytes(keys: int, share: float) -> int:
    """Of a Parquet filter with this share of false positives: a power of two, a mebibyte at most."""
    need = -keys / math.log(1 - share ** (1 / 8))  # bytes, as eight bits are set for a key
    return 1 << min(20, max(5, math.ceil(math.log2(max(1.0, need)))))


class Store:
    """One writer, any number of readers through the DataFrames that it gives.

    Small writes are logged (one synced file for a batch, complete or void) and buffered on the driver; large
    batches are DataFrames and become a run by one Spark job. A read is a DataFrame bound to the runs and the
    buffer of its time, so it is a snapshot; runs are only deleted by ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.options = spark, options or Options()
        self.files = Files(spark, path)
        self._frames: dict[tuple[str, ...], DataFrame] = {}
        for d in ("", "catalog", "runs", "log"):
            self.files.mkdirs(d)
        self._lock = f"{uuid.uuid4().hex} {os.getpid()}".encode()
        try:
            self.files.create("LOCK", self._lock, self.options.sync)
        except FileExistsError as e:
            raise StoreError(f"{path} is open elsewhere, or was not closed; remove LOCK if nothing uses it") from e
        try:
            self._recover()
        except BaseException:
            self.files.remove("LOCK")
            raise
        self.closed = False

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        return cls(spark, path, options)

    def _recover(self) -> None:
        names = [n for n in self.files.list("catalog") if n.endswith(".json")]
        self.catalog = Catalog.from_json(self.files.read(f"catalog/{names[-1]}")) if names else Catalog()
        self.buffer: dict[bytes, Entry] = {}
        self.next_seqno, self._logs = self.catalog.next_seqno, []
        for name in (n for n in self.files.list("log") if n.endswith(".wal")):
            first, count = map(int, name.removesuffix(".wal").split("-"))
            entries, _ = read_log(self.files.read(f"log/{name}"))
            if first + count <= self.catalog.next_seqno or len(entries) != count:
                self.files.remove(f"log/{name}")  # flushed before, or torn before it was acknowledged
                continue
            self._logs.append(name)
            self.buffer.update({e.key: e for e in entries})
            self.next_seqno = max(self.next_seqno, first + count)

    # Writes

    def put(self, key: bytes, value: bytes) -> None:
        self.write([(PUT, key, value)])

    def delete(self, key: bytes) -> None:
        """Deleting an absent key is a write like any other."""
        self.write([(DELETE, key, b"")])

    def write(self, ops: Iterable[tuple[int, bytes, bytes]]) -> None:
        """Log and apply (kind, key, value) operations as one: all are seen, before and after a crash, or none."""
        ops = list(ops)
        if not ops:
            return
        if self.next_seqno + len(ops) - 1 > MAX_SEQNO:
            raise InvalidError("sequence numbers are used up")
        for kind, key, value in ops:
            if kind not in (PUT, DELETE) or len(key) + len(value) + 32 > self.options.max_record_bytes:
                raise InvalidError(f"kind {kind}, {len(key)} + {len(value)} bytes")
        entries = [Entry(bytes(k), self.next_seqno + i, kind, bytes(v) if kind == PUT else b"") for i, (kind, k, v) in enumerate(ops)]
        name = f"{self.next_seqno:020d}-{len(ops):010d}.wal"
        self.next_seqno += len(ops)  # numbers are used even if the log fails
        self.files.create(f"log/{name}", b"".join(map(log_frame, entries)), self.options.sync)
        self._logs.append(name)
        self.buffer.update({e.key: e for e in entries})
        if self.buffered_bytes >= self.options.memtable_bytes:
            self.flush()
            self.compact()

    def write_batch(self, ops: DataFrame) -> None:
        """Apply a DataFrame of (ord, kind, key, value) as one run; the last operation of a key by ord wins. ord must be unique."""
        self.write_batches(ops.withColumn("batch", F.lit(0)))

    def write_batches(self, ops: DataFrame) -> None:
        """Apply a DataFrame of (batch, ord, kind, key, value): a run for each batch, in ascending order, all at once.

        (batch, ord) must be unique. Sequence numbers come from a range shuffle in that order and the ranges' sizes.
        """
        self.flush()
        scratch = f"runs/batch-{uuid.uuid4().hex}"
        try:
            n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
            ops.select("batch", "ord", "kind", "key", "value").repartitionByRange(n, "batch", "ord").withColumn("__pid", F.spark_partition_id()).write.parquet(self.files.full(scratch))
            parts = self.spark.read.parquet(self.files.full(scratch))
            bad = F.col("kind").isNull() | ~F.col("kind").isin(PUT, DELETE) | F.col("key").isNull()
            sizes = parts.groupBy("batch").agg(F.count(F.when(bad, 1)).alias("bad"), F.count("*").alias("n"))
            wrong, count, largest = sizes.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
            if wrong:
                raise InvalidError(f"{wrong} operations without a key or of an unknown kind")
            if not count:
                return
            if self.next_seqno + count - 1 > MAX_SEQNO:
                raise InvalidError("sequence numbers are used up")
            entries = number(parts, ["batch", "ord"], self.next_seqno).select("batch", "key", "seqno", F.col("kind").cast("byte").alias("kind"), F.when(F.col("kind") == PUT, F.coalesce("value", F.lit(b""))).otherwise(F.lit(b"")).alias("value"))
            runs = self._write(resolve.latest(entries, ["batch", "key"]), 0, None, largest)
            self.next_seqno += count
            self._commit(self.catalog.swapped([], runs))
        finally:
            self.files.remove(scratch)
        self.compact()

    @property
    def buffered_bytes(self) -> int:
        return sum(len(e.key) + len(e.value) + OVERHEAD for e in self.buffer.values())

    def flush(self) -> None:
        """Turn the buffer into a run of level 0; nothing to do where it is empty. Doesn't compact."""
        if not self.buffer:
            return
        runs = self._write(self._buffered(), 0, 1, len(self.buffer))
        self._commit(self.catalog.swapped([], runs))
        self.buffer = {}
        for name in self._logs:
            self.files.remove(f"log/{name}")
        self._logs = []

    def _buffered(self) -> DataFrame:
        rows = [(bytearray(e.key), e.seqno, e.kind, bytearray(e.value)) for e in sorted(self.buffer.values(), key=lambda e: e.key)]
        return self.spark.createDataFrame(rows, ENTRY)

    def _write(self, entries: DataFrame, level: int, files: int | None, count: int = 1) -> list[Run]:
        """Write sorted entries, about ``count`` (of the largest batch): as a run for each batch, if they have such a column, as one for level 0, or one for each file below it."""
        batches = "batch" in entries.columns
        first = self.catalog.next_file
        path = f"runs/{first:06d}"
        self.files.remove(path)  # left by a crash before its commit
        if files == 1:
            parts = entries.coalesce(1).sortWithinPartitions("key")
        elif batches:
            parts = entries.repartitionByRange(F.col("batch"), F.col("key")).sortWithinPartitions("batch", "key")
        else:
            parts = entries.repartitionByRange(files, "key").sortWithinPartitions("key")
        writer = parts.write.option("parquet.page.size", str(self.options.block_bytes))
        if self.options.bloom_bits_per_key:
            share = min(0.5, math.exp(-self.options.bloom_bits_per_key * math.log(2) ** 2))
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", f"{share:.6f}")
            if batches:  # of filters from the largest batch's size down, each file keeps the least that its keys fit
                most = _filter_bytes(count, share)
                writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.max.bytes", str(most)).option("parquet.bloom.filter.candidates.number#key", str(most.bit_length()))
            else:
                writer = writer.option("parquet.bloom.filter.expected.ndv#key", str(max(1, -(-count // (files or 1)))))
        (writer.partitionBy("batch") if batches else writer).parquet(self.files.full(path))
        if self.options.sync:
            self.files.sync_tree(path)
        if batches:
            name, order = F.regexp_extract(F.input_file_name(), r"/(batch=-?\d+)/[^/]*$", 1), F.regexp_extract("_run", r"(-?\d+)", 1).cast("long")
            stored = self.spark.read.schema(ENTRY).option("recursiveFileLookup", "true").parquet(self.files.full(path))
        else:
            name, order = F.lit("") if level == 0 else F.element_at(F.split(F.input_file_name(), "/"), -1), F.col("smallest")
            stored = self._read([path])
        rows = self._measured(stored.withColumn("_run", name)).orderBy(order).collect()  # a row for each run
        runs = []
        for i, r in enumerate(rows):
            at = f"{path}/{r['_run']}" if r["_run"] else path
            runs.append(Run(first + i, level, at, bytes(r["smallest"]), bytes(r["largest"]), r["first_seqno"], r["last_seqno"], r["size"], r["count"], r["digest"], r["tombstones"]))
        if not runs:
            self.files.remove(path)
        self._next_file = first + max(1, len(runs))
        return runs

    @staticmethod
    def _measured(entries: DataFrame) -> DataFrame:
        digest = F.bit_xor(F.crc32(F.concat(F.col("key"), F.lit(b"\0"), F.col("seqno").cast("string").cast("binary"), F.col("kind").cast("string").cast("binary"), F.col("value"))))
        return entries.groupBy("_run").agg(
            F.min("key").alias("smallest"), F.max("key").alias("largest"), F.min("seqno").alias("first_seqno"), F.max("seqno").alias("last_seqno"), F.count("*").alias("count"), digest.alias("digest"), F.count(F.when(F.col("kind") == DELETE, 1)).alias("tombstones"),
            F.sum(F.octet_length("key") + F.octet_length("value") + ENTRY_OVERHEAD).cast("long").alias("size"),
        )

    def _commit(self, catalog: Catalog) -> None:
        """The one point at which a change is durable and seen: a new catalog file."""
        catalog = replace(catalog, version=self.catalog.version + 1, next_file=getattr(self, "_next_file", catalog.next_file), next_seqno=self.next_seqno)
        self.files.create(f"catalog/{catalog.version:020d}.json", catalog.to_json().encode(), self.options.sync)
        self.catalog = catalog

    # Reads

    def _read(self, paths: list[str]) -> DataFrame:
        """The entries of runs; their files are listed once, as runs never change."""
        if not paths:
            return self.spark.createDataFrame([], ENTRY)
        key = tuple(paths)
        if (found := self._frames.pop(key, None)) is None:
            found = self.spark.read.schema(ENTRY).parquet(*[self.files.full(p) for p in paths])
            while len(self._frames) >= 64:
                self._frames.pop(next(iter(self._frames)))
        self._frames[key] = found
        return found

    def run_entries(self, runs: Iterable[Run] | None = None) -> DataFrame:
        """The entries of runs (all, if none are given) with ``run_id``: one read, in which a file's name tells its run."""
        listed = list(self.catalog.runs if runs is None else runs)
        if not listed:
            return self.spark.createDataFrame([], ENTRY).withColumn("run_id", F.lit(0).cast("long"))
        ids = self.spark.createDataFrame([(r.path, r.id) for r in listed], "_path string, run_id long")
        file = F.regexp_extract(F.input_file_name(), r"/(runs/[^/]+(?:/batch=[^/]+)?/[^/]*)$", 1)
        named = self._read([r.path for r in listed]).withColumns({"_file": file, "_folder": F.regexp_replace(file, r"/[^/]*$", "")})
        # A run is a file, or all of a folder.
        by_file, by_folder = ids.withColumnsRenamed({"_path": "_file", "run_id": "_a"}), ids.withColumnsRenamed({"_path": "_folder", "run_id": "_b"})
        return named.join(by_file, "_file", "left").join(by_folder, "_folder", "left").select("key", "seqno", "kind", "value", F.coalesce("_a", "_b").alias("run_id"))

    def entries(self, over: Range = Range()) -> DataFrame:
        """All stored versions of a range's keys, of the runs that may hold them and the buffer."""
        out = self._read([r.path for r in self.catalog.pruned(over)])
        if any(over.holds(k) for k in self.buffer):
            out = out.unionByName(self._buffered())
        return out.where(over.predicate())

    def latest(self, over: Range = Range()) -> DataFrame:
        """The newest version of each key of a range; no shuffle where the runs can't hold two."""
        alone = self.catalog.disjoint(self.catalog.pruned(over)) and not any(over.holds(k) for k in self.buffer)
        found = self.entries(over)
        return found if alone else resolve.latest(found)

    def scan(self, over: Range = Range(), ordered: bool = True) -> DataFrame:
        """Live pairs of a range, ascending by key; an inverted range is empty."""
        pairs = resolve.live(self.latest(over))
        return pairs.orderBy("key") if ordered else pairs

    def prefix(self, p: bytes) -> DataFrame:
        return self.scan(Range.prefix(p))

    def get(self, key: bytes) -> bytes | None:
        """The live value of a key; the buffer decides alone where it knows the key."""
        if (e := self.buffer.get(key)) is not None:
            return e.value if e.kind == PUT else None
        over = Range(key, key, high_open=False)
        # A version in each run at most, so the newest is found without a shuffle.
        rows = self._read([r.path for r in self.catalog.pruned(over)]).where(over.predicate()).collect()
        newest = max(rows, key=lambda r: r["seqno"], default=None)
        return bytes(newest["value"]) if newest is not None and newest["kind"] == PUT else None

    def page(self, over: Range = Range(), limit: int = 100) -> tuple[list[Row], bool]:
        """The first live pairs of a range by key, at most ``limit``, and whether there are more.

        The range is read piece by piece, each about as far as the runs' counts say that the page may reach, so
        that a page costs what it holds, not what is left of the range.
        """
        rows: list[Row] = []
        ends = sorted(((r.largest, r.count) for r in self.catalog.pruned(over)), key=lambda r: r[0])
        reach = 4
        while True:
            held, piece = 0, over
            for largest, count in ends:
                if over.low is not None and largest <= over.low:
                    continue
                held += count
                if held >= reach * (limit + 1) and (over.high is None or largest < over.high):
                    piece = replace(over, high=largest, high_open=False)
                    break
            found, more = page(self.scan(piece, ordered=False), limit - len(rows))
            rows += found
            if more or piece is over:
                return rows, more
            over, reach = replace(over, low=piece.high, low_open=True), 2 * reach

    def multi_get(self, keys: DataFrame | Iterable[bytes]) -> DataFrame:
        """(key, value) of each distinct key asked for, null where it isn't live. Few keys reach the scan as a list."""
        if isinstance(keys, DataFrame):
            return resolve.multi_get(self.entries(), keys)
        keys = sorted(set(keys))
        wanted = self.spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
        over = Range(keys[0], keys[-1], high_open=False) if keys else Range(b"", b"")
        found = self.entries(over)
        return resolve.multi_get(found.where(F.col("key").isin([F.lit(k) for k in keys])) if len(keys) <= 1000 else found, wanted)

    # Maintenance

    def compact(self, most: int = 1000) -> int:
        """Take steps until none is due, ``most`` at the utmost; returns how many were taken. What is left is for the next call: ``compaction_due``."""
        for n in range(most):
            if (step := pick(self.catalog, self.options)) is None:
                return n
            self._merge(step)
        return most

    @property
    def compaction_due(self) -> bool:
        return pick(self.catalog, self.options) is not None

    def _merge(self, step: Step) -> None:
        runs = []
        if step.inputs:
            merged = resolve.latest(self._read([r.path for r in step.inputs]))
            merged = merged.where(F.col("kind") == PUT) if step.drop_tombstones else merged
            files = max(1, -(-sum(r.size for r in step.inputs) // self.options.target_file_bytes))
            runs = self._write(merged, step.to, files, sum(r.count for r in step.inputs))
        self._commit(self.catalog.swapped([*step.inputs, *step.moved], [*(replace(r, level=step.to) for r in step.moved), *runs]))

    def vacuum(self) -> int:
        """Delete catalogs but the last ``keep_versions``, and the files of runs that no kept catalog refers to; returns the number of runs' files and folders deleted."""
        names = [n for n in self.files.list("catalog") if n.endswith(".json")]
        for n in names[: -self.options.keep_versions]:
            self.files.remove(f"catalog/{n}")
        used = {r.path for n in names[-self.options.keep_versions :] for r in Catalog.from_json(self.files.read(f"catalog/{n}")).runs}
        folders, gone = {p.split("/")[1] for p in used}, []
        for d in self.files.list("runs"):
            if d not in folders:
                gone.append(f"runs/{d}")
            elif f"runs/{d}" not in used:
                inner = [n for n in self.files.list(f"runs/{d}") if n.endswith(".parquet") or n.startswith("batch=")]
                gone += [f"runs/{d}/{n}" for n in inner if f"runs/{d}/{n}" not in used]
        for p in gone:
            self.files.remove(p)
        self._frames.clear()
        return len(gone)

    def verify(self) -> dict[str, int]:
        """Count runs and stored entries, after reading all of them against the catalog: counts, ends, digests, unique keys. Parquet's filters aren't read."""
        out = {"tables": len(self.catalog.runs), "entries": sum(r.count for r in self.catalog.runs)}
        if not self.catalog.runs:
            return out
        entries = self.run_entries().withColumnRenamed("run_id", "_run")
        try:
            found = {r["_run"]: r for r in self._measured(entries).collect()}
            twice = entries.groupBy("_run", "key").count().where("count > 1").limit(1).collect()
        except Exception as e:
            raise CorruptionError(f"a run can't be read: {str(e)[:300]}") from e
        if twice:
            raise CorruptionError(f"run {twice[0]['_run']} holds a key twice")
        for r in self.catalog.runs:
            f = found.get(r.id)
            if f is None or (bytes(f["smallest"]), bytes(f["largest"]), f["first_seqno"], f["last_seqno"], f["count"], f["digest"]) != (r.smallest, r.largest, r.first_seqno, r.last_seqno, r.count, r.digest):
                raise CorruptionError(f"run {r.id} isn't what the catalog says")
        return out

    def stats(self) -> dict:
        """Sequence number, buffer, totals, and files and bytes of level 0 and of each level that has runs."""
        levels = [(n, len(self.catalog.at(n)), sum(r.size for r in self.catalog.at(n))) for n in range(self.catalog.deepest + 1) if n == 0 or self.catalog.at(n)]
        return {"next_seqno": self.next_seqno, "memtable_keys": len(self.buffer), "memtable_bytes": self.buffered_bytes, "total_files": len(self.catalog.runs), "total_bytes": sum(r.size for r in self.catalog.runs), "levels": levels}

    def close(self) -> None:
        """Flush and release; doesn't compact."""
        if not self.closed:
            self.flush()
            self.abandon()

    def abandon(self) -> None:
        """Release without flushing; the log brings the buffer back."""
        if not self.closed:
            self.closed = True
            self.files.remove("LOCK")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
