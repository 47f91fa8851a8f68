"""The driver's queries: the tables as change logs in stores, asked through the engine's own interface, and the same in DuckDB SQL.

Events are numbered from 0 without gaps, so that the store's sequence numbers are ``event_id + 1``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .client import Client
from .functions import codecs
from .functions.ranges import Range
from .operators import resolve
from .options import Options
from .server import Server
from .session import Session
from .shared import removed_at_exit, shared_root
from .sources.formats import log_files, replay
from .store import Store

OPS_SQL = """ops AS (SELECT 'user:' || lpad(cast(user_id AS varchar), 6, '0') AS key, event_id + 1 AS seqno,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS kind, CASE WHEN event_type = 'error' THEN '' ELSE event_type || ':' || props END AS value FROM events)"""
LATEST_SQL = OPS_SQL + """,
latest AS (SELECT key, seqno, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC) AS rn FROM ops) t WHERE rn = 1)"""
RUNS_SQL = OPS_SQL + """,
runs AS (SELECT cast(floor((seqno - 1) / 500) AS bigint) AS run_id, key, max(seqno) AS seqno, max_by(kind, seqno) AS kind, max_by(value, seqno) AS value FROM ops GROUP BY 1, 2)"""


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: key is the user, an error event is a tombstone."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    gone = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), (F.col("event_id") + 1).alias("seqno"),
        F.when(gone, 1).otherwise(0).alias("kind"), F.when(gone, "").otherwise(F.concat("event_type", F.lit(":"), "props")).alias("value"),
    )


#: Writes of a run, runs of the lower level; stores that never compact of their own, and needn't outlive a crash.
RUN, LOWER = 500, 16
_QUIET = Options(l0_trigger=1 << 30, sync=False)


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as batches for a store."""
    o = ops(spark, sf_dir)
    return o.select(
        F.floor((F.col("seqno") - 1) / RUN).alias("batch"), F.col("seqno").alias("ord"), F.col("kind").cast("byte").alias("kind"),
        F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"),
    )


def _folder(spark: SparkSession) -> str:
    path = f"{shared_root(spark)}/stores-{uuid.uuid4().hex}"
    removed_at_exit(spark, path)
    return path


@dataclass(frozen=True)
class _Stores:
    """The same log in three stores, each made in the shared folder when it is first asked for."""

    spark: SparkSession
    sf_dir: str

    def _new(self, name: str, *parts: DataFrame) -> Store:
        store = Store(self.spark, f"{_folder(self.spark)}/{name}", _QUIET)
        for p in parts:
            store.write_batches(p)
        return store

    @cached_property
    def logged(self) -> Store:
        """Runs and a last batch that only the write-ahead log holds, replayed."""
        log = _batches(self.spark, self.sf_dir)
        last = log.agg(F.max("batch")).first()[0]
        made = self._new("logged", log.where(F.col("batch") < F.lit(last)))
        made.write([(r["kind"], bytes(r["key"]), bytes(r["value"])) for r in log.where(F.col("batch") == F.lit(last)).orderBy("ord").collect()])  # a batch at most
        made.abandon()
        return Store.open(self.spark, made.files.root, _QUIET)

    @cached_property
    def runs(self) -> Store:
        """Runs alone."""
        return self._new("runs", _batches(self.spark, self.sf_dir))

    @cached_property
    def levels(self) -> Store:
        """Two levels."""
        log = _batches(self.spark, self.sf_dir)
        made = self._new("levels", log.where(F.col("batch") < LOWER))
        made.options = replace(_QUIET, l0_trigger=1)
        made.compact()
        made.options = _QUIET
        made.write_batches(log.where(F.col("batch") >= LOWER))
        return made


_made: dict[tuple[str, str], _Stores] = {}


def stores(spark: SparkSession, sf_dir: str) -> _Stores:
    """Made once for each session and table."""
    return _made.setdefault((spark.sparkContext.applicationId, sf_dir), _Stores(spark, sf_dir))


def _text(df: DataFrame) -> DataFrame:
    """Keys and values as strings."""
    return df.withColumns({c: F.decode(c, "UTF-8") for c in ("key", "value") if c in df.columns})


def _pairs(spark: SparkSession, rows: Iterable[tuple[bytes, bytes]]) -> DataFrame:
    return spark.createDataFrame([(k.decode(), v.decode()) for k, v in rows], "key string, value string")


def _scan(over: Range) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _text(stores(spark, sf_dir).logged.scan(over, ordered=False))


def _live_sql(where: str = "true") -> str:
    return f"WITH {LATEST_SQL} SELECT key, value FROM latest WHERE kind = 0 AND {where}"


_LOW, _HIGH = b"user:000010", b"user:000030"
_RANGES = {
    "live_scan": (Range(), "true"),
    "range_half_open": (Range(_LOW, _HIGH), "key >= 'user:000010' AND key < 'user:000030'"),
    "range_closed": (Range(_LOW, _HIGH, high_open=False), "key >= 'user:000010' AND key <= 'user:000030'"),
    "range_open_low": (Range(_LOW, _HIGH, low_open=True, high_open=False), "key > 'user:000010' AND key <= 'user:000030'"),
    "range_unbounded_low": (Range(None, _HIGH), "key < 'user:000030'"),
    "range_unbounded_high": (Range(_HIGH), "key >= 'user:000030'"),
    "range_inverted": (Range(_HIGH, _LOW), "key >= 'user:000030' AND key < 'user:000010'"),
}

_KEY = b"user:000042"
_AFTER = Range(b"user:000020", low_open=True)
_GET = ["user:000001", "user:000042", "user:999999"]


def _point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = stores(spark, sf_dir).logged.get(_KEY)
    return _pairs(spark, [] if value is None else [(_KEY, value)])


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = stores(spark, sf_dir).logged.page(_AFTER, 10)
    return _pairs(spark, [(bytes(r["key"]), bytes(r["value"])) for r in rows])


def _has_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(stores(spark, sf_dir).logged.page(_AFTER, 10)[1],)], "has_more boolean")


def _multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(bytearray(k.encode()),) for k in _GET], "key binary")
    return _text(stores(spark, sf_dir).logged.multi_get(wanted))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored entries with the number of their run, from 0."""
    found = stores(spark, sf_dir).runs.run_entries()
    return _text(found).select((F.col("run_id") - 1).alias("run_id"), "key", "seqno", F.col("kind").cast("int").alias("kind"), "value")


def _run_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r.id - 1, r.smallest.decode(), r.largest.decode(), r.first_seqno, r.last_seqno, r.count) for r in stores(spark, sf_dir).runs.catalog.runs]
    return spark.createDataFrame(rows, "run_id long, smallest_key string, largest_key string, smallest_seqno long, largest_seqno long, count long")


def _overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stores(spark, sf_dir).runs.catalog.pruned(Range(_KEY, _KEY, high_open=False))
    return spark.createDataFrame([(r.id - 1,) for r in found], "run_id long")


def _level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = stores(spark, sf_dir).levels
    return spark.createDataFrame([(n, files, sum(r.count for r in store.catalog.at(n))) for n, files, _ in store.stats()["levels"] if files], "level int, files long, entries long")


def _verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the store's own check of every stored entry, what its catalog says of each run."""
    store = stores(spark, sf_dir).runs
    store.verify()
    return spark.createDataFrame([(r.id - 1, r.count, r.tombstones) for r in store.catalog.runs], "run_id long, entries long, tombstones long")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs each merged into one, tombstones kept."""
    grouped = _entries(spark, sf_dir).withColumn("run_id", F.floor(F.col("run_id") / 4)).withColumnRenamed("run_id", "merged")
    return resolve.latest(grouped, ["merged", "key"])


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds after everything went to the bottom: a fresh store, as compaction changes it."""
    store = Store(spark, f"{_folder(spark)}/bottom", _QUIET)
    store.write_batches(_batches(spark, sf_dir))
    store.options = replace(_QUIET, l0_trigger=1)
    store.compact()
    return _text(store.run_entries()).select("key", "seqno", F.col("kind").cast("int").alias("kind"), "value")


def _torn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write-ahead log for each run, one record of each damaged at a place that the run's number tells; what replay gives of all."""
    o = ops(spark, sf_dir)
    entries = o.select(F.floor((F.col("seqno") - 1) / RUN).alias("run_id"), F.encode("key", "UTF-8").alias("key"), "seqno", "kind", F.encode("value", "UTF-8").alias("value"))
    logs = log_files(entries, "run_id").withColumn("at", F.expr(f"CAST((7 * (CAST(split(path, '[.]')[0] AS BIGINT) + 1) + 350) % {RUN} AS INT)"))
    end = F.expr("aggregate(slice(sizes, 1, at + 1), 0, (x, y) -> x + y)")
    flipped = F.when(F.expr("substring(content, end, 1) = X'00'"), F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    damaged = F.when(F.col("at") < F.size("sizes"), F.concat(F.expr("substring(content, 1, end - 1)"), flipped, F.expr("substring(content, end + 1)"))).otherwise(F.col("content"))
    found = replay(logs.withColumn("end", end).select("path", damaged.alias("content")))
    return _text(found).select("key", "seqno", F.col("kind").cast("int").alias("kind"))


def _by_codec(f: Callable[[object], int]) -> Callable[[Column], Column]:
    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return x.map(f)

    return run


def _bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each run, keys and how many of them its filter, written and read back, lets through: all."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        bloom = codecs.Bloom.sized(len(x), 10)
        for k in x["key"]:
            bloom.add(bytes(k))
        read = codecs.Bloom.from_bytes(bloom.to_bytes())
        return pd.DataFrame([(x["run_id"].iloc[0] - 1, len(x), sum(bytes(k) in read for k in x["key"]))], columns=["run_id", "keys", "found"])

    return stores(spark, sf_dir).runs.run_entries().select("run_id", "key").groupBy("run_id").applyInPandas(run, "run_id long, keys long, found long")


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[bytes, bytes, int]]:
    """A small table whole: it has the same rows at every size."""
    return [(r["n_name"].encode(), str(r["n_nationkey"]).encode(), r["n_regionkey"]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]


def _transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction puts all nations and deletes those of region 0, another that overwrites them is aborted."""
    with Store(spark, f"{_folder(spark)}/tx") as store, Session(store) as session:
        session.begin()
        for k, v, region in _nations(spark, sf_dir):
            session.put(k, v)
            if region == 0:
                session.delete(k)
        session.commit()
        session.begin()
        for k, _, _ in _nations(spark, sf_dir):
            session.put(k, b"lost")
        session.abort()
        return _pairs(spark, list(session.scan(size=7)))


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations put, and a range of them scanned in pages, over the wire."""
    with Store(spark, f"{_folder(spark)}/served") as store, Server(store) as server, Client(*server.address) as client:
        client.begin()
        for k, v, _ in _nations(spark, sf_dir):
            client.put(k, v)
        client.commit()
        return _pairs(spark, list(client.scan(Range(b"NATION_1", b"NATION_2"), size=4)))


# CRC-32 with the reflected polynomial 0xEDB88320, a byte at a time through its table of 256.
_CRC_SQL = f"""WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS step FROM bits WHERE k = 8), {OPS_SQL},
b AS (SELECT seqno, list_transform(regexp_extract_all(hex(encode(value)), '..'), lambda y: ('0x' || y)::BIGINT) AS bytes FROM ops)
SELECT seqno, xor(list_reduce(list_concat([4294967295], bytes), lambda acc, v: xor(acc // 256, step[xor(acc % 256, v) + 1])), 4294967295)::BIGINT AS crc FROM b, crc"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    **{k: (_scan(r), _live_sql(w)) for k, (r, w) in _RANGES.items()},
    "point_get": (_point_get, _live_sql("key = 'user:000042'")),
    "prefix_scan": (lambda s, d: _text(stores(s, d).logged.prefix(b"user:00001")), _live_sql("starts_with(key, 'user:00001')")),
    "tombstones": (lambda s, d: _text(resolve.tombstones(stores(s, d).logged.latest())), f"WITH {LATEST_SQL} SELECT key, seqno FROM latest WHERE kind = 1"),
    "page": (_page, _live_sql("key > 'user:000020'") + " ORDER BY key LIMIT 10"),
    "has_more": (_has_more, f"SELECT count(*) > 10 AS has_more FROM ({_live_sql("key > 'user:000020'")} ORDER BY key LIMIT 11)"),
    "multi_get": (_multi_get, f"WITH {LATEST_SQL}, k(key) AS (VALUES {', '.join(f"('{k}')" for k in _GET)}) SELECT k.key, l.value FROM k LEFT JOIN (SELECT * FROM latest WHERE kind = 0) l ON k.key = l.key"),
    "run_meta": (_run_meta, f"WITH {RUNS_SQL} SELECT run_id, min(key) AS smallest_key, max(key) AS largest_key, min(seqno) AS smallest_seqno, max(seqno) AS largest_seqno, count(*) AS count FROM runs GROUP BY 1"),
    "batch_last_wins": (_entries, f"WITH {RUNS_SQL} SELECT * FROM runs"),
    "merge_keep_tombstones": (_groups, f"WITH {RUNS_SQL} SELECT run_id // 4 AS merged, key, max(seqno) AS seqno, max_by(kind, seqno) AS kind, max_by(value, seqno) AS value FROM runs GROUP BY 1, 2"),
    "merge_drop_tombstones": (_compacted, f"WITH {RUNS_SQL} SELECT * FROM (SELECT key, max(seqno) AS seqno, max_by(kind, seqno) AS kind, max_by(value, seqno) AS value FROM runs GROUP BY key) WHERE kind = 0"),
    # A key whose newest version in the lower level was a tombstone is not there any more, unless the upper level has it.
    "merge_levels": (
        lambda s, d: _text(stores(s, d).levels.latest()).withColumn("kind", F.col("kind").cast("int")),
        f"WITH {RUNS_SQL}, lower_kept AS (SELECT key, max(seqno) AS seqno, max_by(kind, seqno) AS kind, max_by(value, seqno) AS value FROM runs WHERE run_id < {LOWER} GROUP BY key HAVING max_by(kind, seqno) = 0), "
        f"both_levels AS (SELECT * FROM lower_kept UNION ALL SELECT key, seqno, kind, value FROM runs WHERE run_id >= {LOWER}) "
        "SELECT key, max(seqno) AS seqno, max_by(kind, seqno) AS kind, max_by(value, seqno) AS value FROM both_levels GROUP BY key",
    ),
    "latest_by_window": (lambda s, d: _text(resolve.latest_by_window(stores(s, d).runs.entries())).withColumn("kind", F.col("kind").cast("int")), f"WITH {LATEST_SQL} SELECT key, seqno, kind, value FROM latest"),
    "memtable_bytes": (lambda s, d: resolve.memtable_bytes(ops(s, d)), f"WITH {LATEST_SQL} SELECT cast(sum(octet_length(encode(key)) + octet_length(encode(value)) + 24) AS bigint) AS bytes FROM latest"),
    "shadowed_versions": (lambda s, d: _text(resolve.shadowed(stores(s, d).runs.entries())), f"WITH {RUNS_SQL} SELECT key, count(*) AS versions, count(*) - 1 AS shadowed FROM runs GROUP BY key"),
    "overlapping_runs": (_overlapping, f"WITH {RUNS_SQL} SELECT run_id FROM runs GROUP BY 1 HAVING min(key) <= 'user:000042' AND max(key) >= 'user:000042'"),
    "level_stats": (
        _level_stats,
        f"WITH {RUNS_SQL}, lower_kept AS (SELECT key FROM runs WHERE run_id < {LOWER} GROUP BY key HAVING max_by(kind, seqno) = 0) "
        f"SELECT 0::INT AS level, count(DISTINCT run_id) AS files, count(*) AS entries FROM runs WHERE run_id >= {LOWER} HAVING count(*) > 0 UNION ALL SELECT 1::INT, 1, count(*) FROM lower_kept HAVING count(*) > 0",
    ),
    "verify_counts": (_verify, f"WITH {RUNS_SQL} SELECT run_id, count(*) AS entries, cast(sum(kind) AS bigint) AS tombstones FROM runs GROUP BY 1"),
    "wal_prefix": (_torn, f"WITH {OPS_SQL} SELECT key, seqno, kind FROM ops WHERE (seqno - 1) % {RUN} < (7 * ((seqno - 1) // {RUN} + 1) + 350) % {RUN}"),
    "resume_seqno": (lambda s, d: s.createDataFrame([(stores(s, d).logged.next_seqno,)], "next_seqno long"), "SELECT count(*) + 1 AS next_seqno FROM events"),
    "varint_lengths": (
        lambda s, d: ops(s, d).select("seqno", _by_codec(lambda n: len(codecs.varint(int(n))))(F.col("seqno")).alias("bytes")),
        f"WITH {OPS_SQL} SELECT seqno, cast(ceil(length(bin(seqno)) / 7.0) AS bigint) AS bytes FROM ops",
    ),
    "crc32": (lambda s, d: ops(s, d).select("seqno", _by_codec(lambda v: codecs.crc32(bytes(v)))(F.encode("value", "UTF-8")).alias("crc")), _CRC_SQL),
    "bloom_membership": (_bloom, f"WITH {RUNS_SQL} SELECT run_id, count(*) AS keys, count(*) AS found FROM runs GROUP BY 1"),
    "transaction": (_transaction, "SELECT n_name AS key, n_nationkey::VARCHAR AS value FROM nation WHERE n_regionkey <> 0"),
    "served_scan": (_served, "SELECT n_name AS key, n_nationkey::VARCHAR AS value FROM nation WHERE n_name >= 'NATION_1' AND n_name < 'NATION_2'"),
    "orders_latest": (
        lambda s, d: resolve.latest(s.read.parquet(f"{d}/orders.parquet").select("o_custkey", F.col("o_orderkey").alias("seqno"), "o_orderpriority"), ["o_custkey"]),
        "SELECT o_custkey, max(o_orderkey) AS seqno, max_by(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
