"""Syncs, the lock, compaction at size, vacuum, pages, batches."""

import os
import threading
import time
from dataclasses import replace

import pytest

from ordkv import files as files_module
from ordkv.errors import StoreError
from ordkv.functions.ranges import Range
from ordkv.options import Options
from ordkv.plans.catalog import Catalog, Run
from ordkv.plans.compaction import pick
from ordkv.store import Store

QUIET = Options(sync=False, l0_trigger=1 << 30)
BATCH = "batch long, ord long, kind byte, key binary, value binary"


def run_of(i, level, lo, hi, size=10, tombstones=0):
    return Run(i, level, f"runs/{i:06d}", lo, hi, 1, 2, size, 1, 0, tombstones)


@pytest.fixture
def synced(monkeypatch):
    """Paths that were synced, in order, with what the folder of runs or the log held then."""
    seen, real = [], os.fsync

    def fsync(at):
        seen.append(os.readlink(f"/proc/self/fd/{at}"))
        real(at)

    monkeypatch.setattr(files_module.os, "fsync", fsync)
    return seen


def test_what_is_acknowledged_is_synced(spark, tmp_path, synced):
    path = str(tmp_path / "s")
    with Store(spark, path) as store:
        synced.clear()
        store.put(b"a", b"1")
        assert any("/log/" in p and ".wal" in p for p in synced) and f"{path}/log" in synced
        synced.clear()
        commit = store._commit
        before = []
        store._commit = lambda catalog: (before.extend(synced), commit(catalog))
        store.flush()
        parquet = [str(p) for p in (tmp_path / "s" / "runs").rglob("*.parquet")]
        assert parquet and set(parquet) <= set(before) and os.path.dirname(parquet[0]) in before and f"{path}/runs" in before
        assert any("/catalog/" in p for p in synced[len(before) :]) and f"{path}/catalog" in synced
        assert os.listdir(f"{path}/log") == []


def test_no_sync_where_it_is_off(spark, tmp_path, synced):
    with Store(spark, str(tmp_path / "s"), QUIET) as store:
        store.put(b"a", b"1")
        store.flush()
        assert synced == []


def test_one_of_racing_openers_wins(spark, tmp_path):
    path, won, lost, start = str(tmp_path / "s"), [], [], threading.Barrier(6)

    def opened():
        start.wait()
        try:
            won.append(Store(spark, path, QUIET))
        except StoreError:
            lost.append(1)

    threads = [threading.Thread(target=opened) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 5
    won[0].close()
    Store(spark, path, QUIET).close()


def settle(catalog, options):
    """Steps until none is due, as if each merge kept all bytes; and the merges among them."""
    steps, merges, free = 0, 0, max(r.id for r in catalog.runs) + 1
    while (step := pick(catalog, options)) is not None:
        steps += 1
        new = [replace(r, level=step.to) for r in step.moved]
        if step.inputs:
            merges += 1
            by = sorted(step.inputs, key=lambda r: r.smallest)
            total, n = sum(r.size for r in by), max(1, -(-sum(r.size for r in by) // options.target_file_bytes))
            ends = sorted({k for r in by for k in r.keys})
            cuts = [ends[i * (len(ends) - 1) // n] for i in range(n + 1)]
            for i in range(n):
                lo = cuts[i] if i == 0 else cuts[i] + b"\0"
                if lo <= cuts[i + 1]:
                    new.append(run_of(free, step.to, lo, cuts[i + 1], total // n))
                    free += 1
        catalog = catalog.swapped([*step.inputs, *step.moved], new)
        for level in range(1, catalog.deepest + 1):
            runs = sorted(catalog.at(level), key=lambda r: r.smallest)
            assert all(a.largest < b.smallest for a, b in zip(runs, runs[1:], strict=False))
    return catalog, steps, merges


def test_compaction_settles_at_size():
    options, n = Options(), 50_000
    key = lambda i: b"%010d" % i
    catalog = Catalog(runs=tuple(run_of(i + 1, 1, key(10 * i), key(10 * i + 5), 4 << 20) for i in range(n)))
    start = time.time()
    found, steps, merges = settle(catalog, options)
    assert steps < 100 and merges == 0 and time.time() - start < 10 and len(found.runs) == n
    below = [run_of(n + i + 1, 2, key(100 * i + 3), key(100 * i + 99), 64 << 20) for i in range(n // 10)]
    start = time.time()
    found, steps, merges = settle(Catalog(runs=(*catalog.runs, *below)), options)
    assert steps < 100 and time.time() - start < 10 and all(sum(r.size for r in found.at(k)) <= options.level_budget(k) for k in range(1, found.deepest))


def test_moves_and_merges_of_a_level():
    options = Options(memtable_bytes=10, l0_trigger=2, level_multiplier=2)
    upper, below = [run_of(1, 1, b"a", b"b", 15), run_of(2, 1, b"c", b"d", 15)], run_of(3, 2, b"a", b"b", 9)
    step = pick(Catalog(runs=(*upper, below)), options)
    assert (step.inputs, step.moved, step.to) == ((), (upper[1],), 2)
    # To the bottom a run with tombstones, or of an older catalog, is rewritten, so that they go.
    for unknown in (1, -1):
        step = pick(Catalog(runs=(upper[0], replace(upper[1], tombstones=unknown), below)), options)
        assert ([r.id for r in step.inputs], step.moved, step.drop_tombstones) == ([2], (), True)
    step = pick(Catalog(runs=(upper[0], replace(upper[1], tombstones=1), below, run_of(4, 3, b"x", b"y"))), options)
    assert step.moved[0].id == 2


def test_batches_become_runs_at_once(spark, tmp_path):
    rows = [(i // 5, i, int(i % 4 == 3), bytearray(b"k%d" % (i % 7)), bytearray(b"v%d" % i)) for i in range(23)]
    with Store(spark, str(tmp_path / "s"), QUIET) as store:
        store.put(b"before", b"x")
        store.write_batches(spark.createDataFrame(rows, BATCH).repartition(3))
        assert store.next_seqno == 25 and [r.level for r in store.catalog.runs] == [0] * 6
        assert [(r.first_seqno, r.last_seqno) for r in store.catalog.runs][1:] == [(2, 6), (7, 11), (12, 16), (17, 21), (22, 24)]
        truth = {b"before": b"x"}
        for _, _, kind, k, v in rows:
            truth.pop(bytes(k), None) if kind else truth.__setitem__(bytes(k), bytes(v))
        assert {bytes(r["key"]): bytes(r["value"]) for r in store.scan().collect()} == truth
        assert store.verify() == {"tables": 6, "entries": 24}
        assert sorted({r["run_id"] for r in store.run_entries().collect()}) == [r.id for r in store.catalog.runs]
        store.options = replace(QUIET, l0_trigger=1)
        assert store.compaction_due and store.compact() == 1 and not store.compaction_due
        assert {bytes(r["key"]): bytes(r["value"]) for r in store.scan().collect()} == truth
        for k in (b"k0", b"k3", b"nokey", b"before"):
            assert store.get(k) == truth.get(k)
        wanted = spark.createDataFrame([(bytearray(k),) for k in (b"k1", b"k1", b"nokey")], "key binary")
        assert {bytes(r["key"]): r["value"] and bytes(r["value"]) for r in store.multi_get(wanted).collect()} == {b"k1": truth.get(b"k1"), b"nokey": None}


def test_filters_of_small_batches_are_small(spark, tmp_path):
    """A file's filter fits its own keys, however many other batches hold."""
    rows = spark.range(40_200).selectExpr("CASE WHEN id < 40000 THEN -1 ELSE (id - 40000) div 20 END AS batch", "id AS ord", "0Y AS kind", "encode(concat('key', id), 'UTF-8') AS key", "X'' AS value")
    with Store(spark, str(tmp_path / "s"), QUIET) as store:
        store.write_batches(rows)
        files = {r.count: sum(f.stat().st_size for f in (tmp_path / "s" / r.path).glob("*.parquet")) for r in store.catalog.runs}
        assert sorted(files) == [20, 40_000] and files[20] < 6_000 and files[40_000] > 40_000
        assert store.get(b"key7") == store.get(b"key40007") == b"" and store.get(b"key40200") is None
        store.verify()


def test_asked_keys_are_taken_before_versions_are_resolved(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), QUIET) as store:
        for n in range(2):
            store.write([(0, b"k%03d" % i, b"v%d" % n) for i in range(50)])
            store.flush()
        plan = store.multi_get(spark.createDataFrame([(bytearray(b"k001"),)], "key binary"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("LeftOuter") < plan.index("Aggregate [key") < plan.index("LeftSemi")


def test_pages_read_pieces_of_a_range(spark, tmp_path):
    options = replace(QUIET, target_file_bytes=2000)
    with Store(spark, str(tmp_path / "s"), options) as store:
        keys = [b"key%04d" % i for i in range(600)]
        store.write([(0, k, b"v" * 20) for k in keys])
        store.flush()
        store.options = replace(options, l0_trigger=1)
        store.compact()
        store.options = options
        store.write([(1, k, b"") for k in keys[100:400]])
        assert len(store.catalog.runs) > 5
        read, scan = [], store.scan
        store.scan = lambda over, ordered=True: (read.append(over), scan(over, ordered))[1]
        live = keys[:100] + keys[400:]
        rows, more = store.page(Range(), 7)
        assert ([bytes(r["key"]) for r in rows], more) == (live[:7], True) and read[0].high < keys[200]
        for over, limit in ((Range(keys[95]), 9), (Range(keys[390]), 300), (Range(keys[99], keys[401]), 5), (Range(None, None), 0), (Range(keys[150], keys[300]), 4)):
            rows, more = store.page(over, limit)
            want = [k for k in live if over.holds(k)]
            assert ([bytes(r["key"]) for r in rows], more) == (want[:limit], len(want) > limit)


def test_vacuum_frees_single_files(spark, tmp_path):
    options = replace(QUIET, target_file_bytes=2000, keep_versions=1, memtable_bytes=400, l0_trigger=1)
    with Store(spark, str(tmp_path / "s"), QUIET) as store:
        store.write([(0, b"key%04d" % i, b"v" * 20) for i in range(400)])
        store.flush()
        store.options = options
        step = pick(store.catalog, options)
        store._merge(step)
        store.vacuum()
        folder = tmp_path / "s" / store.catalog.runs[0].path
        before = len(list(folder.parent.glob("*.parquet")))
        first = store.catalog.runs[0]
        store._commit(store.catalog.swapped([first], []))
        assert store.vacuum() == 1 and not folder.exists() and len(list(folder.parent.glob("*.parquet"))) == before - 1
        assert store.scan().count() == 400 - first.count
