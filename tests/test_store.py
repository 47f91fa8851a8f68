"""The store against a dict: writes, reads, flush, compaction, recovery, damage, sessions, command line."""

import random

import pytest

from ordkv.cli import main
from ordkv.errors import CorruptionError, InvalidError, StateError, StoreError
from ordkv.functions import codecs
from ordkv.functions.ranges import Range
from ordkv.operators.paging import pages
from ordkv.options import Options
from ordkv.plans.catalog import Catalog, Run
from ordkv.plans.compaction import pick
from ordkv.schema import OPS
from ordkv.session import Session
from ordkv.sources.formats import read_catalogs, read_logs, read_runs
from ordkv.store import Store
from ordkv.streaming.ingest import ingest

SMALL = Options(memtable_bytes=2048, block_bytes=256, l0_trigger=3, level_multiplier=3, sync=False)


def content(frame):
    rows = [(bytes(r["key"]), bytes(r["value"])) for r in frame.collect()]
    assert rows == sorted(rows)
    return dict(rows)


@pytest.mark.parametrize("seed", [42])
def test_random_operations_match_a_dict(spark, tmp_path, seed):
    rng, truth = random.Random(seed), {}
    path = str(tmp_path / "s")
    store = Store(spark, path, SMALL)
    for step in range(9):
        ops = []
        for i in range(rng.randint(1, 25)):
            k = b"key%02d" % rng.randrange(40)
            if rng.random() < 0.7:
                ops.append((0, k, b"v%d-%d" % (step, i)))
                truth[k] = ops[-1][2]
            else:
                ops.append((1, k, b""))
                truth.pop(k, None)
        if step % 3 == 1:
            store.write_batch(spark.createDataFrame([(i, a, bytearray(k), bytearray(v)) for i, (a, k, v) in enumerate(ops)], OPS))
        else:
            store.write(ops)
        if step in (2, 5):
            store.flush()
        if step == 4:
            store.abandon()
            store = Store(spark, path, SMALL)
        assert content(store.scan()) == truth
        k = b"key%02d" % rng.randrange(40)
        assert store.get(k) == truth.get(k)
    want = {k: v for k, v in truth.items() if b"key10" <= k < b"key30"}
    assert content(store.scan(Range(b"key10", b"key30"))) == want
    store.flush()
    store.compact()
    assert content(store.scan()) == truth and content(store.prefix(b"key1")) == {k: v for k, v in truth.items() if k.startswith(b"key1")}
    assert store.verify()["tables"] == len(store.catalog.runs)
    assert {bytes(r["key"]): r["value"] and bytes(r["value"]) for r in store.multi_get([b"key01", b"nokey"]).collect()} == {b"key01": truth.get(b"key01"), b"nokey": None}
    store.close()


@pytest.mark.parametrize("seed", [1, 2, 7, 42, 12345])
def test_thousands_of_operations_match_a_dict(spark, tmp_path, seed):
    rng, truth, path = codecs.Rng(seed), {}, str(tmp_path / "s")
    store = Store(spark, path, SMALL)
    for step in range(1, 2501):
        k, v = b"key%02d" % rng.below(40), b"v%d-%d" % (step, rng.below(1_000_000))
        if rng.below(100) < 70:
            store.put(k, v)
            truth[k] = v
        else:
            store.delete(k)
            truth.pop(k, None)
        for i in range(6):
            k = b"key%02d" % rng.below(40)
            if k in store.buffer:  # known without a job
                assert store.get(k) == truth.get(k)
        if step % 625 == 0:
            store.flush()
        if step == 1250:
            store.compact()
        if step == 2000:
            store.abandon()
            store = Store(spark, path, SMALL)
        if step % 625 in (0, 300):
            assert content(store.scan()) == truth
            assert all(store.get(k) == truth.get(k) for k in (b"key%02d" % rng.below(40) for _ in range(2)))
    assert content(store.scan(Range(b"key10", b"key30"))) == {k: v for k, v in truth.items() if b"key10" <= k < b"key30"}
    assert store.next_seqno == 2501
    store.close()


def test_keys_values_and_ranges(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), SMALL) as store:
        keys = [b"", b"\0", b"a", b"a\0", b"a\xff", b"b", b"\x7f", b"\x80", b"\xff", b"\xff\xff"]
        store.write([(0, k, b"" if k == b"a" else k + b"!") for k in keys])
        store.delete(b"absent")
        seq = store.next_seqno
        for stored in (False, True):
            if stored:
                store.flush()
            assert list(content(store.scan())) == sorted(keys)
            assert store.get(b"a") == b"" and store.get(b"absent") is None and store.get(b"") == b"!"
            assert list(content(store.scan(Range(b"a", b"b")))) == [b"a", b"a\0", b"a\xff"]
            assert list(content(store.scan(Range(b"a", b"b", low_open=True, high_open=False)))) == [b"a\0", b"a\xff", b"b"]
            assert list(content(store.scan(Range(None, b"a")))) == [b"", b"\0"]
            assert content(store.scan(Range(b"b", b"a"))) == {}
            assert list(content(store.prefix(b"\xff"))) == [b"\xff", b"\xff\xff"] and len(content(store.prefix(b""))) == len(keys)
        assert store.next_seqno == seq == len(keys) + 2
        store.write([])
        assert store.next_seqno == seq
        got = [bytes(r["key"]) for rows in pages(lambda r: store.scan(r, ordered=False), Range(), 3) for r in rows]
        assert got == sorted(keys)
        with pytest.raises(InvalidError):
            store.write([(2, b"k", b"")])
        with pytest.raises(InvalidError):
            store.write_batch(spark.createDataFrame([(0, 5, bytearray(b"k"), None)], OPS))
        plan = store.scan(Range(b"a", b"b"))._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters" in plan and "GreaterThanOrEqual(key" in plan


def test_snapshots_outlive_writes_and_compaction(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), SMALL) as store:
        store.put(b"a", b"1")
        store.flush()
        old = store.scan()
        for i in range(4):
            store.put(b"a", b"new%d" % i)
            store.put(b"x", b"y")
            store.flush()
        store.compact()
        assert content(old) == {b"a": b"1"} and content(store.scan()) == {b"a": b"new3", b"x": b"y"}
        assert store.vacuum() == 0


def test_tombstones_stay_until_the_bottom(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), SMALL) as store:
        for i in range(3):
            store.write([(0, b"k%d" % j, b"v") for j in range(5)])
            store.flush()
        store.compact()
        assert [r.level for r in store.catalog.runs] == [1]
        store.delete(b"k0")
        store.flush()
        assert store.get(b"k0") is None and store.verify()["entries"] == 6
        for _ in range(2):
            store.write([(1, b"k%d" % j, b"") for j in range(5)])
            store.flush()
        store.compact()
        assert store.catalog.runs == () and content(store.scan()) == {} and store.verify() == {"tables": 0, "entries": 0}


def test_compaction_policy():
    run = lambda i, level, lo, hi, size=10: Run(i, level, f"runs/{i}", lo, hi, 1, 2, size, 1, 0)
    options = Options(memtable_bytes=10, l0_trigger=2, level_multiplier=2)
    assert pick(Catalog(runs=(run(1, 0, b"a", b"b"),)), options) is None
    step = pick(Catalog(runs=(run(1, 0, b"a", b"b"), run(2, 0, b"c", b"d"), run(3, 1, b"b", b"b"), run(4, 1, b"x", b"z"), run(5, 2, b"a", b"c"))), options)
    assert ([r.id for r in step.inputs], step.to, step.drop_tombstones) == ([1, 2, 3], 1, False)
    step = pick(Catalog(runs=(run(1, 1, b"a", b"b", 15), run(2, 1, b"c", b"d", 15), run(3, 2, b"a", b"b", 9))), options)
    assert ([r.id for r in step.inputs], step.to, step.drop_tombstones) == ([2], 2, True)


def test_recovery_from_torn_logs_and_lost_commits(spark, tmp_path):
    path = tmp_path / "s"
    store = Store(spark, str(path), SMALL)
    for i in range(5):
        store.write([(0, b"k%d" % i, b"v"), (0, b"m%d" % i, b"w")])
    store.abandon()
    last = sorted((path / "log").glob("*.wal"))[-1]
    last.write_bytes(last.read_bytes()[:-3])
    for f in (path / "log").glob(".*.crc"):
        f.unlink()
    store = Store(spark, str(path), SMALL)
    assert set(content(store.scan())) == {b"%c%d" % (c, i) for c in b"km" for i in range(4)}
    store.put(b"after", b"x")
    store.abandon()
    store = Store(spark, str(path), SMALL)
    assert store.get(b"after") == b"x" and store.next_seqno == 10
    # A crash after the run is written, before the catalog is.
    store._write(store._buffered(), 0, 1)
    store.abandon()
    store = Store(spark, str(path), SMALL)
    assert store.catalog.runs == () and store.get(b"after") == b"x"
    # A crash after the catalog is written, before the logs go.
    kept = {f.name: f.read_bytes() for f in (path / "log").glob("*.wal")}
    store.flush()
    store.abandon()
    for name, data in kept.items():
        (path / "log" / name).write_bytes(data)
    store = Store(spark, str(path), SMALL)
    assert store.buffer == {} and store.get(b"after") == b"x" and store.files.list("log") == []
    with pytest.raises(StoreError):
        Store(spark, str(path), SMALL)
    store.close()


def test_verify_finds_damage(spark, tmp_path):
    path = tmp_path / "s"
    with Store(spark, str(path), SMALL) as store:
        store.write([(0, b"k%04d" % i, b"v%d" % i) for i in range(20)])
        store.flush()
        assert store.verify() == {"tables": 1, "entries": 20}
        file = next((path / "runs").glob("*/part-*.parquet"))
        data = bytearray(file.read_bytes())
        data[20] ^= 0xFF
        file.write_bytes(data)
        with pytest.raises(CorruptionError):
            store.verify()
    name = sorted((path / "catalog").glob("*.json"))[-1]
    name.write_bytes(name.read_bytes().replace(b"runs", b"rums"))
    (name.parent / f".{name.name}.crc").unlink(missing_ok=True)
    with pytest.raises(CorruptionError):
        Store(spark, str(path), SMALL)


def test_options():
    for bad in ({"l0_trigger": 0}, {"max_scan_page": 0}, {"memtable_bytes": -1}, {"level_multiplier": 1}):
        with pytest.raises(InvalidError):
            Options(**bad)
    assert Options().level_budget(1) == 16 << 20 and Options().level_budget(2) == 160 << 20


def test_sessions(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), Options(sync=False, max_tx_bytes=300, max_scan_page=4)) as store, Session(store) as s, Session(store) as other:
        s.put(b"base", b"0")
        s.begin()
        with pytest.raises(StateError):
            s.begin()
        for i in range(3):
            s.put(b"tx_%d" % i, b"v")
        s.delete(b"base")
        assert s.get(b"tx_0") is None and other.get(b"base") == b"0" and store.next_seqno == 2
        s.commit()
        assert store.next_seqno == 6 and other.get(b"base") is None and other.get(b"tx_2") == b"v"
        for f in (s.commit, s.abort):
            with pytest.raises(StateError):
                f()
        s.begin()
        with pytest.raises(StateError):
            for i in range(9):
                s.put(b"big%d" % i, b"\xab" * 64)
        with pytest.raises(StateError):
            s.delete(b"tx_0")
        with pytest.raises(StateError):
            s.commit()
        s.begin()
        s.commit()
        s.begin()
        s.put(b"lost", b"1")
        s.abort()
        assert store.next_seqno == 6
        for i in range(6):
            s.put(b"p%d" % i, b"")
        assert s.page(limit=0) == ([(b"p%d" % i, b"") for i in range(4)], True)
        assert s.page(Range(b"tx"), 2) == ([(b"tx_0", b"v"), (b"tx_1", b"v")], True)
        assert len(list(s.scan(size=2))) == 9
        for request, want in ((codecs.request("get", b"tx_0"), codecs.answer(0, b"\x01v")), (codecs.request("get", b"no"), codecs.answer(1)), (codecs.request("put", b"k", b"v"), codecs.answer()), (codecs.request("ping"), codecs.answer())):
            assert s.handle(codecs.read_frame(request)[0]) == (want, True)
        assert s.handle(codecs.read_frame(codecs.request("commit"))[0])[1] and not s.handle(b"\x63")[1]
        body = codecs.read_frame(s.handle(codecs.read_frame(codecs.request("scan", limit=1))[0])[0])[0]
        assert codecs.decode_page(body[1:]) == ([(b"k", b"v")], True)
        assert codecs.decode_stats(codecs.read_frame(s.handle(codecs.read_frame(codecs.request("stats"))[0])[0])[0][1:])[0] == store.next_seqno


def test_foreign_files(spark, tmp_path):
    entries = [codecs.Entry(b"k%d" % i, i + 1, i % 2, b"" if i % 2 else b"v") for i in range(9)]
    (tmp_path / "wal.log").write_bytes(b"".join(map(codecs.log_frame, entries))[:-2])
    (tmp_path / "000001.sst").write_bytes(codecs.write_run(entries))
    (tmp_path / "MANIFEST").write_bytes(codecs.write_catalog(2, 10, [codecs.Table(0, 1, b"k0", b"k8", 1, 9, 5)]))
    as_entries = lambda df: sorted(((bytes(r.key), r.seqno, r.kind, bytes(r.value)) for r in df.collect()), key=lambda r: r[1])
    want = [(e.key, e.seqno, e.kind, e.value) for e in entries]
    assert as_entries(read_logs(spark, str(tmp_path))) == want[:-1] and as_entries(read_runs(spark, str(tmp_path))) == want
    assert read_catalogs(spark, str(tmp_path)).first()["next_seqno"] == 10


def test_streams(spark, tmp_path):
    ops = spark.createDataFrame([(i, i % 2, bytearray(b"k%d" % (i // 2 % 3)), bytearray(b"v%d" % i)) for i in range(8)], OPS)
    ops.write.parquet(str(tmp_path / "in"))
    with Store(spark, str(tmp_path / "s"), SMALL) as store:
        ingest(spark.readStream.schema(OPS).parquet(str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination()
        assert content(store.scan()) == {} and store.next_seqno == 9


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "s")
    run = lambda *a: main(["-p", path, *a], lambda: spark)
    assert [run("put", "a", "1"), run("put", "b", "2"), run("del", "a"), run("get", "a"), run("get", "b"), run("scan"), run("verify"), run("compact")] == [0] * 8
    out = capsys.readouterr()
    assert out.out.startswith("ok\nok\nok\n(nil)\n2\nb=2\nok: 3 tables, 3 entries\n") and "1 keys" in out.err
    assert run("demo") == 1
    with pytest.raises(SystemExit) as e:
        run("nothing")
    assert e.value.code == 2
