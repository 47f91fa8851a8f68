"""Command line of a store: put, get, del, scan, compact, stats, verify, demo, serve."""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from .errors import InvalidError, StoreError
from .options import Options
from .server import Server
from .store import Store


def _show(stats: dict) -> None:
    for k, v in stats.items():
        if k != "levels":
            print(f"{k}: {v}")
    for n, files, size in stats["levels"]:
        print(f"level {n}: {files} files, {size} bytes")


def _demo(spark: SparkSession, path: str) -> None:
    with Store(spark, path, Options(memtable_bytes=64 << 10)) as store:
        if store.catalog.runs or store.buffer:
            raise InvalidError(f"{path} holds a store; the demo wants a new folder")
        for start in range(0, 4000, 500):
            store.write([(0, f"key{i % 400:05d}".encode(), f"value-{i}".encode()) for i in range(start, start + 500)])
        store.write([(1, f"key{i:05d}".encode(), b"") for i in range(0, 400, 7)])
        store.flush()
        store.compact()
        rows = store.scan().collect()
        print(f"{len(rows)} live keys")
        for r in rows[:5]:
            print(f"{bytes(r['key']).decode()}={bytes(r['value']).decode()}")
        _show(store.stats())


def _serve(store: Store, bind: str, stop_file: str) -> None:
    """Until the file appears, or an interrupt."""
    host, _, port = bind.rpartition(":")
    with Server(store, host, int(port)) as server:
        print("listening on %s:%d" % server.address, flush=True)
        try:
            while not (stop_file and os.path.exists(stop_file)):
                time.sleep(0.2)
        except KeyboardInterrupt:
            pass
    print("stopped")


def main(argv: list[str] | None = None, session: Callable[[], SparkSession] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ordkv", description=__doc__)
    parser.add_argument("--path", "-p", default="ordkv-data")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, args in {"put": ["key", "value"], "get": ["key"], "del": ["key"], "scan": ["prefix?"], "compact": [], "stats": [], "verify": [], "demo": []}.items():
        one = sub.add_parser(name)
        for a in args:
            one.add_argument(a.rstrip("?"), **({"nargs": "?", "default": ""} if a.endswith("?") else {}))
    one = sub.add_parser("serve")
    one.add_argument("--bind", "-b", default="127.0.0.1:7700")
    one.add_argument("--stop-file", default="", help="serving ends when this file appears")
    limits = {"max_frame_bytes": "--max-frame", "max_scan_page": "--max-scan", "max_tx_bytes": "--max-tx", "memtable_bytes": "--memtable"}
    for name, flag in limits.items():
        one.add_argument(flag, dest=name, type=int, default=getattr(Options(), name))
    a = parser.parse_args(argv)
    spark = session() if session else SparkSession.builder.getOrCreate()
    try:
        if a.command == "demo":
            _demo(spark, a.path)
            return 0
        options = Options(**{name: getattr(a, name) for name in limits}) if a.command == "serve" else None
        with Store(spark, a.path, options) as store:
            if a.command == "put":
                store.put(a.key.encode(), a.value.encode())
                print("ok")
            elif a.command == "del":
                store.delete(a.key.encode())
                print("ok")
            elif a.command == "get":
                value = store.get(a.key.encode())
                print("(nil)" if value is None else value.decode(errors="replace"))
            elif a.command == "scan":
                n = 0
                for r in store.prefix(a.prefix.encode()).toLocalIterator():
                    print(f"{bytes(r['key']).decode(errors='replace')}={bytes(r['value']).decode(errors='replace')}")
                    n += 1
                print(f"{n} keys", file=sys.stderr)
            elif a.command == "compact":
                store.compact()
                _show(store.stats())
            elif a.command == "stats":
                _show(store.stats())
            elif a.command == "serve":
                _serve(store, a.bind, a.stop_file)
            elif a.command == "verify":
                found = store.verify()
                print(f"ok: {found['tables']} tables, {found['entries']} entries")
    except StoreError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
