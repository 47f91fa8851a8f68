"""Each query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(table):
    table = table.select(sorted(table.column_names))
    return sorted(tuple(map(repr, r.values())) for r in table.to_pylist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    want = duck.sql(entry.oracle_sql()[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert rows(entry.queries()[name](spark, SF).toArrow()) == rows(want)


def test_a_query_makes_only_the_store_that_it_asks(spark, monkeypatch):
    made, new = [], entry.core.Store.write_batches
    monkeypatch.setattr(entry.core, "_made", {})
    monkeypatch.setattr(entry.core.Store, "write_batches", lambda self, ops: (made.append(self.files.root.rpartition("/")[2]), new(self, ops))[1])
    for name, store in (("run_meta", ["runs"]), ("overlapping_runs", []), ("resume_seqno", ["logged"]), ("point_get", [])):
        entry.queries()[name](spark, SF).collect()
        assert made == store, name
        made.clear()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
