"""Foreign log, run and catalog files as DataFrames: parallel over files, sequential within one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions import codecs
from ..schema import ENTRY, MAX_SEQNO


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def _entries(found: list[codecs.Entry], path: str) -> pd.DataFrame:
    if any(e.seqno > MAX_SEQNO for e in found):
        raise codecs.CorruptionError(f"{path}: a sequence number over {MAX_SEQNO}")
    return pd.DataFrame([(e.key, e.seqno, e.kind, e.value) for e in found], columns=["key", "seqno", "kind", "value"])


def read_logs(spark: SparkSession, path: str, pattern: str = "*.log") -> DataFrame:
    """The entries of the valid prefix of each write-ahead log under a path."""
    return replay(_files(spark, path, pattern))


def replay(logs: DataFrame) -> DataFrame:
    """The entries of the valid prefix of each log of (path, content): none behind its first torn or damaged record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at, data in zip(x["path"], x["content"], strict=True):
                yield _entries(codecs.read_log(bytes(data))[0], at)

    return logs.select("path", "content").mapInPandas(run, ENTRY)


def log_files(entries: DataFrame, by: str) -> DataFrame:
    """(path, content): the entries as one write-ahead log for each value of ``by``, in order of seqno. A log is held in one row."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("seqno")
        frames = [codecs.log_frame(codecs.Entry(bytes(k), int(n), int(kind), bytes(v))) for k, n, kind, v in zip(x["key"], x["seqno"], x["kind"], x["value"], strict=True)]
        return pd.DataFrame([(f"{x[by].iloc[0]}.log", b"".join(frames), [len(f) for f in frames])], columns=["path", "content", "sizes"])

    return entries.select(by, "key", "seqno", "kind", "value").groupBy(by).applyInPandas(run, "path string, content binary, sizes array<int>")


def read_runs(spark: SparkSession, path: str, pattern: str = "*.sst") -> DataFrame:
    """The entries of the run files under a path; damage fails the query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at, data in zip(x["path"], x["content"], strict=True):
                yield _entries(list(codecs.RunFile(bytes(data))), at)

    return _files(spark, path, pattern).mapInPandas(run, ENTRY)


def read_catalogs(spark: SparkSession, path: str, pattern: str = "MANIFEST") -> DataFrame:
    """(path, next_file, next_seqno, level, file_id, smallest, largest, first_seqno, last_seqno, size), a row for each run listed."""
    columns = ["level", "file_id", "smallest", "largest", "first_seqno", "last_seqno", "size"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at, data in zip(x["path"], x["content"], strict=True):
                next_file, next_seqno, tables = codecs.read_catalog(bytes(data))
                made = pd.DataFrame([tuple(getattr(t, c) for c in columns) for t in tables], columns=columns)
                made.insert(0, "path", at)
                made.insert(1, "next_file", next_file)
                made.insert(2, "next_seqno", next_seqno)
                yield made

    return _files(spark, path, pattern).mapInPandas(run, "path string, next_file long, next_seqno long, level int, file_id long, smallest binary, largest binary, first_seqno long, last_seqno long, size long")
