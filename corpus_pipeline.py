"""A corpus pipeline over ``documents``: five operators of ordkv.llm, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordkv.llm import bpe, mixing, quality, similar, suffix
from ordkv.llm.common import Scratch, released
from ordkv.llm.queries import SOURCE_WEIGHTS, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of their sets of five-word shingles; SimHash tables find the pairs, an exact pass those that they miss."""
    return similar.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that occur twice or more; ``n_chars`` of a text that was cut is its new length."""
    before, now = max(docs.columns, key=len) + "_before", F.char_length("text")  # a name that no column has
    cut = suffix.without_repeats(docs.withColumn(before, now))
    return cut.withColumn("n_chars", F.when(now != F.col(f"`{before}`"), now.cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).drop(before)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.repeat_by_mix(docs, SOURCE_WEIGHTS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document."""
    ranks, pattern = vocabulary(spark)
    return bpe.digests(docs, ranks, pattern, keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: Expectation-maximisation, hashing and byte-pair merges have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written to the shared folder and read again, and what the stage before left is deleted."""
    docs, scratch, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), None
    for name, stage in STAGES:
        with released():
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
