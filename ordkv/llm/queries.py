"""The thin queries over the operators of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embeddings, mixing, quality, sharding, simhash, suffix, urls, warc
from .common import Scratch
from .sql import SQL

URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]
SOURCE_WEIGHTS = [1, 2, 3]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return found.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # The text itself isn't needed once it is measured.
    judged = quality.judge(docs, keep=["doc_id"])
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "posterior")


def op4_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_report(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), SOURCE_WEIGHTS)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards(_table(spark, sf_dir, "documents"), 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary(spark)
    return bpe.digests(_table(spark, sf_dir, "documents"), ranks, pattern)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.swapped_answers(_table(spark, sf_dir, "conversations"))
    return chat.preferences(pairs).drop("chosen", "rejected")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("archive")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def vocabulary(spark: SparkSession) -> tuple:
    """The rank table, shared, and the pattern of the public multilingual vocabulary."""
    import public_tokenizers

    return bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_url_filter, op3_quality, op4_embedding, op5_suffix, op6_mixing, op7_sharding, op8_bpe, op9_chat, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return SQL
