"""Contiguous shards of near equal bytes by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered, running_totals


def shards(docs: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row for each row of docs.

    size is the text's UTF-8 bytes (null: none) plus 1. Rows are in order of doc_id (null first), then checksum
    and size; a row goes to the shard in which its middle byte falls when the total is cut into n equal parts,
    so shards are contiguous and differ from equal by less than a document. slot counts from 0 within a shard.
    Only ids, sizes and checksums are shuffled, never texts. Shards may be empty where documents are few. Rows that are
    alike follow each other in any order, and may be dealt to many tasks and shards; null and empty texts have size
    1; a very long text is in one shard; an empty table gives none. Other columns are not read.
    """
    scratch, (plain, name, _) = Scratch(docs.sparkSession), numbered(docs)
    t = F.coalesce(F.col(name(text)), F.lit(""))
    rows = plain.select(F.col(name(doc_id)).alias("doc_id"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    rows = scratch.write(rows.withColumn("salt", F.monotonically_increasing_id()), "sizes")
    placed = running_totals(scratch, rows, ["doc_id", "text_crc32", "size", "salt"], {"__before": "size"}, "rows").drop("salt")
    placed = scratch.write(placed, "placed")
    total = placed.agg(F.sum("size")).first()[0] or 1
    placed = placed.withColumn("shard", F.expr(f"CAST((2 * __before + size) * {n} DIV {2 * total} AS INT)"))
    first = placed.groupBy("shard").agg(F.min("__index").alias("__first"))
    placed = placed.join(F.broadcast(first), "shard")  # a row for each shard
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("__index") - F.col("__first")).cast("long").alias("slot"))
