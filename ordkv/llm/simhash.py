"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, numbered, skew_join

#: Every eighth bit of a 64-bit word: eight counters in one word.
_LANES = np.uint64(0x0101010101010101)
_CHUNK = 255 * 512
#: Bits of a wide fingerprint.
WIDE = 512
_STEPS = np.arange(WIDE // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _majority(h: np.ndarray) -> int:
    """Bits set in over half of the words h."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), _CHUNK):
        part = h[at : at + _CHUNK]
        rows = -(-len(part) // 255)
        full = np.zeros(rows * 255, np.uint64)
        full[: len(part)] = part
        full = full.reshape(rows, 255)
        for k in range(8):
            lanes = np.add.reduce((full >> np.uint64(k)) & _LANES, axis=1)
            counts[k::8] += lanes.astype("<u8").view(np.uint8).reshape(rows, 8).sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(h)).tolist()))


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash of a text's word shingles (lower-cased A-Z; fewer words than ``size``: all of them; none: 0)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    n = max(len(found) - size + 1, 1)
    if n == 1:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return _majority(np.fromiter((xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            made = np.fromiter((fingerprint(t, size) for t in x["text"]), np.uint64, len(x))
            yield pd.DataFrame({"doc_id": x["doc_id"], "text_hash": x["text_hash"], "fp": made.view(np.int64)})

    plain, name, _ = numbered(docs)
    given = F.col(name(text))
    rows = plain.select(F.col(name(doc_id)).cast("long").alias("doc_id"), F.xxhash64(given).alias("text_hash"), given.alias("text"))
    return rows.mapInPandas(run, "doc_id long, text_hash long, fp long")


def _table(fps: DataFrame) -> DataFrame:
    """Both segment tables: (k, fp); k is a 32-bit segment, with bit 32 set for the lower one."""
    return fps.select("fp", F.explode(F.array(F.shiftrightunsigned("fp", 32), F.expr("(fp & 4294967295L) | 4294967296L"))).alias("k"))


def _probes(fps: DataFrame) -> DataFrame:
    """Keys under which a fingerprint looks for partners.

    Two fingerprints at distance 2 or less have equal lower segments, or upper segments at distance 0 or 1.
    The upper ball's flips go from 0 to 1 only: of two segments one bit apart, one holds the 0.
    """
    return fps.selectExpr(
        "fp",
        "explode(concat(array(shiftrightunsigned(fp, 32), (fp & 4294967295L) | 4294967296L),"
        " transform(filter(sequence(32, 63), b -> (shiftright(fp, b) & 1L) = 0L), b -> shiftrightunsigned(fp, 32) | shiftleft(1L, b - 32)))) AS k",
    )


def _widened(h: np.ndarray) -> np.ndarray:
    """WIDE bits of each of the words h: itself, then mixed words of it."""
    x = h[:, None] + _STEPS
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x[:, 0] = h
    return x


def segments(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of the words h, of WIDE bits (the first 64: the plain one), as segments of ``width`` bits (31 at most; what is left over is dropped).

    Also, for each segment, a mask of its two bits whose counts are nearest to half: the likeliest to differ in a near copy.
    """
    counts = np.zeros(WIDE, np.int64)
    for at in range(0, len(h), 255):
        bits = np.unpackbits(_widened(h[at : at + 255]).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    over = 2 * counts - len(h)
    over = over[: WIDE // width * width].reshape(-1, width)
    worth = np.int64(1) << np.arange(width, dtype=np.int64)
    least = np.argsort(np.abs(over), axis=1, kind="stable")[:, :2]
    return ((over > 0) @ worth).astype(np.int32), worth[least].sum(1).astype(np.int32)


def links(scratch: Scratch, fps: DataFrame, bucket_limit: int = 16) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints (fp) at distance 2 or less.

    Buckets of up to ``bucket_limit`` fingerprints: probes meet table rows and the complete distance is verified.
    Larger buckets would give pairs in the square of their size. There each table row also lists the words at
    distance 1 or less within its other segment, and each probe its own other segment on the bucket's key. Rows
    that meet at a word are all within distance 1 of it, so within 2 of each other; a word has at most 65 of
    them and links them to their least. No partner is lost either way.
    """
    table, probes = _table(fps), _probes(fps)
    large = scratch.write(table.groupBy("k").count().where(F.col("count") > bucket_limit).select("k"), "large-buckets")
    p = probes.join(large, "k", "left_anti")
    t = table.join(large, "k", "left_anti").select(F.col("k"), F.col("fp").alias("other"))
    near = p.join(t, "k").where("fp <> other AND bit_count(fp ^ other) <= 2").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    word = "CASE WHEN k < 4294967296L THEN shiftleft(k, 32) | ({0} & 4294967295L) ELSE (k & 4294967295L) | ({0} & -4294967296L) END"
    ball = "CASE WHEN k < 4294967296L THEN sequence(0, 31) ELSE sequence(32, 63) END"
    balls = table.join(large, "k", "left_semi").selectExpr("fp", f"explode(concat(array(fp), transform({ball}, b -> fp ^ shiftleft(1L, b)))) AS w")
    exact = probes.join(large, "k", "left_semi").selectExpr("fp", word.format("fp") + " AS w")
    met = balls.unionByName(exact).groupBy("w").agg(F.sort_array(F.collect_set("fp")).alias("s")).where("size(s) > 1")
    return near.unionByName(met.selectExpr("s[0] AS a", "explode(slice(s, 2, size(s) - 1)) AS b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, label, component_id), a row for each row of docs.

    label is a value shared by a component's rows; component_id its smallest doc_id, null only where none
    of its rows has one. Rows with equal fingerprints, repeated rows and empty texts (fingerprint 0) link like
    any others. Null text is the empty text; an empty table gives none. A text is hashed in one row, some tens of
    bytes a word. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(fingerprints(docs, doc_id, text, size), "fingerprints")
    reps = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    comp = connected_components(scratch, links(scratch, reps.select("fp")))
    named = reps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("label"))
    named = scratch.write(named, "named")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    return skew_join(prints, skew_join(named.drop("rep"), least, ["label"]), ["fp"])


def keep_least(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row for each label of found (doc_id, text_hash, label): its smallest doc_id (nulls last; then by the text's hash)."""
    scratch = Scratch(docs.sparkSession)
    kept = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("k"))
    kept = scratch.write(kept.select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash"), F.lit(True).alias("__kept")), "kept")
    plain, name, back = numbered(docs)
    keyed = plain.withColumns({"__id": F.col(name(doc_id)).cast("long"), "__hash": F.xxhash64(F.col(name(text)))})
    return back(skew_join(keyed, kept, ["__id", "__hash"]).dropDuplicates(["__id", "__hash"]))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """docs with one row for each group of near-duplicates: its smallest doc_id (nulls last; then by the text's hash)."""
    return keep_least(docs, near_duplicates(docs, doc_id, text, size), doc_id, text)
