"""Near-duplicates by the similarity of word shingles: SimHash with multi-index tables finds pairs, whole sets decide, and an exact pass adds what the tables miss."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, numbered, repeated_rows, skew_join
from .simhash import WIDE, keep_least, segments

#: One text in so many is counted to find frequent shingles; those seen so often are ordered last, this many at most. Only the cost hangs on them.
SAMPLE, SEEN, FREQUENT = 32, 4, 100_000
#: Up to so many classes are broadcast to pick their sets; more meet by shuffle.
BROADCAST = 1_000_000
#: Classes of a large bucket that all others are compared with first.
CENTRES = 3
#: Buckets of the SimHash tables up to this size are compared in pairs; so many tables are looked up before all.
NEAR, FIRST = 8, 2
#: Bits of a set's sketch.
SKETCH = 4096


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (lower-cased A-Z; fewer words than ``size``: all of them; none: empty)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line, n = b" ".join(found), max(len(found) - size + 1, min(len(found), 1))
    if n < 2:
        return np.array([xxhash.xxh64_intdigest(line, 42)] * n, np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n).view(np.int64))


def sketch(hs: np.ndarray) -> np.ndarray:
    """For each of SKETCH bins, in 64-bit words: is the number of hashes in it odd? Two sets differ in at least as many hashes as their sketches in bits."""
    return np.packbits((np.bincount(hs & (SKETCH - 1), minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


@dataclass(frozen=True)
class Sets:
    """rows: (doc_id, text_hash, cid, n, sk, keys, segs, flips) of each row of texts: the number n of its shingles, their sketch sk, the first of them in an order common to all, their SimHash in segments with the two bits of each that are the likeliest to differ (none without shingles), and cid, which rows with equal shingles share. texts: (doc_id, text_hash, text). Whole sets are made again where they are needed."""

    rows: DataFrame
    texts: DataFrame
    size: int
    width: int

    @property
    def pieces(self) -> int:
        """Segments that fit in a word."""
        return min(64 // self.width, 3)

    def hashes(self, scratch: Scratch, asked: DataFrame) -> DataFrame:
        """(cid, hs): the shingles of the classes asked for."""
        size = self.size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                yield pd.DataFrame({"cid": x["cid"], "hs": [shingles(t, size) for t in x["text"]]})

        few = F.broadcast if asked.count() <= BROADCAST else lambda x: x
        one = self.rows.select("cid", "doc_id", "text_hash").join(few(asked), "cid", "left_semi").groupBy("cid").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
        one = scratch.write(one.select("cid", F.col("r.doc_id").alias("id"), F.col("r.text_hash").alias("hash")), "representatives")
        same = (F.col("hash") == F.col("text_hash")) & F.col("id").eqNullSafe(F.col("doc_id"))
        found = self.texts.join(few(one), same).select("cid", "text")
        return found.mapInPandas(run, "cid long, hs array<long>").groupBy("cid").agg(F.first("hs").alias("hs"))


def sets(scratch: Scratch, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, least: int = 80) -> Sets:
    """The rows' shingles, with as many keys as a partner at ``least`` per cent has one of at least."""
    plain, name, _ = numbered(docs)
    given = F.col(name(text))
    texts = plain.select(F.col(name(doc_id)).cast("long").alias("doc_id"), F.xxhash64(given).alias("text_hash"), given.alias("text"))
    frequent = _frequent(texts, size)
    width = min(max((texts.count() - 1).bit_length() + 3, 16), 31)  # a chance meeting in a table stays rare however many rows there are
    by = np.argsort(frequent)
    sorted_, rank = frequent[by], by + 1

    def first(h: np.ndarray) -> np.ndarray:
        if len(sorted_) and len(h):
            at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
            h = h[np.argsort(np.where(sorted_[at] == h, rank[at], 0), kind="stable")]
        return h[: len(h) + 1 + -len(h) * least // 100] if len(h) else h

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            hs = [shingles(t, size) for t in x["text"]]
            cid = np.fromiter((xxhash.xxh64_intdigest(h.tobytes(), 42) for h in hs), np.uint64, len(hs)).view(np.int64)
            prints = [segments(h.view(np.uint64), width) if len(h) else (np.zeros(0, np.int32),) * 2 for h in hs]
            yield pd.DataFrame({"doc_id": x["doc_id"], "text_hash": x["text_hash"], "cid": cid, "n": [len(h) for h in hs], "sk": [sketch(h) for h in hs], "keys": [first(h) for h in hs], "segs": [p for p, _ in prints], "flips": [p for _, p in prints]})

    rows = scratch.write(texts.mapInPandas(run, "doc_id long, text_hash long, cid long, n long, sk array<long>, keys array<long>, segs array<int>, flips array<int>"), "sets")
    return Sets(rows, texts, size, width)


def _frequent(texts: DataFrame, size: int) -> np.ndarray:
    """Frequent shingles, the rarer first; a sampled text counts once, however often it is there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"k": np.concatenate([shingles(t, size) for t in x["text"]] or [np.zeros(0, np.int64)])})

    some = texts.where(F.pmod(F.xxhash64("text_hash"), F.lit(SAMPLE)) == 0).groupBy("text_hash").agg(F.first("text").alias("text"))
    counted = some.mapInPandas(run, "k long").groupBy("k").count()
    found = counted.where(F.col("count") >= SEEN).orderBy(F.desc("count"), "k").limit(FREQUENT).select("k").collect()
    return np.array([r["k"] for r in found], np.int64)[::-1]


def _fit(least: int) -> str:
    """Can x and y, whose first common shingle is at their pos, still be similar?"""
    return f"{100 + least} * least(x.n - x.pos, y.n - y.pos) >= {least} * (x.n + y.n)"


def _asked(scratch: Scratch, pairs: DataFrame, tag: str) -> DataFrame:
    return scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), tag)


def _with_both(pairs: DataFrame, known: DataFrame, cols: list[str]) -> DataFrame:
    """pairs with columns of their classes, as those of a and of b."""
    for side in ("a", "b"):
        pairs = skew_join(pairs, known.select(F.col("cid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols]), [side])
    return pairs


def _verified(scratch: Scratch, pairs: DataFrame, made: Sets, least: int, tag: str) -> DataFrame:
    """(a, b) of the pairs whose similarity is at least ``least`` per cent; sketches rule out most others, the sets decide."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            both = np.fromiter((len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x["hs_a"], x["hs_b"], strict=True)), np.int64, len(x))
            total = np.fromiter((len(p) + len(q) for p, q in zip(x["hs_a"], x["hs_b"], strict=True)), np.int64, len(x))
            yield x.loc[100 * both >= least * (total - both), ["a", "b"]]

    pairs = scratch.write(pairs.distinct(), f"{tag}-pairs")
    differ = "aggregate(zip_with(sk_a, sk_b, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    asked = _asked(scratch, pairs, f"{tag}-asked")
    small = F.broadcast if asked.count() <= BROADCAST else lambda x: x
    known = made.rows.select("cid", "n", "sk").join(small(asked), "cid", "left_semi").groupBy("cid").agg(F.first("n").alias("n"), F.first("sk").alias("sk"))
    close = _with_both(pairs, known, ["n", "sk"]).where(f"{100 + least} * {differ} <= {100 - least} * (n_a + n_b)").select("a", "b")
    close = scratch.write(close, f"{tag}-close")
    scratch.drop(pairs, asked)
    hashes = scratch.write(made.hashes(scratch, _asked(scratch, close, f"{tag}-left")), f"{tag}-hashes")
    found = scratch.write(_with_both(close, hashes, ["hs"]).mapInPandas(run, "a long, b long"), f"{tag}-links")
    scratch.drop(close, hashes)
    return found


def _reach(least: int, bits: int) -> int:
    """Bits in which two SimHashes may differ: for sets of equal size at ``least`` per cent, the mean and three standard deviations."""
    p = math.acos(2 * least / (100 + least)) / math.pi
    return math.floor(p * bits + 3 * math.sqrt(p * (1 - p) * bits))


def _close(scratch: Scratch, made: Sets, classes: DataFrame, rows: DataFrame, least: int, bucket_limit: int, centres: int, tag: str) -> DataFrame:
    """(a, b) of classes whose rows (k, cid, f, label) meet under a key, whose labels are not equal, whose SimHashes are close, and whose similarity is ``least`` per cent or more.

    Buckets of up to ``bucket_limit`` classes are compared in pairs; in larger ones all are compared with ``centres``
    of them, the least by a hash, so that buckets of the same classes mostly have the same ones.
    """
    met = rows.groupBy("k").agg(F.collect_set(F.struct("cid", "f", "label")).alias("s"), F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("s")
    buckets = scratch.write(met, f"{tag}-buckets")
    one, apart = f"size(s) <= {bucket_limit}", f"x.label <> y.label AND bit_count(x.f ^ y.f) <= {_reach(least, made.pieces * made.width)}"
    pair = ["least(x.cid, y.cid) AS a", "greatest(x.cid, y.cid) AS b"]
    small = buckets.where(one).selectExpr("s", "explode(s) AS x").selectExpr("x", "explode(s) AS y").where(f"x.cid < y.cid AND {apart}").selectExpr(*pair)
    first = [f"array_min(transform(s, z -> struct(xxhash64(z.cid, {i}) AS h, z AS z))).z" for i in range(centres)]
    large = buckets.where(f"NOT {one}").selectExpr(f"array_distinct(array({', '.join(first)})) AS c", "explode(s) AS y").selectExpr("explode(c) AS x", "y").where(apart).selectExpr(*pair)
    pairs = scratch.write(small.unionByName(large).distinct(), f"{tag}-met")
    differ = "aggregate(zip_with(segs_a, segs_b, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    near = _with_both(pairs, classes.select("cid", "segs"), ["segs"]).where(f"{differ} <= {_reach(least, WIDE // made.width * made.width)}").select("a", "b")
    found = _verified(scratch, near, made, least, tag)
    scratch.drop(buckets, pairs)
    return found


def near_links(scratch: Scratch, made: Sets, least: int = 80, bucket_limit: int = NEAR) -> DataFrame:
    """Edges (a, b) of classes at ``least`` per cent or more whose SimHashes are close, found by multi-index tables.

    There is a table for each segment. A class is filed under its segment and under the words that differ from it in
    either or both of the two bits that are the likeliest to differ: a Hamming ball cut to where near copies are.
    Classes that meet are compared by the first segments, then by the whole distance, then by their sets. The first
    ``FIRST`` tables are looked up before all, so that a large group of near copies is mostly one component then
    and isn't compared in every table; later only classes of different components are.
    """
    classes = made.rows.where("n > 0").groupBy("cid").agg(F.first(F.struct("segs", "flips")).alias("p")).select("cid", "p.*")
    classes = scratch.write(classes, "prints")
    piece = " | ".join(f"shiftleft(cast(segs[{i}] AS bigint), {i * made.width})" for i in range(made.pieces))
    ball = "array(0, flips[i] & -flips[i], flips[i] & (flips[i] - 1), flips[i])"
    keys = f"flatten(transform(segs, (v, i) -> transform({ball}, m -> shiftleft(cast(i AS bigint), 32) | cast(v ^ m AS bigint))))"
    filed = classes.selectExpr("cid", f"{piece} AS f", f"explode({keys}) AS k")
    rows = repeated_rows(scratch, filed, [["k"]], ["cid", "f"], "filed").select("k", "cid", "f")
    found = _close(scratch, made, classes, rows.where(F.col("k") < FIRST << 32).withColumn("label", F.col("cid")), least, bucket_limit, CENTRES, "first")
    comp = connected_components(scratch, found).withColumnRenamed("node", "cid")
    labelled = skew_join(rows, comp, ["cid"], "left").withColumn("label", F.coalesce("component", "cid")).drop("component")
    return found.unionByName(_close(scratch, made, classes, labelled, least, bucket_limit, 1, "near"))


def links(scratch: Scratch, made: Sets, least: int = 80, bucket_limit: int = NEAR) -> DataFrame:
    """Edges (a, b), each of classes (cid) at ``least`` per cent or more, whose components are those of all such pairs.

    The tables of ``near_links`` give them, but for what they miss, which an exact pass adds: two sets that similar
    share a shingle of their prefixes, so that buckets of equal prefix shingles hold every pair; those not yet in
    the same component are compared. A pair left out is in one component already, so no partner is lost.
    """
    found = near_links(scratch, made, least, bucket_limit)
    return found.unionByName(_missed(scratch, made, found, least))


def _missed(scratch: Scratch, made: Sets, found: DataFrame, least: int) -> DataFrame:
    """Edges (a, b) of all classes at ``least`` per cent or more that the edges found leave in different components."""
    comp = connected_components(scratch, found).withColumnRenamed("node", "cid")
    prefixes = made.rows.select("cid", "n", F.posexplode("keys").alias("pos", "k")).withColumn("pos", F.col("pos").cast("long"))
    rows = repeated_rows(scratch, prefixes, [["k"]], ["cid", "n", "pos"], "repeated")
    met = rows.groupBy("k").agg(F.collect_set(F.struct("cid", "n", "pos")).alias("s")).where("size(s) > 1")
    members = scratch.write(met, "buckets").selectExpr("k", "explode(s) AS z").select("k", "z.*")
    members = skew_join(members, comp, ["cid"], "left").select("k", F.struct("cid", "n", "pos").alias("z"), F.coalesce("component", "cid").alias("label"))
    members = scratch.write(members, "members")
    mixed = members.groupBy("k").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("k")
    members = scratch.write(skew_join(members, mixed, ["k"]), "mixed")
    # Sketches folded to a quarter rule out most pairs before they become rows.
    asked = scratch.write(members.select(F.col("z.cid").alias("cid")).distinct(), "asked")
    few = F.broadcast if asked.count() <= BROADCAST else lambda x: x
    folded = F.expr("transform(sequence(0, 15), i -> sk[i] ^ sk[i + 16] ^ sk[i + 32] ^ sk[i + 48])")
    folded = made.rows.select("cid", folded.alias("f")).join(few(asked), "cid", "left_semi").groupBy("cid").agg(F.first("f").alias("f"))
    members = skew_join(members.withColumn("cid", F.col("z.cid")), folded, ["cid"])
    x, y = members.select("k", F.col("z").alias("x"), F.col("label").alias("lx"), F.col("f").alias("fx")), members.select("k", F.col("z").alias("y"), F.col("label").alias("ly"), F.col("f").alias("fy"))
    differ = " + ".join(f"bit_count(fx[{i}] ^ fy[{i}])" for i in range(SKETCH // 256))
    pair = ["least(x.cid, y.cid) AS a", "greatest(x.cid, y.cid) AS b"]
    rest = skew_join(x, y, ["k"]).where(f"lx < ly AND {_fit(least)} AND {100 + least} * ({differ}) <= {100 - least} * (x.n + y.n)").selectExpr(*pair)
    return _verified(scratch, rest, made, least, "rest")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, least: int = 80) -> DataFrame:
    """(doc_id, text_hash, label), a row for each row of docs; label is a value shared by a component's rows.

    Rows link if the sets of their shingles have a similarity (common of all) of ``least`` per cent or more, by the
    shingles' 64-bit hashes. Empty and null texts are alike; repeated rows link like any others.
    """
    scratch = Scratch(docs.sparkSession)
    made = sets(scratch, docs, doc_id, text, size, least)
    found = links(scratch, made, least)
    comp = scratch.write(connected_components(scratch, found).withColumnRenamed("node", "cid"), "components")
    rows = skew_join(made.rows.select("doc_id", "text_hash", "cid"), comp, ["cid"], "left").select("doc_id", "text_hash", F.coalesce("component", "cid").alias("label"))
    rows = scratch.write(rows, "labels")
    scratch.drop(made.rows)
    return rows


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, least: int = 80) -> DataFrame:
    """docs with one row for each group of near-duplicates: its smallest doc_id (nulls last; then by the text's hash)."""
    return keep_least(docs, near_duplicates(docs, doc_id, text, size, least), doc_id, text)
