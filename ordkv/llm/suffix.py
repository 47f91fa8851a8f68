"""Removal of byte strings that repeat across a corpus, by bucket-pointer refinement over sampled suffixes.

A suffix's bucket at depth h says which suffixes share its first h bytes. The initial buckets are those of
q-grams, eight bytes as they are. A bucket at depth h + d, d <= h, is refined from depth h by the identifier of
the bucket at offset d after the suffix; the refined identifiers serve the next refinement (8, 16, 32, 64, 100
bytes). Identifiers are hashes of the pair of identifiers instead of ranks, so they mean the same in every text,
and refinement up to ``width / 2`` needs no exchange. Only what has to be compared across texts is sorted:

1. Of all suffixes, those at the window minima of the identifiers at depth ``width / 2`` are sorted. Equal
   windows of ``width`` bytes have their minimum at the same offset, so every repeated window is led by a
   sampled suffix in a bucket of two or more. A bucket of one is finished.
2. The same sort refines each bucket by the identifiers at the offsets of the run of windows that the suffix
   leads. Rows that agree there repeat as a whole.
3. In a bucket that step 2 splits, the windows of each row that repeats only in part, and of one row of each
   kind that repeats as a whole, are refined one by one to depth ``width`` and sorted again.

Identifiers may collide, so a row also carries a checksum of the very bytes that its run of windows covers, made
apart from the identifiers: rows are equal if bucket, refined identifier and checksum are (192 bits).

A text is worked through in parts of ``_PART`` windows, so that its length doesn't matter to memory beyond the text
itself. Runs are cut where parts meet, which step 3 sees through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered, repeated_rows, skew_join

#: Bytes of an initial bucket at most: what a word holds.
_Q = 8
_ODD = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15))
_HALF_WORD, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
#: Windows of a text that are worked on at once.
_PART = 1 << 20
#: Up to so many documents' keys are broadcast, to shuffle only those documents.
BROADCAST = 1_000_000


def _refined(own: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers of buckets refined by the identifiers at a later offset."""
    x = own >> _HALF_WORD
    x ^= own
    x *= _ODD[0]
    x ^= x >> _HALF_WORD
    x += later
    x *= _ODD[1]
    x ^= x >> _HALF_WORD
    return x


class _Sums:
    """Checksums of a text's substrings: sums of a random number for each byte's value times the powers of an odd number, as 64-bit words."""

    value = np.random.default_rng(7).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    base = np.uint64(0xDA942042E4DD58B5)
    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, data: bytes):
        n = len(data) + 1
        if n > len(self.powers):
            size, undo = 1 << (n - 1).bit_length(), np.uint64(pow(int(self.base), -1, 1 << 64))
            _Sums.powers, _Sums.inverses = (np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(size - 1, x, np.uint64))) for x in (self.base, undo))
        self.upto = np.zeros(n, np.uint64)
        np.cumsum(self.value[np.frombuffer(data, np.uint8)] * self.powers[: n - 1], out=self.upto[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.upto[stop] - self.upto[start]) * self.inverses[start] + (stop - start).astype(np.uint64)


class _Buckets:
    """Bucket identifiers of the suffixes of a part of a text at depth ``width / 2``, and refinements of some of them."""

    def __init__(self, data: bytes, width: int):
        self.depth, self.sums = width // 2, _Sums(data)
        at = min(_Q, self.depth)
        first = np.zeros((len(data) - at + 1, _Q), np.uint8)
        first[:, :at] = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), at)
        self.ids = first.view("<u8").ravel()
        while at < self.depth:
            step = min(at, self.depth - at)
            self.ids = _refined(self.ids[:-step], self.ids[step:])
            at += step

    def windows(self, start: np.ndarray) -> np.ndarray:
        """At depth ``width``."""
        return _refined(self.ids[start], self.ids[start + self.depth])

    def runs(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of all bytes from the first window to the last, which overlap or touch."""
        return _refined(_refined(self.windows(first), self.windows(last)), (last - first).astype(np.uint64))


def _leads(ids: np.ndarray, w: int) -> np.ndarray:
    """For each window of w identifiers the position of its least one, the leftmost of equals (by 32 bits)."""
    n = len(ids)
    x = (ids & ~_LOW) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    full = full.reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & _LOW).astype(np.int64)


def _runs(data: bytes, width: int) -> Iterator[tuple[int, _Buckets, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: where it starts, its buckets, and for each sampled suffix its bucket's identifier and the first and last window it leads."""
    for at in range(0, len(data) - width + 1, _PART):
        buckets = _Buckets(data[at : at + _PART + width - 1], width)
        lead = _leads(buckets.ids, width - buckets.depth + 1)
        cut = np.flatnonzero(np.diff(lead)) + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut, [len(lead)])) - 1
        yield at, buckets, buckets.ids[lead[first]], first, last


def _long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


#: A run's place: its first window, and 20 bits for the number of windows after it (at most width / 2).
_SHIFT = 20
#: A sampled suffix's run of windows repeats in part at most; as a whole; as a whole, and stands for its kind in step 3.
_SPLIT, _WHOLE, _SHOWN = 0, 1, 2
#: Rows gathered before they are passed on.
_HELD = 200_000
_ROW = ["doc", "mark", "h", "g", "e", "place"]
_KINDS = ", ".join(f"{c} long" for c in _ROW)


def _suffixes(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for x in batches:
        parts, held = [], 0
        for doc, mark, t in zip(x["doc"], x["mark"], x["t"], strict=True):
            for at, buckets, bucket, first, last in _runs(_utf8(t), width):
                parts.append((np.full(len(first), doc), np.full(len(first), mark), _long(bucket), _long(buckets.runs(first, last)), _long(buckets.sums.of(first, last + width)), at + first << _SHIFT | (last - first)))
                held += len(first)
                if held > _HELD:
                    yield _frame(parts)
                    parts, held = [], 0
        if parts:
            yield _frame(parts)


def _frame(parts: list) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(_ROW, map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, mark, t): an id without nulls, a hash of the text (together they name a row), the text."""
    plain, name, _ = numbered(docs)
    return plain.select(F.coalesce(F.col(name(doc_id)).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(F.col(name(text))).alias("mark"), F.col(name(text)).alias("t"))


def _pack(rows: DataFrame) -> DataFrame:
    """(doc, mark, z): the texts' bytes compressed, to be shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for x in batches:
            yield pd.DataFrame({"doc": x["doc"], "mark": x["mark"], "z": [squeeze.compress(_utf8(t)) for t in x["t"]]})

    return rows.mapInPandas(run, "doc long, mark long, z binary")


def _unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _split_windows(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Identifiers of the single windows of runs that repeat in part, and of those that stand for runs that repeat as a whole."""
    for x in batches:
        parts, held = [], 0
        for doc, mark, z, places in zip(x["doc"], x["mark"], x["z"], x["shared"], strict=True):
            shared: dict[int, int] = {}
            for p in places:
                shared[int(p) >> 2] = max(shared.get(int(p) >> 2, 0), int(p) & 3)
            for at, buckets, bucket, first, last in _runs(_unpack(z), width):
                state = np.fromiter((shared.get(f, -1) for f in (at + first).tolist()), np.int64, len(first))
                for i in np.flatnonzero((state == _SPLIT) | (state == _SHOWN)).tolist():
                    s = np.arange(first[i], last[i] + 1)
                    h = np.full(len(s), _long(bucket[i : i + 1])[0])
                    parts.append((np.full(len(s), doc), np.full(len(s), mark), h, _long(buckets.windows(s)), _long(buckets.sums.of(s, s + width)), at + s << _SHIFT))
                    held += len(s)
                    if held > _HELD:
                        yield _frame(parts)
                        parts, held = [], 0
        if parts:
            yield _frame(parts)


def _spans(places: np.ndarray | None, width: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows at the given places cover."""
    if places is None or not len(places):
        return []
    p = np.unique(np.asarray(places, np.int64))
    start, stop = p >> _SHIFT, (p >> _SHIFT) + (p & ((1 << _SHIFT) - 1)) + width
    reach = np.maximum.accumulate(stop)
    cut = np.flatnonzero(start[1:] > reach[:-1]) + 1
    return list(zip(start[np.concatenate(([0], cut))].tolist(), reach[np.concatenate((cut - 1, [len(p) - 1]))].tolist(), strict=True))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 200) -> DataFrame:
    """(doc, mark, places), a row for each document with repeated windows of ``width`` bytes: their places.

    A null or short text has none. Rows repeated with the same id and text count as different documents;
    a null id is the least long. ``width`` is even, and under 2**20.
    """
    scratch = Scratch(docs.sparkSession)
    rows = _rows(docs, doc_id, text)
    sampled = rows.mapInPandas(lambda it: _suffixes(it, width), _KINDS)
    sampled = scratch.write(sampled, "sampled")  # a range shuffle reads its input twice
    shared = repeated_rows(scratch, sampled, [["h"], ["h", "g", "e"]], ["doc", "mark", "place"], "suffixes")
    scratch.drop(sampled)
    whole = shared.where("dup1").select("doc", "mark", "place")
    split = shared.where("NOT dup1").select("h").distinct()
    kinds = shared.where("dup1").groupBy("h", "g", "e").agg(F.min(F.struct("doc", "mark", "place")).alias("r"))
    shown = skew_join(kinds, split, ["h"], "left_semi").select("r.*", F.lit(_SHOWN).alias("state"))
    states = shared.select("doc", "mark", "place", F.col("dup1").cast("int").alias("state")).unionByName(shown)
    state = states.groupBy("doc", "mark").agg(
        F.collect_set(F.shiftright("place", _SHIFT) * 4 + F.col("state")).alias("shared"), F.bool_and(F.col("state") == _WHOLE).alias("all")
    )
    state = scratch.write(state.where("NOT all").drop("all"), "open")
    windows = scratch.write(_with_text(rows, state).mapInPandas(lambda it: _split_windows(it, width), _KINDS), "windows")
    single = repeated_rows(scratch, windows, [["h", "g", "e"]], ["doc", "mark", "place"], "single").select("doc", "mark", "place")
    places = scratch.write(whole.unionByName(single).groupBy("doc", "mark").agg(F.collect_set("place").alias("places")), "places")
    scratch.drop(windows)
    return places


def _with_text(rows: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """found (doc, mark, ...) with the rows' compressed bytes z; few enough keys are broadcast, so that only those texts are shuffled."""
    keys = found.select("doc", "mark")
    if how == "inner" and keys.count() <= BROADCAST:
        rows = rows.join(F.broadcast(keys), ["doc", "mark"], "left_semi")
    return skew_join(_pack(rows), found, ["doc", "mark"], how)


def removal_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of docs; see ``repeats``. Only id and text are read.

    An empty table gives none.
    """
    scratch, rows = Scratch(docs.sparkSession), _rows(docs, doc_id, text)
    places = repeats(docs, doc_id, text, width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for doc, z, places in zip(x["doc"], x["z"], x["places"], strict=True):
                data, spans = _unpack(z), _spans(places, width)
                rows.append((doc, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(data, spans)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kinds = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if places.count() <= BROADCAST:
        binary = F.coalesce("t", F.lit("")).cast("binary")
        whole = rows.join(F.broadcast(places.select("doc", "mark")), ["doc", "mark"], "left_anti")
        whole = whole.select("doc", F.octet_length(binary).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(binary, 256).alias("kept_sha256"))
        done = whole.unionByName(_with_text(rows, places).drop("mark").mapInPandas(run, kinds))
    else:
        done = _with_text(rows, places, "left").drop("mark").mapInPandas(run, kinds)
    done = scratch.write(done, "report")
    return done.withColumn("doc", F.nullif("doc", F.lit(-(2**63)))).withColumnRenamed("doc", "doc_id")


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 200) -> DataFrame:
    """docs with repeated strings cut from the text; a character cut in two goes whole. Texts without repeats stay as they are (null too), and so do other columns."""
    scratch, rows = Scratch(docs.sparkSession), _rows(docs, doc_id, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"doc": x["doc"], "mark": x["mark"], "cut": [_kept(_unpack(z), _spans(p, width)).decode("utf-8", "ignore") for z, p in zip(x["z"], x["places"], strict=True)]})

    # Equal rows are joined with their places each; the text is cut once.
    found = _with_text(rows, repeats(docs, doc_id, text, width)).dropDuplicates(["doc", "mark"])
    cut = scratch.write(found.mapInPandas(run, "doc long, mark long, cut string"), "cut")
    plain, name, back = numbered(docs)
    keyed = plain.withColumns({"doc": F.coalesce(F.col(name(doc_id)).cast("long"), F.lit(-(2**63))), "mark": F.xxhash64(F.col(name(text)))})
    return back(skew_join(keyed, cut, ["doc", "mark"], "left").withColumn(name(text), F.coalesce("cut", name(text))))
