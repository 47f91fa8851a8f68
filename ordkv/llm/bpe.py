"""Byte-level BPE by a global shuffle of distinct words.

Texts are split into pre-tokens, block by block (a block is up to some MB of one partition's texts). Within a
block a document is the list of its pre-tokens' numbers, which keeps their positions, and the block's distinct
words are dealt out by a hash over all blocks. Each distinct word of the corpus meets in one place and is encoded
once; the ids go back to the blocks, where the documents are put together by position and their ids stored. So words,
not tokens, are shuffled: positions stay in the documents' rows instead of becoming a row each. A map task's words
for one bucket are one row, as they are one segment of any shuffle. Blocks are put together in waves, of which each frees
what it read, so that the disk never holds all of them twice. Decoding is a pass of its own over the stored ids, which
meet the token-byte table there.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, numbered

#: Texts above this many characters are split without holding all their pre-tokens at once.
_LONG = 1 << 22
#: Characters of a block, and pre-tokens of a row of documents (a document is never cut).
_block_limit = 16 << 20
_CHUNK = 1 << 18
#: Waves in which blocks are put together; words whose ids a task remembers; ids of a batch.
WAVES = 4
_KNOWN = 1 << 21
_IDS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a rank file; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def share_ranks(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(read_ranks(path))


def _squeeze(*parts: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts))


def _open(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _order(high: np.ndarray) -> np.ndarray:
    """Where the low bytes lie: those of equal higher bytes together, as they are alike."""
    return np.argsort(np.minimum(high, 255).astype(np.uint8), kind="stable")


def _pack_numbers(x: np.ndarray) -> bytes:
    """Numbers under 2**32 by planes of equal bytes, compressed; the low bytes come last, in an order that the others tell."""
    x = x.astype("<u4")
    high = x >> 8
    return _squeeze(np.ascontiguousarray(high.view(np.uint8).reshape(-1, 4)[:, :3].T), x.astype(np.uint8)[_order(high)])


def _numbers(z: bytes) -> np.ndarray:
    planes = np.frombuffer(_open(z), np.uint8).reshape(4, -1)
    high = np.zeros((planes.shape[1], 4), np.uint8)
    high[:, :3] = planes[:3].T
    high = high.view("<u4").ravel()
    x = np.empty(len(high), np.uint32)
    x[_order(high)] = planes[3]
    return x | high << 8


class _Block:
    """Distinct pre-tokens of some documents, numbered, and the documents as numbers."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.docs: list[tuple[int, np.ndarray]] = []
        self.chars = 0

    def add(self, doc: int, text: str, pattern: regex.Pattern) -> None:
        found = pattern.findall(text) if len(text) <= _LONG else (m[0] for m in pattern.finditer(text))
        number = self.number
        self.docs.append((doc, np.fromiter((number.setdefault(w, len(number)) for w in found), np.uint32)))
        self.chars += len(text)

    def rows(self, block: int, buckets: int) -> pd.DataFrame:
        """Rows of documents (ids, their numbers of pre-tokens, and the pre-tokens), and a row of words for each bucket.

        Words are renumbered by how often they occur, so that most numbers are small; a bucket's row lists its words' numbers.
        """
        count = np.zeros(len(self.number), np.int64)
        for _, x in self.docs:
            np.add.at(count, x, 1) if len(x) < 100 else np.add(count, np.bincount(x, minlength=len(count)), out=count)
        order = np.argsort(-count, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        out, part, held = [], [], 0
        for i, (doc, x) in enumerate(self.docs):
            part.append((doc, x))
            held += len(x)
            if held >= _CHUNK or i == len(self.docs) - 1:
                out.append((block, [d for d, _ in part], [len(y) for _, y in part], None, None, _pack_numbers(place[np.concatenate([y for _, y in part])])))
                part, held = [], 0
        listed = list(self.number)
        words = [listed[i].encode("utf-8", "surrogatepass") for i in order.tolist()]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        by = np.argsort(bucket, kind="stable")
        first = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
        for b in np.unique(bucket).tolist():
            at = by[first[b] : first[b + 1]]
            mine = [words[i] for i in at.tolist()]
            sizes = np.fromiter(map(len, mine), "<u4", len(mine))
            out.append((block, None, None, b, _pack_numbers(np.diff(at, prepend=0)), _squeeze(np.array([len(mine)], "<u4"), sizes, *mine)))
        return pd.DataFrame(out, columns=["block", "docs", "sizes", "bucket", "at", "z"]).astype({"bucket": "Int64"})


def _words(z: bytes) -> list[bytes]:
    data = _open(z)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64))) + 4 + 4 * n
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents' ids from rows in order of block, a block's words first, then its documents' rows."""
    block, words, begin, length, flat = None, [], None, None, None
    for x in batches:
        out, held = [], 0
        for b, docs, counts, at, z in zip(x["block"], x["docs"], x["sizes"], x["at"], x["z"], strict=True):
            if b != block:
                block, words, flat = b, [], None
            if at is not None:
                words.append((at, z))
                continue
            if flat is None:
                begin, length, flat = _listed(words)
                words = []
            numbers = _numbers(z)
            s = length[numbers]
            ends = np.concatenate(([0], np.cumsum(s)))
            ids = flat[np.repeat(begin[numbers] - ends[:-1], s) + np.arange(ends[-1])].astype(np.int32)
            out.append(pd.DataFrame({"doc": docs, "ids": np.split(ids, ends[np.cumsum(counts)[:-1]])}))
            held += len(ids)
            if held >= _IDS:
                yield pd.concat(out, ignore_index=True)
                out, held = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)


def _listed(words: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each number of a block's words where its ids begin, and how many they are; all ids."""
    at, sizes, flat = [], [], []
    for a, z in words:
        data = _numbers(z)
        n = int(data[0])
        at.append(np.cumsum(_numbers(a), dtype=np.int64))
        sizes.append(data[1 : 1 + n].astype(np.int64))
        flat.append(data[1 + n :])
    at, size, flat = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (at, sizes, flat))
    begin, length = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    begin[at], length[at] = np.cumsum(size) - size, size
    return begin, length, flat


def encode(docs: DataFrame, ranks: Broadcast, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), a row for each row of docs, stored; null and empty texts have no ids.

    Repeated rows are encoded each, and null ids kept. A text is split and put together in one row, however long, in
    some bytes for each of its own. An empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch, buckets, (plain, name, _) = Scratch(spark), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), numbered(docs)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled, task = regex.compile(pattern), TaskContext.get().partitionId()
        block, n = _Block(), 0
        for x in batches:
            for doc, t in zip(x["doc"], x["text"], strict=True):
                block.add(doc, t or "", compiled)
                if block.chars >= _block_limit:
                    yield block.rows(task << 32 | n, buckets)
                    block, n = _Block(), n + 1
        if block.docs:
            yield block.rows(task << 32 | n, buckets)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        bucket, known = None, {}
        for x in batches:
            done = []
            for b, z in zip(x["bucket"], x["z"], strict=True):
                if b != bucket:
                    bucket, known = b, {}
                ids = []
                for w in _words(z):
                    if (found := known.get(w)) is None:
                        if len(known) >= _KNOWN:
                            known.clear()
                        found = known[w] = np.array(coder._encode_single_piece(w), "<u4").tobytes()
                    ids.append(found)
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                done.append(_pack_numbers(np.concatenate((np.array([len(ids)], np.uint32), sizes, np.frombuffer(b"".join(ids), "<u4")))))
            yield pd.DataFrame({"block": x["block"], "at": x["at"], "ids": done})

    rows = plain.select(F.coalesce(F.col(name(doc_id)).cast("long"), F.lit(-(2**63))).alias("doc"), F.col(name(text)).alias("text"))
    kinds = "block long, docs array<long>, sizes array<int>, bucket long, at binary, z binary"
    blocks = rows.mapInPandas(split, kinds).withColumn("kind", F.when(F.col("bucket").isNotNull(), -1).otherwise(_wave()))
    blocks = scratch.write(blocks, "blocks", by="kind")
    dealt = blocks.where("kind = -1").select("block", "bucket", "at", "z").repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    coded = scratch.write(dealt.mapInPandas(merge, "block long, at binary, ids binary").withColumn("kind", _wave()), "words", by="kind")
    scratch.drop(blocks, within="kind=-1")
    path = scratch.path("ids")
    for wave in range(WAVES):
        words = coded.where(F.col("kind") == wave).select("block", "at", F.col("ids").alias("z"))
        texts = blocks.where(F.col("kind") == wave).select("block", "docs", "sizes", "z")
        both = words.unionByName(texts, allowMissingColumns=True).select("block", "docs", "sizes", "at", "z")
        place = F.pmod(F.floor(_order_of() / WAVES), F.lit(buckets)).cast("int")
        both = both.repartitionById(buckets, place).sortWithinPartitions("block", F.col("at").isNull())
        scratch.write_to(both.mapInPandas(_together, "doc long, ids array<int>"), f"{path}/wave={wave}")
        for part in (blocks, coded):
            scratch.drop(part, within=f"kind={wave}")
    done = spark.read.schema("doc long, ids array<int>").option("recursiveFileLookup", "true").parquet(path)
    return done.withColumn("doc", F.nullif("doc", F.lit(-(2**63)))).withColumnRenamed("doc", "doc_id")


def _order_of() -> Column:
    """Blocks' ids as small numbers, about one each: the task, and which of its blocks."""
    return F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit(0xFFFFFFFF))


def _wave() -> Column:
    return F.pmod(_order_of(), F.lit(WAVES)).cast("int")


class Decoder:
    """The token-byte table, which ids are joined with by position: a token's place is its id."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(ranks.values(), default=-1) + 1
        table = [b""] * n
        self.known = np.zeros(n, bool)
        for token, i in ranks.items():
            table[i] = token
            self.known[i] = True
        self.size = np.fromiter(map(len, table), np.int64, n)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.known) and self.known[ids].all()):
            raise ValueError("an id outside the token-byte table")
        out = []
        for at in range(0, len(ids), _IDS):
            part = ids[at : at + _IDS]
            size = self.size[part]
            ends = np.cumsum(size)
            out.append(self.bytes[np.repeat(self.begin[part] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


def _decoded(encoded: DataFrame, ranks: Broadcast, ids: str, kinds: str, finish: Callable[[pd.DataFrame, list[bytes]], pd.DataFrame]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Decoder(ranks.value)
        for x in batches:
            yield finish(x, [b"" if i is None else table.bytes_of(i) for i in x[ids]])

    return encoded.mapInPandas(run, kinds)


def decode(encoded: DataFrame, ranks: Broadcast, ids: str = "ids") -> DataFrame:
    """encoded with ``decoded`` (binary) in place of the ids; an id outside the table fails. Null ids decode to nothing."""
    rest = [f.name for f in encoded.schema if f.name != ids]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != ids)
    return _decoded(encoded, ranks, ids, f"{kinds}, decoded binary", lambda x, found: x[rest].assign(decoded=found))


def digests(docs: DataFrame, ranks: Broadcast, pattern: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256; ids if asked): digests of the ids that ``encode`` stored, as little-endian 32-bit integers, and of what they decode to."""

    def finish(x: pd.DataFrame, found: list[bytes]) -> pd.DataFrame:
        made = pd.DataFrame({"doc_id": x["doc_id"], "n_tokens": [len(i) for i in x["ids"]]})
        made["ids_sha256"] = [hashlib.sha256(np.asarray(i, "<u4").tobytes()).hexdigest() for i in x["ids"]]
        made["decoded_sha256"] = [hashlib.sha256(d).hexdigest() for d in found]
        return made.assign(ids=x["ids"]) if keep_ids else made

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    found = _decoded(encode(docs, ranks, pattern, doc_id, text), ranks, "ids", kinds, finish)
    return Scratch(docs.sparkSession).write(found, "digests")  # in batches of bounded bytes
