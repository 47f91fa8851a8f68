"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pandas as pd
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components, skew_join

#: Bits of a code at most.
BITS = 256
#: Up to so many vectors of a length share one bucket and are all compared: a quantiser fitted on so few says little.
FEW = 256
#: Share of pairs at the threshold that the tables must bring together, as measured in the fit.
TARGET = 0.97
#: Buckets of so many vectors are looked at for groups of near copies.
HEAVY = 16
#: Keys that a vector may look up in a table.
_BALL = 700
#: Angles this close to a bound are compared, not concluded.
_MARGIN = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows, or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass(frozen=True)
class Quantiser:
    """Signs of the unit vectors, less a mean, along learned directions (dim x bits)."""

    mean: np.ndarray
    directions: np.ndarray

    def bits(self, units: np.ndarray) -> np.ndarray:
        return (units - self.mean) @ self.directions > 0


def fit(units: np.ndarray, centred: bool, bits: int = BITS, rounds: int = 40, seed: int = 42) -> Quantiser:
    """Principal directions of a sample, rotated so that its signs lose least (alternating codes and the best rotation).

    Bits come in blocks of as many as there are directions, each from another start; with one direction the rest are random.
    """
    mean = units.mean(axis=0) if centred else np.zeros(units.shape[1])
    x, dim, rng = units - mean, units.shape[1], np.random.default_rng(seed)
    k = min(64, dim)
    main = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :k]
    v, blocks = x @ main, []
    for _ in range(-(-bits // k) if k >= 8 else 1):
        turn = np.linalg.qr(rng.standard_normal((k, k)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        blocks.append(main @ turn)
    found = np.hstack(blocks)[:, :bits]
    return Quantiser(mean, np.hstack([found, rng.standard_normal((dim, bits - found.shape[1]))]))


@dataclass(frozen=True)
class Index:
    """``tables`` segments of ``width`` bits, looked up within ``radius``; partners differ in ``within`` bits at most. Width 0 is one bucket of all."""

    quantiser: Quantiser | None
    width: int = 0
    radius: int = 0
    tables: int = 1
    within: int = 0
    recall: float = 1.0

    @property
    def segments(self) -> list[str]:
        """Columns of a code: its segment for each table."""
        return [f"s{t}" for t in range(self.tables)]

    @property
    def words(self) -> list[str]:
        """Columns of a code: all its bits in words of 64."""
        return [f"w{i}" for i in range(-(-self.tables * self.width // 64))]

    def codes(self, units: np.ndarray) -> dict[str, np.ndarray]:
        if self.width == 0:
            return {"s0": np.zeros(len(units), np.int64)}
        bits = self.quantiser.bits(units)[:, : self.width * self.tables]
        s = _segments(bits, self.width, self.tables)
        w = np.packbits(np.pad(bits, ((0, 0), (0, 64 * len(self.words) - bits.shape[1]))), axis=1).view(np.int64)
        return {c: s[:, t] for t, c in enumerate(self.segments)} | {c: w[:, i] for i, c in enumerate(self.words)}

    @property
    def masks(self) -> list[int]:
        return [0, *(reduce(or_, (1 << b for b in c)) for n in range(1, self.radius + 1) for c in combinations(range(self.width), n))]


def _segments(bits: np.ndarray, width: int, tables: int) -> np.ndarray:
    return bits[:, : width * tables].reshape(len(bits), tables, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def _ball(width: int, radius: int) -> int:
    n, out = 1, 1
    for i in range(radius):
        n = n * (width - i) // (i + 1)
        out += n
    return out


def _planted(units: np.ndarray, least: float, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at a cosine of ``least``: apart in a random direction, in that of another vector; and pairs of the sample above it."""
    angle, out = np.arccos(least), []
    for other in (rng.standard_normal(units.shape), units[rng.permutation(len(units))]):
        side = other - np.einsum("ij,ij->i", other, units)[:, None] * units
        size = np.linalg.norm(side, axis=1)
        fine = size > 1e-9
        out.append((units[fine], np.cos(angle) * units[fine] + np.sin(angle) * side[fine] / size[fine][:, None]))
    a, b = np.nonzero(np.triu(units @ units.T >= least, 1))
    pick = rng.permutation(len(a))[:20_000]
    return [p for p in [*out, (units[a[pick]], units[b[pick]])] if len(p[0]) >= 50]


def plan(sample: np.ndarray, n: int, least: float, seed: int = 42, probe: int = 2000) -> Index:
    """The cheapest index over ``n`` vectors that brings at least ``TARGET`` of each kind of ``_planted`` pairs together.

    Quantisers with and without centring are fitted on the sample; widths, radii and numbers of tables are weighed by
    the keys that they look up and by the candidates that the sample's own pairs let expect. Where none reaches
    the target, one bucket holds all vectors, which loses none.
    """
    units, rng = _unit(sample), np.random.default_rng(seed)
    some = units[:probe]
    pairs = _planted(some, least, rng)
    i, j = (rng.integers(0, len(some), 400_000) for _ in range(2))
    i, j = i[i != j], j[i != j]
    best, cost = Index(None), 0.3 * n * n / 2
    for centred in (False, True):
        model = fit(units, centred, seed=seed)
        own, both = model.bits(some), [(model.bits(a), model.bits(b)) for a, b in pairs]
        for width in (w for w in (8, 12, 16, 20, 24, 28, 32) if w <= max(8, np.log2(n) + 6)):
            most = min(BITS // width, 16)
            s = _segments(own, width, most)
            met = [np.bitwise_count(_segments(a, width, most) ^ _segments(b, width, most)) for a, b in both]
            chance = np.bitwise_count(s[i] ^ s[j])
            for radius in (r for r in range(4) if _ball(width, r) <= _BALL):
                share = np.min([np.logical_or.accumulate(m <= radius, axis=1).mean(axis=0) for m in met], axis=0) if met else np.ones(most)
                if not (share >= TARGET).any():
                    continue
                tables = int(np.argmax(share >= TARGET)) + 1
                meet = max((chance[:, :tables] <= radius).mean(), _ball(width, radius) / 2.0**width)
                price = n * tables * (1 + _ball(width, radius) / 2) + 0.3 * n * n / 2 * tables * meet
                if price < cost:
                    far = np.concatenate([m[:, :tables].sum(axis=1) for m in met]) if met else np.zeros(1)
                    best, cost = Index(model, width, radius, tables, int(np.quantile(far, 0.999, method="higher")), float(share[tables - 1])), price
    return best


def usable(vector: Column) -> Column:
    """Is it not null, of finite numbers, and not zero?"""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _coded(vectors: DataFrame, name: str, index: Index) -> DataFrame:
    """(name, and its code's columns) of (name, v)."""
    columns = [*index.segments, *index.words]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield pd.DataFrame({name: x[name], **index.codes(_unit(np.stack(x["v"])))})

    return vectors.select(name, "v").mapInPandas(run, ", ".join(f"{c} long" for c in [name, *columns]))


def _keys(codes: DataFrame, index: Index, masks: list[int] = [0]) -> DataFrame:
    """codes with t, the table, and k, each key within the masks of its segment there.

    Of two segments that differ by a mask, one holds 0 at its lowest bit: that one looks the other up.
    """
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"s{t}").alias("s")) for t in range(index.tables)])).alias("e")
    found = codes.select("*", each).select(*codes.columns, F.col("e.t").alias("t"), F.col("e.s").alias("s"))
    if len(masks) > 1:
        mask = F.array(*[F.lit(m).cast("long") for m in masks])
        free = F.filter(mask, lambda m: F.col("s").bitwiseAND(m).bitwiseAND(-m) == 0)
        found = found.withColumn("s", F.explode(F.transform(free, lambda m: F.col("s").bitwiseXOR(m))))
    return found.withColumn("k", F.col("s").bitwiseOR(F.shiftleft(F.col("t").cast("long"), 32))).drop("s")


def _angle(x: pd.DataFrame, a: str, b: str) -> np.ndarray:
    """Angles between unit vectors, by their difference and sum: exact for small ones too."""
    p, q = _unit(np.stack(x[a])), _unit(np.stack(x[b]))
    return 2 * np.arctan2(np.linalg.norm(p - q, axis=1), np.linalg.norm(p + q, axis=1))


def _cells(scratch: Scratch, classes: DataFrame, codes: DataFrame, index: Index, limit: float) -> tuple[DataFrame, DataFrame] | None:
    """(cid, cell, rho) of vectors within half of ``limit`` of their cell's centre, so that all of a cell are linked; (cell, v) of the centres.

    The centres are means of heavy buckets; of several near each other, that of the largest stands for all. Any
    vectors may be in no cell: cells only spare comparisons.
    """
    rows = _keys(codes, index).select("k", "cid")
    heavy = scratch.write(rows.groupBy("k").agg(F.count("*").alias("m")).where(F.col("m") >= HEAVY), "heavy")
    if heavy.isEmpty():
        return None
    rows = scratch.write(skew_join(rows, heavy, ["k"]), "heavy-rows")
    scaled = Normalizer(p=2.0, inputCol="x", outputCol="y").transform(classes.select("cid", array_to_vector("v").alias("x"))).select("cid", "y")
    centres = skew_join(rows, scaled, ["cid"]).groupBy("k", "m").agg(Summarizer.mean(F.col("y")).alias("c")).select("k", "m", vector_to_array("c").alias("v"))
    centres = scratch.write(centres.where(usable(F.col("v"))), "centres")

    def near(batches: Iterator[pd.DataFrame], most: float, out: list[str]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                x["rho"] = _angle(x, "v", "c")
                yield x.loc[x["rho"] <= most, out]

    top = _keys(_coded(centres, "k", index).withColumnRenamed("k", "own"), index).select("k", "own")
    top = skew_join(top, centres.select(F.col("k").alias("own"), "m", "v"), ["own"])
    lead = top.groupBy("k").agg(F.max(F.struct("m", "own")).alias("l")).select("k", F.col("l.own").alias("lead"), F.col("l.m").alias("lm"))
    lead = skew_join(lead, centres.select(F.col("k").alias("lead"), F.col("v").alias("c")), ["lead"])
    close = skew_join(top, lead, ["k"]).select("own", "v", "lead", "lm", "c").mapInPandas(lambda it: near(it, limit / 8, ["own", "lead", "lm"]), "own long, lead long, lm long")
    chosen = scratch.write(close.groupBy(F.col("own").alias("k")).agg(F.max(F.struct("lm", "lead")).alias("l")).select("k", "l.lm", "l.lead"), "leads")
    asked = skew_join(rows.select("k", "cid"), chosen, ["k"]).select("cid", "lead", "lm").distinct()
    asked = skew_join(skew_join(asked, centres.select(F.col("k").alias("lead"), F.col("v").alias("c")), ["lead"]), classes.select("cid", "v"), ["cid"])
    inside = asked.select("cid", "lead", "lm", "v", "c").mapInPandas(lambda it: near(it, limit / 2 - _MARGIN, ["cid", "lead", "lm", "rho"]), "cid long, lead long, lm long, rho double")
    best = inside.groupBy("cid").agg(F.max(F.struct("lm", "lead", "rho")).alias("b"))
    return scratch.write(best.select("cid", F.col("b.lead").alias("cell"), F.col("b.rho").alias("rho")), "cells"), centres.select(F.col("k").alias("cell"), "v")


def _met(codes: DataFrame, index: Index) -> DataFrame:
    """(a, b) of nodes that meet in a table: each pair of single vectors once and within the index's distance; of cells perhaps often.

    codes: (node, and its code's columns), several rows for a cell (negative).
    """
    columns, cell = [*index.segments, *index.words], F.col("node") < 0

    def merged(rows: DataFrame) -> DataFrame:
        """A cell has a row for each key, without a code."""
        return rows.where(~cell).unionByName(rows.where(cell).withColumns({c: F.lit(None).cast("long") for c in columns}).distinct())

    table = merged(_keys(codes, index)).withColumnsRenamed({c: f"o{c}" for c in ["node", *columns]})
    probes = merged(_keys(codes, index, index.masks))
    far = [F.bit_count(F.col(c).bitwiseXOR(F.col(f"o{c}"))) for c in index.words]
    near = reduce(lambda x, y: x + y, far) <= index.within if far else F.lit(True)
    # Equal segments look each other up; other segments, one the other.
    apart = [(F.col(c) != F.col(f"o{c}")) if index.radius == 0 else F.bit_count(F.col(c).bitwiseXOR(F.col(f"o{c}"))) > index.radius for c in index.segments]
    equal = [F.col(c) == F.col(f"o{c}") for c in index.segments]
    single = F.lit(False)
    for t in range(index.tables):
        once = F.lit(True) if index.radius == 0 else ~equal[t]
        single = single | ((F.col("t") == t) & reduce(lambda x, y: x & y, apart[:t], once | (F.col("node") < F.col("onode"))))
    if index.radius == 0:
        near = (F.col("node") < F.col("onode")) & near
    pairs = probes.join(table.drop("t"), "k").where((F.col("node") != F.col("onode")) & (cell | (F.col("onode") < 0) | (near & single)))
    return pairs.select(F.least("node", "onode").alias("a"), F.greatest("node", "onode").alias("b"))


def links(scratch: Scratch, classes: DataFrame, least: float = 0.95, sample: int = 10_000, index: Index | None = None) -> tuple[DataFrame, DataFrame]:
    """Links of classes (cid, v, n), vectors of one length with a cosine of at least ``least`` in double precision.

    Returns (a, b), edges with the components of all links, and (cid, far): the rows, counted by n, that a class is linked
    with besides its own. The index is planned on ``sample`` classes at most, the least by a hash of cid; all are
    indexed. Vectors in one cell, or in cells near enough, are linked without comparing each pair.
    """
    spark, limit = classes.sparkSession, float(np.arccos(least))
    if index is None:
        picked = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("v").collect()
        n = len(picked) if len(picked) < sample else classes.count()
        index = plan(np.array([r["v"] for r in picked], np.float64), n, least) if n > FEW else Index(None)

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                a, b = (np.stack(x[c]).astype(np.float64) for c in ("va", "vb"))
                a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
                cos = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
                yield x.loc[cos >= least, ["a", "b"]]

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                apart, slack = _angle(x, "va", "vb"), (x["ra"] + x["rb"]).to_numpy()
                x["all"] = apart + slack <= limit - _MARGIN
                yield x.loc[apart - slack <= limit + _MARGIN, ["a", "b", "all"]]

    codes = scratch.write(_coded(classes, "cid", index), "codes")
    found = _cells(scratch, classes, codes, index, limit) if index.width else None
    weigh = lambda pairs: pairs.select(F.col("b").alias("cid"), F.col("n_a").alias("w")).unionByName(pairs.select(F.col("a").alias("cid"), F.col("n_b").alias("w")))
    if found is None:
        pairs = scratch.write(_met(codes.withColumnRenamed("cid", "node"), index), "candidates")
        edges, far = [], []
    else:
        cells, centres = found
        nodes = skew_join(classes, cells, ["cid"], "left").withColumn("node", F.coalesce(-F.col("cell") - 1, "cid")).select("node", "cid", "n", F.coalesce("rho", F.lit(0.0)).alias("rho"), "v")
        nodes = scratch.write(nodes, "nodes")
        inner = nodes.where("node < 0")
        cell = inner.groupBy("node").agg(F.sum("n").alias("all_n"), F.max("rho").alias("rho"), F.min("cid").alias("rep"))
        cell = scratch.write(skew_join(cell, centres.select((-F.col("cell") - 1).alias("node"), "v"), ["node"]), "cell")
        met = _met(skew_join(codes, nodes.select("cid", "node"), ["cid"]).drop("cid"), index)
        met = scratch.write(met, "met")
        pairs = met.where("a >= 0")
        double = lambda v: F.transform(v, lambda x: x.cast("double"))
        mixed = met.where("a < 0").distinct()
        ends = cell.select("node", "rho", "v").unionByName(nodes.where("node >= 0").select("node", "rho", double("v").alias("v")))
        for side in ("a", "b"):
            mixed = skew_join(mixed, ends.select(F.col("node").alias(side), F.col("rho").alias(f"r{side}"), F.col("v").alias(f"v{side}")), [side])
        mixed = scratch.write(mixed.mapInPandas(judged, T.StructType([*[T.StructField(c, T.LongType()) for c in "ab"], T.StructField("all", T.BooleanType())])), "cell-pairs")
        members = nodes.select("node", "cid")
        split = mixed.where("NOT all").select("a", "b")
        split = skew_join(split, members.select(F.col("node").alias("a"), F.col("cid").alias("x")), ["a"])
        split = skew_join(split, members.select(F.col("node").alias("b"), F.col("cid").alias("y")), ["b"])
        pairs = scratch.write(pairs.unionByName(split.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))), "candidates")
        rep = cell.select("node", "rep", "all_n").unionByName(nodes.where("node >= 0").select("node", F.col("cid").alias("rep"), F.col("n").alias("all_n")))
        whole = mixed.where("all").select("a", "b")
        for side in ("a", "b"):
            whole = skew_join(whole, rep.select(F.col("node").alias(side), F.col("rep").alias(f"r{side}"), F.col("all_n").alias(f"n_{side}")), [side])
        whole = scratch.write(whole, "whole")
        per_node = weigh(whole).groupBy(F.col("cid").alias("node")).agg(F.sum("w").alias("w"))
        sized = skew_join(inner.select("node", "cid", "n"), cell.select("node", "all_n", "rep"), ["node"])
        edges = [sized.where("cid <> rep").select(F.col("rep").alias("a"), F.col("cid").alias("b")), whole.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))]
        far = [sized.select("cid", (F.col("all_n") - F.col("n")).alias("w")), skew_join(nodes.select("node", "cid"), per_node, ["node"]).select("cid", "w")]
    vectors = classes.select("cid", "n", "v")
    for side in ("a", "b"):
        pairs = skew_join(pairs, vectors.select(F.col("cid").alias(side), F.col("v").alias(f"v{side}")), [side])
    linked = scratch.write(pairs.select("a", "b", "va", "vb").mapInPandas(rerank, "a long, b long"), "linked")
    counts = linked
    for side in ("a", "b"):
        counts = skew_join(counts, classes.select(F.col("cid").alias(side), F.col("n").alias(f"n_{side}")), [side])
    far = reduce(DataFrame.unionByName, far, weigh(counts)).groupBy("cid").agg(F.sum("w").alias("far"))
    return reduce(DataFrame.unionByName, edges, linked), scratch.write(far, "far")


def _few_links(scratch: Scratch, classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``links`` for all lengths that few vectors have, each length a bucket of at most ``FEW``: all are compared."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for cid, v, others, vs in zip(x["cid"], x["v"], x["cids"], x["vs"], strict=True):
                m = np.stack([np.asarray(r, np.float64) for r in vs])
                m = m / np.abs(m).max(axis=1, keepdims=True)
                v = np.asarray(v, np.float64)
                v = v / np.abs(v).max()
                cos = np.einsum("ij,j->i", m, v) / (np.linalg.norm(m, axis=1) * np.linalg.norm(v))
                others = np.asarray(others)
                rows.append((cid, others[(cos >= least) & (others != cid)]))
            yield pd.DataFrame(rows, columns=["cid", "others"])

    sized = classes.withColumn("d", F.size("v"))
    listed = sized.groupBy("d").agg(F.collect_list("cid").alias("cids"), F.collect_list("v").alias("vs"))
    found = sized.join(listed, "d").select("cid", "v", "cids", "vs").mapInPandas(run, "cid long, others array<long>")
    found = scratch.write(found.select("cid", F.explode("others").alias("b")), "few")
    far = skew_join(found, classes.select(F.col("cid").alias("b"), "n"), ["b"]).groupBy("cid").agg(F.sum("n").alias("far"))
    return found.where("cid < b").select(F.col("cid").alias("a"), "b"), far


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors.

    Equal vectors form a class and are compared once; n_links counts all other rows linked directly. component_id is
    the smallest vec_id reachable, kept says whether it is the row's own. Vectors that are null, empty, zero or hold null or
    non-finite numbers, link with nothing, vectors only with those of their own length; a null vec_id is the least long while linking.
    Very long vectors cost their length in the rerank only. Repeated rows count each; an empty table gives none. Other columns are not read.
    """
    scratch, none, spark = Scratch(vectors.sparkSession), -(2**63), vectors.sparkSession
    kind = vectors.schema[vector].dataType
    given = F.col(f"`{vector}`") if isinstance(kind, T.ArrayType) and kind.elementType == T.FloatType() else F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.coalesce(F.col(f"`{vec_id}`").cast("long"), F.lit(none)).alias("id"), given.alias("v")).withColumn("ok", usable(F.col("v")))
    grouped = rows.where("ok").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = scratch.write(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    lengths = {r["d"]: r["c"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).collect()}  # a row for each length
    many = sorted(d for d, c in lengths.items() if c > FEW)
    each = [_few_links(scratch, classes.where(~F.size("v").isin(many)), least)] if len(many) < len(lengths) else []
    each += [links(scratch, classes.where(F.size("v") == d), least) for d in many]
    found = scratch.write(reduce(DataFrame.unionByName, [e for e, _ in each], spark.createDataFrame([], "a long, b long")), "links")
    weighed = reduce(DataFrame.unionByName, [w for _, w in each], spark.createDataFrame([], "cid long, far long"))
    comp = connected_components(scratch, found).withColumnRenamed("node", "cid")
    named = skew_join(skew_join(classes, weighed, ["cid"], "left"), comp, ["cid"], "left")
    named = scratch.write(named.select("v", "rep", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("label")), "named")
    least_id = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = skew_join(named.select("v", "n_links", "label"), least_id, ["label"]).drop("label")
    joined = skew_join(rows.withColumn("v", F.when(F.col("ok"), F.col("v"))), named, ["v"], "left")
    comp_id = F.coalesce("component_id", "id")
    return joined.select(
        F.nullif("id", F.lit(none)).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.nullif(comp_id, F.lit(none)).alias("component_id"), (comp_id == F.col("id")).alias("kept")
    )
