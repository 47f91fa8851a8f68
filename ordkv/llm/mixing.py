"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, n_words, numbered, running_totals, skew_join

#: A draw has so many bits; each round of the search for a threshold settles some of them.
_BITS, _ROUND = 60, 15


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A seeded number of 60 bits for an id and a text; documents of a source are taken by it from the least up. Nulls draw as ``''``."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(part(doc_id), F.lit(f":{seed}:"), F.md5(part(text)))), 1, 15), 16, 10).cast("long")


def fill(scratch: Scratch, sources: DataFrame, weights: list[int], epochs: int) -> DataFrame:
    """(source, source_size, target): the total size shared by weight, clamped at ``epochs`` times a source's size.

    The weights repeat over the sources by code point, null last. Each round clamps the sources above their
    limit and shares what is left by weight among the others; only a round's three totals reach the driver.
    """
    ranked = running_totals(scratch, sources.withColumn("__null", F.col("source").isNull()), ["__null", "source"], {}, "ranked")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__index") % len(weights) + 1).cast("int"))
    ranked = scratch.write(ranked.select("source", "source_size", pick.cast("long").alias("w"), (F.col("source_size") * epochs).alias("cap")), "weighed")
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("cap") < F.col("w") * F.lit(level)
        r = ranked.agg(F.sum("source_size"), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("w"))), F.count(F.when(over, 1))).first()
        if r[3] == clamped or not r[2]:
            break
        clamped, level = r[3], (r[0] - (r[1] or 0)) / r[2]
    share = F.col("w") * F.lit(float(level or 0.0))
    return ranked.select("source", "source_size", F.when(F.col("cap") < share, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _thresholds(scratch: Scratch, rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, theta, base): the draw at which the words taken first reach ``rest``, and the words before it.

    A histogram over the first bits of the draws finds the bin in which that is, the next one cuts this bin, and so
    on until all bits are known: no bin's documents meet in one task. A source whose words all fit has no row.
    """
    at = targets.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("base"))
    for left in range(_BITS - _ROUND, -1, -_ROUND):
        at = at.withColumnRenamed("bin", "above")
        keyed = rows.withColumns({"bin": F.shiftright("u", left), "above": F.shiftright(F.shiftright("u", left), _ROUND)})
        bins = skew_join(keyed, at.select("source", "above"), ["source", "above"]).groupBy("source", "above", "bin").agg(F.sum("size").alias("s"))
        bins = skew_join(bins, at, ["source", "above"])
        upto = F.col("base") + F.sum("s").over(Window.partitionBy("source").orderBy("bin"))  # a row for each of 32,768 bins
        found = bins.withColumn("upto", upto).where("upto >= rest").groupBy("source", "rest").agg(F.min(F.struct("bin", (F.col("upto") - F.col("s")).alias("base"))).alias("f"))
        at = scratch.write(found.select("source", "rest", "f.bin", "f.base"), f"cut-{left}")
    return at.select("source", F.col("bin").alias("theta"), "base")


def plan(docs: DataFrame, weights: list[int], epochs: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, shares). rows: (doc_id, source, size, u). shares: (source, source_size, target, whole, rest, theta, base).

    The mix takes each document of a source ``whole`` times, and once more if its draw u is under the threshold theta,
    or at it and among the rows of that draw that bring the words nearest the target (half a document at most). Rows
    of one id and text draw the same number; being alike, any of them may be among those. An empty source has target 0.
    """
    scratch, (plain, name, _) = Scratch(docs.sparkSession), numbered(docs)
    given = F.col(name(text))
    rows = plain.select(F.col(name(doc_id)).alias("doc_id"), F.col(name(source)).alias("source"), n_words(given).alias("size"), draw(F.col(name(doc_id)), given, seed).alias("u"))
    rows = scratch.write(rows, "sizes")
    targets = fill(scratch, rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = scratch.write(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    shares = skew_join(targets, _thresholds(scratch, rows, targets), ["source"], "left").withColumn("theta", F.coalesce("theta", F.lit(-1)))
    return rows, scratch.write(shares, "shares")


def _copies(rows: DataFrame, shares: DataFrame, size: Column) -> DataFrame:
    """rows (source, u, ...) with ``copies`` and the columns of shares; rows at a threshold are put in some order, which partitions' sums make."""
    scratch, drawn = Scratch(rows.sparkSession), skew_join(rows, shares, ["source"])
    level = scratch.write(drawn.where("u = theta").withColumns({"words": size, "salt": F.monotonically_increasing_id()}), "level")
    level = scratch.write(running_totals(scratch, level, ["source", "salt"], {"before": "words"}, "ranked"), "at-theta")
    level = skew_join(level, level.groupBy("source").agg(F.min("before").alias("from")), ["source"])
    more = (2 * (F.col("base") + F.col("before") - F.col("from")) + F.col("words") <= 2 * F.col("rest")).cast("long")
    other = drawn.where("u <> theta").withColumn("copies", F.col("whole") + (F.col("u") < F.col("theta")).cast("long"))
    return other.unionByName(level.withColumn("copies", F.col("whole") + more).select(*other.columns))


def mix(docs: DataFrame, weights: list[int], epochs: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of docs; see ``plan``.

    Null and empty texts have size 0 and nothing is taken of them; a very long text is taken whole or not, so half of
    it bounds the error. Null is a source of its own, the last. An empty table gives none. Only id, text and source are read.
    """
    rows, shares = plan(docs, weights, epochs, seed, doc_id, text, source)
    return _copies(rows, shares, F.col("size")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_by_mix(docs: DataFrame, weights: list[int], epochs: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it."""
    _, shares = plan(docs, weights, epochs, seed, doc_id, text, source)
    plain, name, back = numbered(docs)
    keyed = plain.withColumns({"source": F.col(name(source)), "u": draw(F.col(name(doc_id)), F.col(name(text)), seed)})
    found = _copies(keyed, shares, n_words(F.col(name(text))))
    return back(found.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))))
