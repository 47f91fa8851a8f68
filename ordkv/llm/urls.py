"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered, skew_join


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Up to so many rules their index is broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """Fits urls of ``host`` (A-Z are lower-cased) and its subdomains (empty: of any host) whose path starts with ``path`` (empty: any path)."""

    verdict: str
    host: str
    path: str = "/"

    def __post_init__(self):
        if self.verdict not in ("allow", "block") or "/" in self.host or self.path[:1] not in ("", "/"):
            raise ValueError(f"not a rule: {self}")
        object.__setattr__(self, "host", self.host.translate(_LOWER))

    @property
    def tokens(self) -> list[str]:
        """Literals that every url it fits has: host labels, and whole path segments; none: the token of all urls."""
        found = [f"h:{x}" for x in self.host.split(".") if x] + [f"p:{x}" for x in self.path.split("/")[1:-1] if x]
        return list(dict.fromkeys(found)) or ["*"]

    @property
    def regex(self) -> str:
        """Over host and path, which a slash or the end tells apart."""
        return (rf"^(?:[^/]*\.)?{re.escape(self.host)}" if self.host else "^[^/]*") + (re.escape(self.path) or "(?=/|$)")


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    u, at = F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(u, at, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, at, 2)


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a url: each label of the host, each segment of the path, and the token of all urls."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(F.array(F.lit("*")), labels, segments))


def index(rules: list[Rule], held: dict[str, int]) -> list[tuple[str, str, str, str]]:
    """(token, rule, regex, verdict) of each rule, filed under its token that the fewest urls hold (of equals the least)."""
    return [(min(r.tokens, key=lambda t: (held.get(t, 0), t)), r.host + r.path, r.regex, r.verdict) for r in rules]


def candidates(spread: DataFrame, rules: list[Rule], small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """spread (urls by token) with the rules filed under the token: the only ones to run."""
    spark, known = spread.sparkSession, sorted({t for r in rules for t in r.tokens})
    mine = spread.join(small(spark.createDataFrame([(t,) for t in known], "token string")), "token", "left_semi")
    counted = mine.groupBy("token").count().collect()  # one row a token of the rules at most
    filed = index(rules, {r["token"]: r["count"] for r in counted})
    return spread.join(small(spark.createDataFrame(filed, "token string, rule string, regex string, verdict string")), "token")


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with ``__host``, ``__path``, ``__rule`` (null: none fits) and ``__verdict`` (``default`` where none fits), in place of columns of that name.

    Each distinct host and path is judged once. Its tokens fetch the rules indexed under them, only those run
    their regular expression, and of those that fit the longest wins (of equals the one later in code point
    order, then ``block``). A rule's token is the one that the fewest urls hold. Any row gets one verdict.
    """
    scratch = Scratch(pages.sparkSession)
    plain, name, back = numbered(pages)
    host, path = parse(F.col(name(url)))
    keyed = plain.withColumns({"__host": host, "__path": path})
    keys = scratch.write(keyed.select("__host", "__path").distinct(), "urls")
    spread = keys.withColumn("token", F.explode(tokens(F.col("__host"), F.col("__path"))))
    small = F.broadcast if len(rules) <= BROADCAST_RULES else lambda x: x
    fit = candidates(spread, rules, small).where("concat(__host, __path) RLIKE regex")
    best = fit.groupBy("__host", "__path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("b"))
    best = best.select("__host", "__path", F.col("b.rule").alias("__rule"), F.col("b.verdict").alias("__verdict"))
    judged = skew_join(keyed, best, ["__host", "__path"], "left").withColumn("__verdict", F.coalesce("__verdict", F.lit(default)))
    return back(judged, "__host", "__path", "__rule", "__verdict")
