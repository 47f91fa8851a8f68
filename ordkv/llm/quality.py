"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered, words

#: Votes.
GOOD, NONE, BAD = 1, 0, -1

#: Columns that ``signals`` adds.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_letters", "n_bangs", "n_stops", "n_distinct"]

# Words in 5-word windows that occur twice: hashes rule out most texts, the windows themselves decide.
_HASHES = "CASE WHEN size(__w) < 5 THEN array() ELSE transform(sequence(0, size(__w) - 5), i -> xxhash64(__w[i], __w[i+1], __w[i+2], __w[i+3], __w[i+4])) END"
_REPEATS = """
CASE WHEN size(array_distinct(__h)) = size(__h) THEN 0L ELSE
  transform(array(array_sort(transform(sequence(0, size(__w) - 5), i -> struct(concat_ws(' ', __w[i], __w[i+1], __w[i+2], __w[i+3], __w[i+4]) AS s, i AS i)))), v ->
    transform(array(array_sort(filter(transform(sequence(0, size(v) - 1), j ->
        IF((j > 0 AND v[j].s = v[greatest(j - 1, 0)].s) OR (j < size(v) - 1 AND v[j].s = v[least(j + 1, size(v) - 1)].s), v[j].i, NULL)), x -> x IS NOT NULL))), p ->
      IF(size(p) = 0, 0L, aggregate(sequence(0, greatest(size(p) - 1, 0)), 0L, (acc, j) -> acc + IF(j = size(p) - 1, 5, least(5, p[least(j + 1, size(p) - 1)] - p[j])))))[0])[0]
END"""


def signals(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the columns BASE and MORE (long), each name after ``prefix``, in place of columns of that name; null text counts as empty.

    A text is measured in one row, however long; its words take some times its size in memory.
    """
    plain, name, back = numbered(docs)
    t = F.coalesce(F.col(name(text)), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = plain.withColumns({"__w": words(F.col(name(text))), "__l": lines}).withColumn("__h", F.expr(_HASHES))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    only = lambda pattern: F.char_length(F.regexp_replace(t, f"[^{pattern}]+", ""))
    cols = {
        "n_words": F.size("__w"),
        "word_chars": F.char_length(F.array_join("__w", "")),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.expr(_REPEATS),
        "n_lines": F.size("__l"),
        "n_upper": only(r"\p{Lu}"),
        "n_letters": only(r"\p{L}"),
        "n_bangs": count(r"!"),
        "n_stops": count(r"[.?!;:](?=[\x20\x09-\x0D]|$)"),
        "n_distinct": F.size(F.array_distinct("__w")),
    }
    return back(made.withColumns({prefix + k: v.cast("long") for k, v in cols.items()}), *[prefix + k for k in cols])


def rules(prefix: str = "") -> dict[str, Column]:
    """Votes of each rule over the columns of ``signals``; most can only tell one side and else abstain."""
    c: Callable[[str], Column] = lambda name: F.col(prefix + name).cast("double")
    per_word = lambda name: c(name) / F.greatest(c("n_words"), F.lit(1.0))
    upper = c("n_upper") / F.greatest(c("n_letters"), F.lit(1.0))
    length = per_word("word_chars")
    bad = lambda x: F.when(x, BAD).otherwise(NONE)
    both = lambda x, y: F.when(x, BAD).when(y, GOOD).otherwise(NONE)
    return {
        "symbols": bad(per_word("n_symbols") >= 0.15),
        "shouting": bad((upper >= 0.6) & (c("n_letters") >= 20)),
        "bangs": bad(per_word("n_bangs") >= 0.3),
        "dup_lines": bad((c("n_dup_lines") >= 0.3 * c("n_lines")) & (c("n_dup_lines") > 0)),
        "repeats": bad(per_word("n_repeat_words") >= 0.15),
        "word_length": bad((length < 2) | (length > 18)),
        "letters": both(c("n_letters") < 0.6 * c("word_chars"), c("n_letters") >= 0.75 * c("word_chars")),
        "variety": both((per_word("n_distinct") < 0.15) & (c("n_words") >= 50), (per_word("n_distinct") >= 0.35) & (c("n_words") >= 10)),
        "sentences": both((c("n_stops") == 0) & (c("n_words") >= 60), (per_word("n_stops") >= 0.02) & (per_word("n_stops") <= 0.35) & (per_word("n_symbols") < 0.05) & (upper < 0.4)),
    }


def _pooled(low: tuple[float, float], high: tuple[float, float]) -> tuple[float, float]:
    """The likeliest rates of two binomials (yes, all) of which the first is at most the second: their own, or the common one."""
    a, b = low[0] / low[1], high[0] / high[1]
    both = (low[0] + high[0]) / (low[1] + high[1])
    return (a, b) if a <= b else (both, both)


class LabelModel:
    """P(good), and for each rule P(vote | good) and P(vote | junk), for votes in the order -1, 0, 1.

    Rules are taken to vote independently within a class. Priors: ``strength`` of the rows count as if they followed
    the starting values (at least one row), whatever the number of rows. A rule may be of no use, but never speaks
    for the other side: junk is voted BAD at least as often as good, and GOOD at most as often among the other votes.
    """

    def __init__(self, n_rules: int, strength: float = 0.02):
        self.strength = strength
        self.prior = 0.7
        self.good = [[0.02, 0.58, 0.40] for _ in range(n_rules)]
        self.junk = [[0.30, 0.55, 0.15] for _ in range(n_rules)]

    def weights(self) -> list[list[float]]:
        """For each rule what its votes -1, 0, 1 add to the log odds of quality."""
        return [[math.log(a / b) for a, b in zip(g, j, strict=True)] for g, j in zip(self.good, self.junk, strict=True)]

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(w[v + 1] for w, v in zip(self.weights(), votes, strict=True))

    def _pseudo(self, total: float) -> tuple[float, LabelModel]:
        return max(1.0, self.strength * total), LabelModel(len(self.good), self.strength)

    def score(self, patterns: dict[tuple[int, ...], int]) -> float:
        """The log likelihood of the votes and of the priors' rows, which no round of ``step`` lowers."""
        weight, start = self._pseudo(sum(patterns.values()))
        out = 0.0
        for votes in sorted(patterns):
            g, j = math.log(self.prior), math.log(1 - self.prior)
            for x, y, v in zip(self.good, self.junk, votes, strict=True):
                g, j = g + math.log(x[v + 1]), j + math.log(y[v + 1])
            out += patterns[votes] * (max(g, j) + math.log1p(math.exp(-abs(g - j))))
        out += weight * (start.prior * math.log(self.prior) + (1 - start.prior) * math.log(1 - self.prior))
        for mine, first, share in ((self.good, start.good, start.prior), (self.junk, start.junk, 1 - start.prior)):
            out += weight * share * sum(a * math.log(b) for r, q in zip(first, mine, strict=True) for a, b in zip(r, q, strict=True))
        return out

    def step(self, patterns: dict[tuple[int, ...], int]) -> float:
        """One round over counted vote patterns: expected classes, then the likeliest parameters under priors and order; returns the largest change."""
        weight, start = self._pseudo(sum(patterns.values()))
        good = [[weight * start.prior * x for x in r] for r in start.good]
        junk = [[weight * (1 - start.prior) * x for x in r] for r in start.junk]
        total, kept = weight, weight * start.prior
        for votes in sorted(patterns):
            n = patterns[votes]
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, self.log_odds(votes)))))
            total, kept = total + n, kept + n * p
            for j, v in enumerate(votes):
                good[j][v + 1] += n * p
                junk[j][v + 1] += n * (1 - p)
        last = [self.prior, *(x for r in (*self.good, *self.junk) for x in r)]
        self.prior = kept / total
        # A vote is BAD or not, and if not, GOOD or not: two binomials, each with its order.
        for i, (g, k) in enumerate(zip(good, junk, strict=True)):
            bad = _pooled((g[0], sum(g)), (k[0], sum(k)))
            yes = _pooled((k[2], k[1] + k[2]), (g[2], g[1] + g[2]))
            self.good[i] = [bad[0], (1 - bad[0]) * (1 - yes[1]), (1 - bad[0]) * yes[1]]
            self.junk[i] = [bad[1], (1 - bad[1]) * (1 - yes[0]), (1 - bad[1]) * yes[0]]
        return max(abs(a - b) for a, b in zip(last, [self.prior, *(x for r in (*self.good, *self.junk) for x in r)], strict=True))

    def fit(self, patterns: dict[tuple[int, ...], int], rounds: int = 1000, least: float = 1e-8) -> LabelModel:
        for _ in range(rounds if patterns else 0):
            if self.step(patterns) < least:
                break
        return self

    def posterior(self, votes: list[Column]) -> Column:
        """P(good | votes) as a column."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for w, v in zip(self.weights(), votes, strict=True):
            odds = odds + F.when(v == BAD, w[0]).when(v == GOOD, w[2]).otherwise(w[1])
        return 1 / (1 + F.exp(-odds))


def fit(measured: DataFrame, prefix: str = "") -> LabelModel:
    """Fit on all rows: they are counted by vote pattern, at most 3 ** rules of them, and those counts are all that EM needs."""
    votes = rules(prefix)
    counted = measured.groupBy(*[v.alias(k) for k, v in votes.items()]).count().collect()
    return LabelModel(len(votes)).fit({tuple(r)[:-1]: r["count"] for r in counted})


def judge(docs: DataFrame, text: str = "text", prefix: str = "", least: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """docs (only the columns ``keep``, if given) with signals, ``posterior`` (double), ``base_failed`` and ``kept`` (boolean), each name after ``prefix``.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows. kept: not that, and the
    posterior probability of quality is at least ``least``. Null and empty texts have no word and fail. Rows are
    judged one by one with weights from all rows, so repeated rows get equal verdicts; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    measured = signals(docs, text, prefix)
    if keep is not None:
        measured = measured.select(*keep, *[prefix + k for k in [*BASE, *MORE]])
    measured = scratch.write(measured, "signals")
    model = fit(measured, prefix)
    n, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (
        measured.withColumn(f"{prefix}posterior", model.posterior(list(rules(prefix).values())))
        .withColumn(f"{prefix}base_failed", (n < 10) | (100 * again > 20 * n))
        .withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}posterior") >= least))
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that ``judge`` keeps, whatever its columns are called."""
    plain, name, back = numbered(docs)
    return back(judge(plain, name(text), "q_").where("q_kept"))
