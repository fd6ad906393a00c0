"""Quality rules by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import unclaimed, written

_BLANK = " \t\n\x0b\x0c\r"
_BLANKS = "[ \\t-\\r]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, computed once a row even where ``body`` names it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column) -> Column:
    """Words in windows of three words that occur twice or more: windows are sorted by their 64-bit hash, equal
    neighbours give the places, and each place adds the words up to the next one, three at most."""
    n = F.size(words)
    spot = lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i"))
    windows = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), spot)))

    def places(w: Column) -> Column:
        again = lambda x, i: ((i > 0) & (w[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < F.size(w) - 1) & (w[F.least(i + 1, F.size(w) - 1)]["h"] == x["h"]))
        return F.sort_array(F.transform(F.filter(w, again), lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda j: F.least(F.lit(3), p[j] - p[j - 1]))
        return F.when(F.size(p) == 0, F.lit(0)).when(F.size(p) == 1, F.lit(3)).otherwise(F.lit(3) + F.aggregate(steps, F.lit(0), lambda a, b: a + b))

    return F.coalesce(_let(windows, lambda w: _let(places(w), total)), F.lit(0))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures that the rules read, of the whole text; null counts as empty.

    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_marks (ASCII punctuation), n_stops
    (``.!?``).
    """
    value = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(value, F.lit(_BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANKS))
    lines = F.filter(F.split(value, "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    by_word = _let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), _covered(w).alias("r")))
    by_line = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    w, x, m = unclaimed(df.columns, "w", "l", "m")
    return (
        df.withColumns({w: by_word, x: by_line, m: F.regexp_replace(value, "[^!-/:-@\\[-`{-~]+", "")})
        .withColumns({
            "n_words": F.col(w)["n"].cast("long"), "word_chars": F.col(w)["c"].cast("long"), "n_repeat_words": F.col(w)["r"].cast("long"),
            "n_lines": F.col(x)["n"].cast("long"), "n_dup_lines": (F.col(x)["n"] - F.col(x)["d"]).cast("long"), "n_marks": F.length(m).cast("long"),
            "n_symbols": F.length(F.regexp_replace(m, "[^#*$%&|<>]+", "")).cast("long"), "n_stops": F.length(F.regexp_replace(m, "[^.!?]+", "")).cast("long"),
        })
        .drop(w, x, m)
    )


@dataclass(frozen=True)
class Rule:
    """Votes -1 where ``bad`` holds, else 1 where ``good`` holds, else abstains (0)."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.expr(f"CAST(CASE WHEN {self.bad} THEN -1 WHEN {self.good} THEN 1 ELSE 0 END AS TINYINT)")


RULES = (
    Rule("symbols", "20 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("marks", "10 * n_marks > word_chars", "100 * n_marks <= 6 * word_chars"),
    Rule("stops", "100 * n_stops < n_words OR 100 * n_stops > 60 * n_words", "100 * n_stops > 3 * n_words AND 100 * n_stops < 30 * n_words"),
    Rule("lines", "5 * n_dup_lines > n_lines", "20 * n_dup_lines <= n_lines"),
    Rule("repeats", "5 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words"),
    Rule("word length", "word_chars < 3 * n_words OR word_chars > 8 * n_words", "2 * word_chars > 7 * n_words AND 2 * word_chars < 13 * n_words"),
    Rule("length", "n_words < 20", "n_words >= 100"),
)

BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Weights:
    """What expectation-maximisation found: the share of good rows, and each rule's accuracy on good and on bad rows
    where it votes."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a row with these votes is good."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, a, b in zip(votes, self.good, self.bad, strict=True):
            odds += F.when(v == 1, F.lit(math.log(a / (1 - b)))).when(v == -1, F.lit(math.log((1 - a) / b))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))

    def probability(self, votes: tuple[int, ...]) -> float:
        """``posterior`` of one pattern."""
        odds = math.log(self.prior / (1 - self.prior))
        for v, a, b in zip(votes, self.good, self.bad, strict=True):
            odds += math.log(a / (1 - b)) if v == 1 else math.log((1 - a) / b) if v == -1 else 0.0
        return 1 / (1 + math.exp(-odds))


def learned(votes: DataFrame, columns: list[str], rounds: int = 20) -> Weights:
    """Expectation-maximisation over all rows.

    One aggregation counts the rows by their votes: at most 3 ** rules patterns, whatever the number of rows.  The
    rounds are arithmetic over these counts.  Five pseudo-votes at 0.8 on either side smooth each accuracy, so no rule
    becomes certain; an empty table keeps the starting values.
    """
    patterns = [(r["_n"], tuple(r[c] for c in columns)) for r in votes.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).collect()]
    return fitted(sorted(patterns, key=lambda p: p[1]), len(columns), rounds)


def fitted(patterns: list[tuple[int, tuple[int, ...]]], rules: int, rounds: int = 20) -> Weights:
    """``learned`` from (rows, votes) patterns."""
    now, total = Weights(0.7, (0.8,) * rules, (0.8,) * rules), sum(n for n, _ in patterns)
    for _ in range(rounds if total else 0):
        good = [n * now.probability(v) for n, v in patterns]
        bad = [n - g for (n, _), g in zip(patterns, good, strict=True)]

        def rate(i: int, side: int, mass: list[float]) -> float:
            hit = sum(m for m, (_, v) in zip(mass, patterns, strict=True) if v[i] == side)
            voted = sum(m for m, (_, v) in zip(mass, patterns, strict=True) if v[i])
            return (hit + 8) / (voted + 10)

        then = Weights(min(max(sum(good) / total, 0.05), 0.95), tuple(rate(i, 1, good) for i in range(rules)), tuple(rate(i, -1, bad) for i in range(rules)))
        moved = max(abs(a - b) for a, b in zip((then.prior, *then.good, *then.bad), (now.prior, *now.good, *now.bad), strict=True))
        now = then
        if moved < 1e-4:
            break
    return now


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Adds the measures, ``base_failed``, each rule's vote (array ``votes``), ``quality`` (posterior probability) and
    ``kept``: not base_failed, and quality at least ``threshold``.

    ``keep`` names the input columns that stay (all by default).  Measures and votes are written once to the shared
    folder, since both learning and judging read them.  Null and empty texts have no words and fail; repeated rows all
    stay, and each counts; an empty table gives an empty one.  Input columns called like the new ones are replaced; all others stay, whatever
    their names.
    """
    keep = df.columns if keep is None else keep
    votes = unclaimed(df.columns, *(f"v{i}" for i in range(len(rules))))
    new = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "n_stops", "base_failed", "votes", "quality", "kept", *votes]
    keep = [c for c in keep if c not in new]
    rows = measured(df.select(*dict.fromkeys([*keep, text])), text).withColumns({v: r.vote() for v, r in zip(votes, rules, strict=True)})
    rows = written(rows.select(*keep, *new[:8], *votes), "quality")
    weights = learned(rows.select(*votes), votes)
    return rows.select(
        *keep, *new[:8], F.expr(BASE_FAILED).alias("base_failed"), F.array(*votes).alias("votes"), weights.posterior([F.col(v) for v in votes]).alias("quality")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
