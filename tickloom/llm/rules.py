"""Quality rules as weak supervision. DataFrame functions only.

Each rule votes clean (1), junk (-1) or abstains (0). Rows of the corpus are counted by vote pattern: with eight rules at
most 3**8 patterns, however large the corpus. Expectation-maximisation over those counts estimates how often each rule
gives each vote on clean and on junk documents; a document's verdict is its posterior probability of being clean.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import SPACES, UPPER, WORD
from tickloom.session import written

VOTES = (-1, 0, 1)
WINDOW = 8
SYMBOLS = "#*$%&|<>"
# a whole word of letters, lower case after the first, or of letters and marks of a script without case (joiners of such
# scripts included), with at most one mark of punctuation behind it
MARKS = ".,;:،؛؟۔।。，、；：！？"
PLAIN = rf"(?<![^\x20\x09-\x0D])(?:\p{{L}}\p{{Ll}}*+|[\p{{Lo}}\p{{Lm}}\p{{M}}\x{{200C}}\x{{200D}}]++)[{MARKS}]?+(?![^\x20\x09-\x0D])"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id``, the five counts of the contract, and what the rules need besides.

    A null text counts as empty; an empty text has all counts zero. Repeated rows are counted each on its own.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("_words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    d = d.withColumn("_lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    d = d.withColumn("_hashes", F.transform("_words", lambda x: F.xxhash64(x)))
    # windows sorted by hash, so equal windows are neighbours; then the positions that occur twice, sorted again
    n = F.size("_words")
    windows = F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)),
        lambda i: F.struct(F.xxhash64(F.slice("_hashes", i, WINDOW)).alias("h"), i.alias("i")),
    )
    d = d.withColumn("_windows", F.when(n >= WINDOW, F.array_sort(windows)))
    like = lambda x, i: F.coalesce(F.get("_windows", i)["h"] == x["h"], F.lit(False))
    twice = F.filter("_windows", lambda x, i: like(x, i - 1) | like(x, i + 1))
    d = d.withColumn("_twice", F.array_sort(F.transform(twice, lambda x: x["i"])))
    new_words = F.transform("_twice", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_twice", i + 1) - x, F.lit(WINDOW))))
    length = F.char_length("text")
    return d.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.char_length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (length - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(new_words, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_hashes")).cast("long").alias("n_distinct"),
        (length - F.char_length(F.translate("text", UPPER, ""))).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit(PLAIN)).cast("long").alias("n_plain"),
    )


def _votes() -> dict[str, Column]:
    """The rules, with fixed thresholds on shares of a document's words or characters.

    A rule about one kind of junk says junk or nothing: that a text has no symbols is no sign that it is clean. Only
    ``prose`` says clean, of texts whose words are nearly all plain and varied.
    """
    n, chars = F.col("n_words"), F.col("word_chars")
    spread = F.least(n, F.lit(200))

    def junk(bad: Column) -> Column:
        return F.when(bad, -1).otherwise(0)

    plain = (100 * F.col("n_plain") >= 85 * n) & (100 * F.col("n_distinct") >= 30 * spread)
    return {
        "length": junk(n < 20),
        "repetition": junk(100 * F.col("n_repeat_words") > 30 * n),
        "symbols": junk(100 * F.col("n_symbols") > 4 * chars),
        "lines": junk(100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        "capitals": junk(100 * F.col("n_capitals") > 40 * chars),
        "word_length": junk((chars < 2 * n) | (chars > 15 * n)),
        "variety": junk((n >= 20) & (100 * F.col("n_distinct") < 20 * spread)),
        "prose": F.when((n > 0) & plain, 1).when(100 * F.col("n_plain") < 60 * n, -1).otherwise(0),
    }


def pattern_counts(voted: DataFrame, rules: list[str]) -> DataFrame:
    """Rows by vote pattern: at most 3 to the number of rules."""
    return voted.groupBy(*rules).agg(F.count("*").alias("n"))


def fit(patterns: list[Mapping[str, int]], rules: list[str], rounds: int = 200) -> tuple[float, dict[str, dict[int, float]]]:
    """Expectation-maximisation over pattern counts: the prior log odds of clean, and each vote's log likelihood ratio.

    Starts from the plain reading of the rules (junk if any rule says so) and keeps a small prior belief, so a rule that
    never votes, or a corpus of one kind, has finite ratios. Patterns come in one fixed order: reruns agree.
    """
    rows = sorted(([p[r] for r in rules], p["n"]) for p in patterns)
    belief = {True: {-1: 0.1, 0: 10.0, 1: 10.0}, False: {-1: 8.0, 0: 12.0, 1: 0.1}}
    post = [0.02 if -1 in votes else 0.98 for votes, _ in rows]
    prior, ratios = 0.0, {r: dict.fromkeys(VOTES, 0.0) for r in rules}
    for _ in range(rounds):
        clean = sum(p * n for p, (_, n) in zip(post, rows, strict=True))
        junk = sum((1 - p) * n for p, (_, n) in zip(post, rows, strict=True))
        prior = math.log((clean + 9) / (junk + 1))
        for k, rule in enumerate(rules):
            given = {c: dict(b) for c, b in belief.items()}
            for p, (votes, n) in zip(post, rows, strict=True):
                given[True][votes[k]] += p * n
                given[False][votes[k]] += (1 - p) * n
            sums = {c: sum(v.values()) for c, v in given.items()}
            ratios[rule] = {v: math.log(given[True][v] / sums[True]) - math.log(given[False][v] / sums[False]) for v in VOTES}
        new = [_posterior(prior + sum(ratios[r][v] for r, v in zip(rules, votes, strict=True))) for votes, _ in rows]
        moved = max((abs(a - b) for a, b in zip(new, post, strict=True)), default=0.0)
        post = new
        if moved < 1e-9:
            break
    return prior, ratios


def _posterior(log_odds: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, log_odds))))


def quality(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id``, the five counts, base_failed, kept, and the posterior that kept rests on.

    base_failed: under 20 words, or over 30 % of the words in 8-word windows that the text has twice. kept: not
    base_failed and posterior at least 0.5. Null and empty texts fail. Accuracies come from all rows; an empty table
    gives an empty result. Ties cannot occur between rows: equal counts have equal votes and equal posteriors.
    """
    rules = _votes()
    names = list(rules)
    voted = written(features(docs), "rule-counts").select("*", *(v.alias(f"vote_{r}") for r, v in rules.items()))
    votes = [f"vote_{r}" for r in names]
    prior, ratios = fit([row.asDict() for row in pattern_counts(voted, votes).collect()], votes)
    odds = F.lit(prior)
    for v in votes:
        odds = odds + F.when(F.col(v) == 1, ratios[v][1]).when(F.col(v) == -1, ratios[v][-1]).otherwise(ratios[v][0])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = voted.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return scored.select("doc_id", *COUNTS, "base_failed", (~failed & (F.col("posterior") >= 0.5)).alias("kept"), "posterior")
