"""Quality rules by weak supervision (DataFrame functions only).

Rules vote good (1) or bad (-1) or abstain (0). Expectation-maximisation over the counts of vote patterns, which cover
all documents and of which there are at most 3 to the number of rules, estimates how often each rule is right for good
and for bad documents; a document is kept if the posterior probability of being good is at least one half.

Nulls and ties: null and empty texts have no words and fail the base rules; equal rows are rows of their own; an empty
table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, written, words_of

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the be to of and that have with is in for it "
    "le la les de des et un une en que qui dans "
    "der die das und ist mit von den nicht ein eine zu "
    "el los las y del por con para una se no"
).split()


def features(docs: DataFrame, window: int = 5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what else the rules look at."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit("\t\x0b\x0c\r ")) != "")
    d = d.select("doc_id", "text", words_of(F.col("text"), SPACES).alias("words"), lines.alias("lines"))
    size = F.size("words")
    d = d.select(
        "doc_id", size.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_intersect("words", F.array(*map(F.lit, FUNCTION_WORDS)))).alias("n_function"),
        F.regexp_count("text", F.lit(r"[.!?][\x20\x09-\x0D\x22\x27)]*(?:\n|$)")).cast("long").alias("n_ended"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    size = F.size("hashes")
    n = F.greatest(size - (window - 1), F.lit(0))
    shifted = F.arrays_zip(*(F.slice("hashes", F.lit(i + 1), n).alias(f"w{i}") for i in range(window)))
    d = d.withColumn("grams", F.transform(shifted, lambda s: F.xxhash64(*(s[f"w{i}"] for i in range(window))))).drop("hashes")
    # Most texts repeat nothing; the others sort their windows with positions, so that equal ones meet.
    d = d.withColumn("grams", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.col("grams")).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("sorted", F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).drop("grams")
    twice = F.expr("filter(sorted, (x, i) -> (i > 0 AND sorted[i - 1].g = x.g) OR (i + 1 < size(sorted) AND sorted[i + 1].g = x.g))")
    d = d.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("sorted")
    more = F.expr(f"aggregate(zip_with(slice(at, 1, greatest(size(at) - 1, 0)), slice(at, 2, greatest(size(at) - 1, 0)), (a, b) -> least(b - a, {window})), 0L, (s, x) -> s + x)")
    return d.withColumn("n_repeat_words", F.when(F.size("at") > 0, more + window).otherwise(F.lit(0)).cast("long")).drop("at")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules by name, over the columns of features()."""
    n = F.greatest("n_words", F.lit(1)).cast("double")
    lines = F.greatest("n_lines", F.lit(1)).cast("double")
    mean, symbols, repeats, again, ended = F.col("word_chars") / n, F.col("n_symbols") / n, F.col("n_repeat_words") / n, F.col("n_dup_lines") / lines, F.col("n_ended") / lines
    return {
        "length": _vote(F.col("n_words") >= 30, F.col("n_words") < 10),
        "word_length": _vote((mean >= 3) & (mean <= 9), (mean < 2.5) | (mean > 12)),
        "symbols": _vote(symbols <= 0.03, symbols > 0.1),
        "repeats": _vote(repeats <= 0.1, repeats > 0.2),
        "lines": _vote(again <= 0.1, again > 0.3),
        "function_words": _vote(F.col("n_function") >= 2, (F.col("n_function") == 0) & (F.col("n_words") >= 10)),
        "endings": _vote(ended >= 0.5, (ended < 0.1) & (F.col("n_words") >= 10)),
    }


def fitted(patterns: Sequence[tuple[tuple[int, ...], int]], rounds: int = 50, rules: int | None = None) -> tuple[float, list[list[list[float]]]]:
    """Expectation-maximisation over (votes, count): the share of good documents, and for each rule, for bad and good
    documents, the probabilities of the votes -1, 0, 1. It begins from the belief that rules are right four times in five."""
    rules = len(patterns[0][0]) if rules is None else rules
    share, table = 0.7, [[[0.5, 0.3, 0.2], [0.1, 0.2, 0.7]] for _ in range(rules)]
    for _ in range(rounds):
        total, mass = [0.0, 0.0], [[[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]] for _ in range(rules)]
        for vote, count in patterns:
            p = posterior(vote, share, table)
            for k, q in ((0, (1 - p) * count), (1, p * count)):
                total[k] += q
                for r, v in enumerate(vote):
                    mass[r][k][v + 1] += q
        share = min(0.99, max(0.01, (total[1] + 1) / (sum(total) + 2)))
        table = [[[x / sum(row) for x in row] for row in rule] for rule in mass]
    return share, table


def posterior(vote: Sequence[int], share: float, table: list[list[list[float]]]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(rule[1][v + 1] / rule[0][v + 1]) for v, rule in zip(vote, table, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def quality(docs: DataFrame, rounds: int = 50) -> DataFrame:
    """features(), the rules' votes as p_good, base_failed and kept."""
    rules = votes()
    f = features(docs).withColumns(rules)
    f = written(f, "quality")
    patterns = [(tuple(r[:-1]), r[-1]) for r in sorted(map(tuple, f.groupBy(*rules).count().collect()))]  # at most 3 ** rules rows
    share, table = fitted(patterns, rounds, len(rules))
    odds = F.lit(math.log(share / (1 - share)))
    for name, (bad, good) in zip(rules, table, strict=True):
        odds = odds + F.element_at(F.array(*(F.lit(math.log(g / b)) for b, g in zip(bad, good, strict=True))), F.col(name) + 2)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    f = f.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return f.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
