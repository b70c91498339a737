"""Quality rules as weak supervision, with DataFrame functions only.

Rules look at counts of the whole text and vote good (1), bad (0) or abstain (null). Expectation-maximisation over
the table of vote patterns, which has at most 3 ** rules rows whatever the corpus holds, estimates how often each rule
says good of good and of bad documents and the share of good ones. The posterior is then a sum of log-odds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, text_or_empty

_WORD = r"[^\x20\x09-\x0D]+"
ITERATIONS, THRESHOLD, FEWEST_WORDS = 40, 0.5, 50


#: Distinct repeated windows of a text up to which places are found by looking each window up.
_FEW = 32


def features(docs: DataFrame) -> DataFrame:
    """Counts of each row's text, whole; null text has none.

    Three-word windows are told apart by 64-bit hashes: two different windows of one text fall together with a
    chance of about n * n / 2 ** 65. All work on a text stays within its row. Where windows repeat, their places
    come from a look-up in the few repeated ones or, with many, from a sort of (hash, place).
    """
    t = docs.select("doc_id", text_or_empty().alias("t")).withColumn("trimmed", F.expr(r"trim(BOTH ' \t\n\u000B\u000C\r' FROM t)"))
    t = t.select("doc_id", "t", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", r"[\x20\x09-\x0D]+")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"), F.regexp_replace("t", r"[^#*$%&|<>.!?\p{Lu}]+", "").alias("marks"))
    t = t.select("*", F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    t = t.select("*", F.expr("CASE WHEN size(h) >= 4 THEN transform(sequence(0, size(h) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2])) ELSE array() END").alias("g"))
    t = t.select("*", F.expr("CASE WHEN size(array_distinct(g)) < size(g) THEN sort_array(g) ELSE array() END").alias("s"))
    t = t.select("*", F.expr("array_distinct(filter(s, (x, k) -> k > 0 AND x = s[greatest(k - 1, 0)]))").alias("d"))
    t = t.select("*", F.expr(f"CASE WHEN size(d) > {_FEW} THEN array_sort(transform(g, (x, i) -> struct(x AS h, i AS i))) ELSE array() END").alias("q"))
    t = t.select("*", F.expr("""CASE WHEN size(d) = 0 THEN array()
        WHEN size(q) = 0 THEN filter(sequence(0, size(g) - 1), i -> array_contains(d, g[i]))
        ELSE transform(filter(q, (x, k) -> (k > 0 AND q[greatest(k - 1, 0)].h = x.h) OR (k + 1 < size(q) AND q[least(k + 1, size(q) - 1)].h = x.h)), x -> x.i) END""").alias("r"))
    left = lambda pattern: F.length(F.regexp_replace("marks", pattern, "")).cast("long")
    return t.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        left(r"[.!?\p{Lu}]+").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("r") == 0, F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(F.transform("r", lambda i: F.array(i, i + 1, i + 2)))))).cast("long").alias("n_repeat_words"),
        left(r"[^\p{Lu}]+").alias("n_upper"),
        left(r"[^.!?]+").alias("n_stops"),
    )


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("word_length", "word_chars BETWEEN 3.6 * n_words AND 6.0 * n_words", "word_chars < 3.0 * n_words OR word_chars > 6.6 * n_words"),
    Rule("symbols", "n_symbols <= 0.02 * n_words", "n_symbols > 0.2 * n_words"),
    Rule("symbol_density", "n_symbols <= 0.004 * word_chars", "n_symbols > 0.05 * word_chars"),
    Rule("repeated_lines", "n_dup_lines = 0 AND n_lines >= 2", "n_dup_lines > 0.3 * n_lines"),
    Rule("repeated_words", "n_repeat_words <= 0.1 * n_words", "n_repeat_words > 0.4 * n_words"),
    Rule("capitals", "n_upper <= 0.1 * word_chars", "n_upper > 0.3 * word_chars"),
    Rule("stops", "n_stops BETWEEN n_words / 60.0 AND n_words / 3.0", "n_stops < n_words / 200.0 OR n_stops > 0.6 * n_words"),
)


def votes(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    return {f"v_{r.name}": F.expr(f"CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 1 END") for r in rules}


@dataclass(frozen=True)
class Model:
    prior: float
    #: For each rule: the chance of a good vote, given that it votes, on good and on bad documents.
    rates: tuple[tuple[float, float], ...]


def fit(patterns: list[tuple[tuple[int | None, ...], int]], n_rules: int, iterations: int = ITERATIONS) -> Model:
    """Expectation-maximisation over (votes, documents); at the start a bad vote is rare on good documents."""
    prior, rates = 0.9, [(0.95, 0.4)] * n_rules
    for _ in range(iterations if patterns else 0):
        good = total = 0.0
        seen = [[1.9, 2.0, 0.8, 2.0] for _ in range(n_rules)]  # good votes and votes on good, on bad, with prior counts
        for vote, n in patterns:
            p = posterior(vote, Model(prior, tuple(rates)))
            good, total = good + n * p, total + n
            for row, v in zip(seen, vote):
                if v is not None:
                    row[0] += n * p * v
                    row[1] += n * p
                    row[2] += n * (1 - p) * v
                    row[3] += n * (1 - p)
        prior = min(0.99, max(0.01, (good + 0.9) / (total + 1)))
        rates = [(min(0.999, max(0.001, a / b)), min(0.999, max(0.001, c / d))) for a, b, c, d in seen]
    return Model(prior, tuple(rates))


def posterior(vote: tuple[int | None, ...], model: Model) -> float:
    odds = math.log(model.prior / (1 - model.prior))
    for v, (g, b) in zip(vote, model.rates):
        if v is not None:
            odds += math.log(g / b) if v else math.log((1 - g) / (1 - b))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def score(model: Model, rules: tuple[Rule, ...] = RULES) -> Column:
    """Posterior chance that a document is good, from its vote columns."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for r, (g, b) in zip(rules, model.rates):
        v = F.col(f"v_{r.name}")
        odds = odds + F.when(v == 1, math.log(g / b)).when(v == 0, math.log((1 - g) / (1 - b))).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, votes, base_failed, p_good and kept of each row.

    Base rules fail a text of under 50 words or with over half of its words in repeated three-word windows; such
    rows aren't kept whatever the votes, and the model is fitted to the rest. Null text counts as empty. Repeated rows are judged one by one, alike. An
    empty table gives no rows. Of the input only doc_id and text are looked at.
    """
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = cut(features(docs).withColumns(votes(rules)).withColumn("base_failed", failed))
    names = [f"v_{r.name}" for r in rules]
    seen = [(tuple(row[n] for n in names), row["n"]) for row in counted.filter("NOT base_failed").groupBy(*names).agg(F.count("*").alias("n")).collect()]  # at most 3 ** rules rows
    model = fit(sorted(seen, key=lambda x: str(x[0])), len(rules))
    return counted.withColumn("p_good", score(model, rules)).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows judged good, with their columns, whatever these are called.

    Null and empty texts fail the base rules and go. Of rows that repeat an id all stay if one is good. An empty table
    gives no rows.
    """
    good = judge(docs, rules, threshold).filter("kept").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    return rows.alias("a").join(good.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")), "left_semi").select("row.*")
