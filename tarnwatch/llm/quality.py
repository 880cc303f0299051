"""Quality rules with risk-controlled cutoffs (operator 7), DataFrame functions only.

A rule rejects a text whose metric lies above a cutoff. Labelled texts that pass the base rules are the
holdout. In each stratum every set of rules is one sequence of tests, from the mildest cutoffs of its rules on
(a rule whose ladder has ended stays at its last cutoff): with k of n good holdout texts rejected by any rule of
the set, cutoffs pass while the exact binomial tail P(X <= k | n, risk) is at most ``delta`` divided by the number
of (stratum, set) pairs, which is the Clopper-Pearson upper bound on the false rejection rate being at most
``risk``. The rejected texts of a sequence are nested, so its first failure ends it and its tests need no further
correction. Of what passes, the set and cutoffs that reject most bad holdout texts are taken, of equals the mildest
cutoffs, then the fewest rules, then the first in order. With probability 1 - delta no stratum loses more than
``RISK`` of its good texts to all its rules together.

Null texts have no words and fail the base rules. A null stratum is a stratum of its own; strata without
enough labelled texts have no cutoffs, so only the base rules hold there. Rows with a null id are judged but
calibrate nothing; a repeated id counts once for each of its rows. Tables without rows give none. Columns
beyond id, text and stratum are ignored. Windows of words are told apart by 64-bit hashes within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.common import SPACES, table

MIN_WORDS, MAX_REPEATED, SYMBOLS = 50, 50, "#*$%&|<>"
RISK, DELTA = 0.01, 0.05
#: Rules and their cutoffs, mildest first.
LADDERS = {
    "symbols": [2.0, 1.0, 0.5, 0.25, 0.1],
    "repeats": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2],
    "duplicate_lines": [0.8, 0.6, 0.4, 0.2],
    "long_words": [20.0, 16.0, 13.0, 11.0, 10.0],
    "short_words": [-1.5, -2.0, -2.5, -3.0],
}


def metrics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    clean = F.btrim(F.col("text"), F.lit(SPACES))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    words = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{stratum}`").cast("string").alias("stratum"),
                        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    words = words.withColumns({
        "words": F.when(F.length(clean) == 0, F.array().cast("array<string>")).otherwise(F.split(clean, r"[\x20\x09-\x0D]+")),
        "lines": lines,
        "word_chars": F.length(F.translate("text", SPACES, "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long")})
    window = lambda i: F.struct(
        F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))
    words = words.select(
        "doc_id", "stratum", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 3), window))).alias("sorted"))
    again = F.filter("sorted", lambda w, k: (F.get("sorted", k - 1)["h"] == w["h"]) | (F.get("sorted", k + 1)["h"] == w["h"]))
    words = words.withColumn("again", F.sort_array(F.transform(again, lambda w: w["i"]))).drop("sorted")
    covered = F.aggregate("again", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, i: F.struct(
        (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
    out = words.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("again")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def rule_values() -> dict[str, Column]:
    """The metric of each rule; null without words, which rejects nothing."""
    n = F.col("n_words")
    return {"symbols": F.try_divide("n_symbols", n), "repeats": F.try_divide("n_repeat_words", n),
            "duplicate_lines": F.try_divide("n_dup_lines", "n_lines"),
            "long_words": F.try_divide("word_chars", n), "short_words": -F.try_divide("word_chars", n)}


def log_factorial(n: Column) -> Column:
    """ln n! to about 1e-12: exact up to 20, Stirling's series beyond."""
    exact = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(21)])
    x = F.greatest(n, F.lit(20)).cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(n <= 20, F.get(exact, n.cast("int"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for k up to n * p, else 1 (such a k never passes a test). Terms under 1e-30 are left out."""
    lowest = F.greatest(F.lit(0), k - F.ceil(40 * F.sqrt(n * p * (1 - p)) + 200)).cast("long")
    term = lambda j: F.exp(log_factorial(n) - log_factorial(j) - log_factorial(n - j)
                           + j * math.log(p) + (n - j) * math.log1p(-p))
    tail = F.aggregate(F.sequence(lowest, k), F.lit(0.0), lambda acc, j: acc + term(j))
    return F.when(k > n * p, F.lit(1.0)).otherwise(tail)


def first_step(value: Column, ladder: list[float], longest: int) -> Column:
    """The step of a sequence from which on a rule rejects a text; ``longest`` if at none."""
    above = [F.coalesce((value > c).cast("int"), F.lit(0)) for c in ladder]
    exceeded = sum(above[1:], above[0])
    return F.when(exceeded == 0, longest).otherwise(len(ladder) - exceeded)


def cutoffs(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality",
            risk: float = RISK, delta: float = DELTA, ladders: dict[str, list[float]] = LADDERS) -> DataFrame:
    """stratum, rule, cutoff for the rules that are on in a stratum."""
    marked = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{quality}`").alias("good")).where("good in (0, 1)")
    values, rules, longest = rule_values(), list(ladders), max(map(len, ladders.values()))
    cells = (measured.where("not base_failed").join(marked, "doc_id")
             .groupBy("stratum", *[first_step(values[r], ladders[r], longest).alias(r) for r in rules])
             .agg(F.sum("good").cast("long").alias("good"), F.sum(1 - F.col("good")).cast("long").alias("bad")))
    cells = table(cells, "quality_counts")  # as many rows as the ladders have steps together, for each stratum
    sizes = cells.groupBy(F.col("stratum").alias("_stratum")).agg(F.sum("good").alias("n"))
    sets = [[r for i, r in enumerate(rules) if at >> i & 1] for at in range(1, 1 << len(rules))]
    each = F.explode(F.array(*[F.struct(F.lit(at + 1).alias("at"), F.lit(len(names)).alias("size"),
                                        F.array_min(F.array(*names)).alias("first")) for at, names in enumerate(sets)]))
    steps = cells.select("stratum", "good", "bad", each.alias("s")).where(F.col("s.first") < longest).select(
        "stratum", "good", "bad", "s.at", "s.size", F.explode(F.sequence(F.col("s.first"), F.lit(longest - 1))).alias("step"))
    tried = (steps.groupBy("stratum", "at", "size", "step").agg(F.sum("good").alias("k"), F.sum("bad").alias("hit")).where("hit > 0")
             .join(sizes, F.col("stratum").eqNullSafe(F.col("_stratum"))))
    tests = max(1, sizes.count() * len(sets))
    passing = tried.where((F.col("n") > 0) & (binomial_tail(F.col("k"), F.col("n"), risk) <= delta / tests))
    best = passing.groupBy("stratum").agg(F.max(F.struct("hit", -F.col("step"), -F.col("size"), -F.col("at"))).alias("best"))
    best = best.select("stratum", (-F.col("best.col2")).alias("step"), (-F.col("best.col4")).alias("at"))
    taken = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.when(F.shiftright("at", i) % 2 == 1, F.get(
            F.array(*map(F.lit, ladders[r])), F.least("step", F.lit(len(ladders[r]) - 1)))).alias("cutoff"))
        for i, r in enumerate(rules)])).alias("t")
    return best.select("stratum", taken).select("stratum", "t.*").where("cutoff is not null")


def judge(measured: DataFrame, limits: DataFrame, rules: tuple[str, ...] = tuple(LADDERS)) -> DataFrame:
    """``measured`` with kept: no base rule and no rule of the text's stratum rejects it."""
    values = rule_values()
    on = limits.groupBy(F.col("stratum").alias("_stratum")).agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_c_{r}") for r in rules])
    on = table(on, "quality_cutoffs")  # a row for each stratum, so its size is known to the planner
    rejected = F.lit(False)
    for r in rules:
        rejected = rejected | F.coalesce(values[r] > F.col(f"_c_{r}"), F.lit(False))
    joined = measured.join(on, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum", *[f"_c_{r}" for r in rules])


def filter_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang",
                 **options) -> DataFrame:
    """Measure every text once, calibrate on the labelled ones, judge all."""
    measured = table(metrics(docs, doc_id, text, stratum), "quality_metrics")
    return judge(measured, cutoffs(measured, labels, **options))
