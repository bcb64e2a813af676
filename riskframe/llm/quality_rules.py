"""Quality rules by weak supervision (DataFrame functions only).

Rules look at a document's counts and vote good (1), bad (-1) or abstain (0).  Nobody's vote is
final: expectation-maximisation over all documents estimates the share of good documents and, for
each rule, how often it is right on good and on bad ones, and a document is kept when its posterior
probability of being good reaches ``threshold``.

EM needs the votes only as counts per vote pattern: at most 3 ^ rules rows, aggregated by Spark over
all documents.  The estimates start from, and are drawn towards, the belief that good documents
seldom get a bad vote and bad ones often do, with a weight that is a fixed share of the documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.text import whole, words
from riskframe.session import cut_lineage

SYMBOLS = "[#*$%&|<>]"  # fixed value
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.5
ITERATIONS = 25
VOTES = (-1, 0, 1)
PRIOR_GOOD, PRIOR_SHARE = 0.8, 0.1
PRIOR_ON_GOOD = {-1: 0.02, 0: 0.28, 1: 0.70}
PRIOR_ON_BAD = {-1: 0.40, 0: 0.30, 1: 0.30}
POSITION_BITS = 31
# a word of letters with at most one mark behind it
PLAIN = r"(?<![^\x20\x09-\x0D])\p{L}[\p{L}\p{M}'\u2019-]*+[.,;:!?]?(?![^\x20\x09-\x0D])"

# rule -> (measure, bad from, good up to); measures are per word unless they are shares of lines
RULES: dict[str, tuple[str, float, float]] = {
    "symbols": ("n_symbols / n_words", 0.2, 0.05),
    "repeats": ("n_repeat_words / n_words", 0.4, 0.2),
    "lines": ("n_dup_lines / n_lines", 0.5, 0.05),
    "capitals": ("n_upper / word_chars", 0.5, 0.25),
    "shouting": ("n_exclaim / n_words", 0.2, 0.05),
    "tokens": ("n_lone_marks / n_words", 0.2, 0.05),
    "odd_words": ("n_odd_words / n_words", 0.4, 0.15),
}


def repeated_words(w: str) -> Column:
    """Words of array column ``w`` inside a 3-word window that occurs twice or more in it.

    Needs the columns ``__order`` of ``_window_order``.  Windows whose hash meets another's are
    compared as strings, so the count is exact; only those are.
    """
    bits = POSITION_BITS
    low = F.lit((1 << bits) - 1)
    near = F.filter("__order", lambda x, k: (
        (F.shiftright(x, bits) == F.shiftright(F.get("__order", k - 1), bits))
        | (F.shiftright(x, bits) == F.shiftright(F.get("__order", k + 1), bits))))
    return F.transform(near, lambda x: x.bitwiseAND(low).cast("int"))


def _covered(positions: Column) -> Column:
    """Words covered by the windows that start at the sorted ``positions``."""
    return F.aggregate(
        positions, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"])


def measures(rows: DataFrame) -> DataFrame:
    """Counts per row of (__row, __t): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, …"""
    t = rows.select("__row", "__t", words("__t").alias("__w"), F.filter(
        F.split("__t", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("__lines"))
    n = F.size("__w")
    # window hash above, position below: one sort of longs brings equal windows together
    order = F.when(n >= 3, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.shiftleft(F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)), POSITION_BITS)
        .bitwiseOR(i.cast("long"))))).otherwise(F.array().cast("array<bigint>"))
    joined = F.array_join("__w", "")

    def count(pattern: str, where: str) -> Column:
        return F.regexp_count(where, F.lit(pattern)).cast("long")

    t = t.select("__row", "__w", n.cast("long").alias("n_words"), joined.alias("__joined"),
                 F.size("__lines").cast("long").alias("n_lines"),
                 (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
                 (n - F.regexp_count("__t", F.lit(PLAIN))).cast("long").alias("n_odd_words"),
                 count(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])", "__t").alias("n_lone_marks"),
                 order.alias("__order"))
    t = t.withColumn("__near", repeated_words("__w"))
    pairs = F.array_sort(F.transform("__near", lambda i: F.struct(
        F.concat_ws(" ", F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)).alias("t"), i.alias("i"))))
    t = t.withColumn("__pairs", F.when(F.size("__near") > 0, pairs))
    same = F.filter("__pairs", lambda x, k: (x["t"] == F.get("__pairs", k - 1)["t"])
                    | (x["t"] == F.get("__pairs", k + 1)["t"]))
    starts = F.sort_array(F.transform(same, lambda x: x["i"]))
    return t.select(
        "__row", "n_words", F.length("__joined").cast("long").alias("word_chars"),
        count(SYMBOLS, "__joined").alias("n_symbols"), "n_dup_lines",
        F.when(F.size("__near") > 0, _covered(starts)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_lines", count(r"\p{Lu}", "__joined").alias("n_upper"), count("!", "__joined").alias("n_exclaim"),
        "n_lone_marks", "n_odd_words")


def votes(rules: dict[str, tuple[str, float, float]] = RULES) -> list[Column]:
    """One vote column per rule: -1 from its bad bound on, 1 up to its good bound, 0 between or unknown."""
    out = []
    for name, (measure, bad, good) in rules.items():
        top, _, bottom = measure.partition(" / ")
        value = F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))
        out.append(F.when(value >= bad, -1).when(value <= good, 1).otherwise(0).alias(f"vote_{name}"))
    return out


def _odds_terms(model: dict) -> list[dict[int, float]]:
    """Per rule, what each vote adds to the log odds of a good document."""
    return [{v: math.log(g[v] / b[v]) for v in VOTES} for g, b in zip(model["on_good"], model["on_bad"])]


def fit(patterns: Sequence[tuple[Sequence[int], int]], iterations: int = ITERATIONS) -> dict:
    """EM over (votes, count) pairs: {"good": share, "on_good": [...], "on_bad": [...]}.

    ``on_good[j][v]`` is the probability that rule j gives vote v to a good document, ``on_bad`` the
    same for bad ones: a rule's accuracies, with its readiness to abstain.
    """
    k = len(patterns[0][0]) if patterns else 0
    total = sum(c for _, c in patterns)
    weight = PRIOR_SHARE * total
    model = {"good": PRIOR_GOOD, "on_good": [dict(PRIOR_ON_GOOD) for _ in range(k)],
             "on_bad": [dict(PRIOR_ON_BAD) for _ in range(k)]}
    for _ in range(iterations if total else 0):
        terms, base = _odds_terms(model), math.log(model["good"] / (1 - model["good"]))
        on_good = [{v: weight * p for v, p in PRIOR_ON_GOOD.items()} for _ in range(k)]
        on_bad = [{v: weight * p for v, p in PRIOR_ON_BAD.items()} for _ in range(k)]
        n_good = 0.0
        for vote, count in patterns:
            p = count / (1 + math.exp(-base - sum(t[v] for t, v in zip(terms, vote))))
            n_good += p
            for j, v in enumerate(vote):
                on_good[j][v] += p
                on_bad[j][v] += count - p
        model = {"good": (n_good + weight * PRIOR_GOOD) / (total + weight),
                 "on_good": [{v: x / sum(t.values()) for v, x in t.items()} for t in on_good],
                 "on_bad": [{v: x / sum(t.values()) for v, x in t.items()} for t in on_bad]}
    return model


def posterior(model: dict, names: Sequence[str]) -> Column:
    """Probability of a good document given its vote columns."""
    odds = F.lit(math.log(model["good"] / (1 - model["good"])))
    for name, term in zip(names, _odds_terms(model)):
        odds = odds + F.when(F.col(name) > 0, term[1]).when(F.col(name) < 0, term[-1]).otherwise(term[0])
    return 1 / (1 + F.exp(-odds))


def _fit_on(counted: DataFrame, names: Sequence[str]) -> dict:
    # at most 3 ^ rules rows
    patterns = [(tuple(r[n] for n in names), r["n"])
                for r in counted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()]
    return fit(patterns or [((0,) * len(names), 0)])


def _decided(counted: DataFrame, model: dict, names: Sequence[str], threshold: float) -> DataFrame:
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    scored = counted.withColumns({"base_failed": failed, "posterior": posterior(model, names)})
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD,
          rules: dict[str, tuple[str, float, float]] = RULES) -> DataFrame:
    """One row per document: counts, base_failed, votes, posterior, kept.

    base_failed: under 50 words, or more than half of the words in repeated windows.  kept: not
    base_failed and posterior at or above ``threshold``.  NULL texts have no words and fail; repeated
    rows are judged one by one, alike; an empty table gives an empty result.
    """
    names = [f"vote_{r}" for r in rules]
    rows = docs.select(F.col(doc_id).cast("long").alias("__row"), whole(text).alias("__t"))
    counted = cut_lineage(measures(rows).select("*", *votes(rules)))
    return _decided(counted, _fit_on(counted, names), names, threshold).select(
        F.col("__row").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("posterior", 6).alias("posterior"), *names)


def keep(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD,
         rules: dict[str, tuple[str, float, float]] = RULES) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns.

    Counts and documents are written once, so that estimates and decision read the same counts.
    """
    names = [f"vote_{r}" for r in rules]
    rows = docs.select(F.struct(*docs.columns).alias("__row"), whole(text).alias("__t"))
    counted = cut_lineage(measures(rows).select("*", *votes(rules)))
    return _decided(counted, _fit_on(counted, names), names, threshold).where("kept").select("__row.*")
