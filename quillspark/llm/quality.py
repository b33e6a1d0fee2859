"""Quality rules: statistics of each text as DataFrame expressions, and decision lists learnt over them.

A decision list is a sequence of conjunctions of thresholds, each of which rejects what it covers. It is learnt from
labelled rows by sequential covering: a rule grows by the threshold with the best gain on two thirds of the rows, is
pruned on the other third, and is kept while it is precise there; the rows that it covers are then set aside.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import words_of

#: Fixed values of the contract: words in a window, least words, share of repeated words in percent, symbols.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
SYMBOLS = r"[#*$%&|<>]+"
#: Labelled rows that the list is learnt from (those with the smallest hashes of doc_id), rules and thresholds in it.
LEARN_ROWS, MOST_RULES, MOST_TESTS, CUTS = 6000, 12, 4, 24
#: Least share of bad rows, and least rows, that a rule covers on the rows kept for pruning.
PRECISION, LEAST_COVER = 0.95, 3
#: What rules may test, each a ratio that does not depend on the length of a text.
FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "mean_word", "distinct_share", "upper_share", "letter_share", "short_share")


def statistics(docs: DataFrame) -> DataFrame:
    """docs' doc_id with the statistics of its text: counts as longs, and FEATURES. Null texts count as empty; ratios over nothing are 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = lambda c: F.size(c).cast("long")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), words_of(text).alias("words"))
    d = d.select("doc_id", "text", "words", size("words").alias("n_words"), F.array_distinct("words").alias("kinds"), F.array_join("words", "").alias("solid"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    window = lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW)))
    grams = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words") - WINDOW, F.lit(0)).cast("int")), window)).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("grams", grams)
    d = d.withColumn("placed", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda i, j: F.coalesce(F.get("placed", i)["h"] == F.get("placed", j)["h"], F.lit(False))
    twice = F.filter("placed", lambda x, i: near(i, i - 1) | near(i, i + 1))
    d = d.withColumn("places", F.when(F.col("placed").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    step = F.transform("places", lambda p, i: F.least(F.coalesce(F.get("places", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    repeated = F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    kept = lambda p: F.length("text") - F.length(F.regexp_replace("text", p, ""))
    d = d.select(
        "doc_id", "n_words", F.length("solid").cast("long").alias("word_chars"), kept(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated.alias("n_repeat_words"),
        size("lines").alias("n_lines"), size("kinds").alias("n_kinds"), F.length(F.regexp_replace("solid", r"[^\p{Lu}]+", "")).alias("n_upper"), F.length(F.regexp_replace("solid", r"[^\p{L}]+", "")).alias("n_letters"),
        F.size(F.filter("words", lambda w: F.length(w) <= 3)).alias("n_short"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "n_words").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("mean_word"), share("n_kinds", "n_words").alias("distinct_share"), share("n_upper", "n_letters").alias("upper_share"),
        share("n_letters", "word_chars").alias("letter_share"), share("n_short", "n_words").alias("short_share"),
    )


def base_failed() -> Column:
    """The contract's verdict on the statistics."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    value: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.value if self.above else row[self.feature] <= self.value

    def column(self) -> Column:
        return F.col(self.feature) > self.value if self.above else F.col(self.feature) <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Test, ...]


def _covers(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(t.holds(r) for t in rule)]


def _bad(rows: list[dict]) -> int:
    return sum(r["bad"] for r in rows)


def _grow(rows: list[dict]) -> Rule:
    """Add the threshold with the best gain (FOIL) until all rows are bad. Thresholds lie between neighbouring values at even quantiles."""
    rule: Rule = ()
    while len(rule) < MOST_TESTS and 0 < _bad(rows) < len(rows):
        all_bad, share = _bad(rows), math.log2(_bad(rows) / len(rows))
        best, gain = None, 1e-9
        for feature in FEATURES:
            ordered = sorted((r[feature], r["bad"]) for r in rows)
            below = list(accumulate((bad for _, bad in ordered), initial=0))
            ends = [i for i in range(1, len(ordered)) if ordered[i - 1][0] < ordered[i][0]]
            for i in ends[:: max(1, len(ends) // CUTS)]:
                for above, bad, n in ((True, all_bad - below[i], len(rows) - i), (False, below[i], i)):
                    g = bad * (math.log2(bad / n) - share) if bad else 0.0
                    if g > gain:
                        best, gain = Test(feature, above, (ordered[i - 1][0] + ordered[i][0]) / 2), g
        if best is None:
            break
        rule, rows = (*rule, best), [r for r in rows if best.holds(r)]
    return rule


def _worth(rule: Rule, rows: list[dict]) -> float:
    inside = _covers(rule, rows)
    return (2 * _bad(inside) - len(inside)) / len(inside) if inside else -1.0


def learn(rows: list[dict]) -> list[Rule]:
    """A decision list from rows with FEATURES and `bad` (0 or 1), in the order in which the rules apply. Ties go to the earlier feature and value."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    rules: list[Rule] = []
    while len(rules) < MOST_RULES and _bad(grow):
        rule = _grow(grow)
        while len(rule) > 1 and _worth(rule[:-1], prune) >= _worth(rule, prune):
            rule = rule[:-1]
        inside = _covers(rule, prune)
        if not rule or len(inside) < LEAST_COVER or _bad(inside) < PRECISION * len(inside):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(t.holds(r) for t in rule)] for part in (grow, prune))
    return rules


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """The list learnt from LEARN_ROWS rows with a label `quality` (0: bad). Null labels teach nothing; no labels give an empty list."""
    marked = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("label_id"), "quality")
    few = marked.orderBy(F.xxhash64(F.lit("quality"), "label_id"), "label_id", "quality").limit(LEARN_ROWS)
    some = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("label_id"))
    stats = statistics(some.select("doc_id", "text")).join(F.broadcast(few), F.col("doc_id") == F.col("label_id"))
    # rows that fail the base are left out here and not by a filter, which would be pushed below the statistics and compute them word by word
    rows = stats.select("label_id", (1 - F.col("quality")).alias("bad"), base_failed().alias("failed"), *FEATURES).orderBy(F.xxhash64("label_id"), "label_id")
    return learn([r.asDict() for r in rows.collect() if not r["failed"]])


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a row, counted from 1, as one conditional expression; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(reduce(lambda a, b: a & b, (t.column() for t in rule)), F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per row of docs with its statistics, base_failed, kept, and the rule that rejects it (null: none).

    Null and empty texts fail the base; repeated rows are judged alike; an empty table gives no rows.
    """
    s = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return s.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
