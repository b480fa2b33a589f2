"""Quality rules as learned decision lists, native Spark expressions throughout.

Per document a row of statistics is computed by SQL functions; from labelled
statistics, sequential covering grows one conjunction of thresholds at a time
(best FOIL gain on the grow part), prunes its last conditions while the prune
part gains, and removes what it covers.  The ordered list becomes one
conditional expression; documents that no rule covers are kept.

The fit runs on a bounded sample of numbers (``labelled.SAMPLE_ROWS`` rows of
statistics, no texts); the statistics and the verdict run on every row and
whole text as column expressions.

Defined results: a null text has no words; a text without words fails the
base rule; repeated rows get the same verdict; only ``doc_id`` and ``text``
are read; without labels the list is empty and the base rule alone decides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm import common, labelled

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
DISTINCT_WINDOW = 100        # words in which distinct ones are counted
MIN_PRECISION = 0.95         # of a rule on the prune part
MIN_COVER = 3                # labelled documents that a rule must cover
THRESHOLDS = 24              # candidate thresholds per statistic (quantiles of the grow part), a parameter of the fit

#: What the rules may test: rates that do not drift with a text's length (distinct words are counted per
#: window of ``DISTINCT_WINDOW`` words, as their share of a whole text falls the longer it is).
STATISTICS = ("symbol_rate", "dup_line_rate", "repeat_rate", "mean_word", "distinct_rate", "upper_rate", "mark_rate",
              "digit_rate", "line_rate")


def _count_chars(text: Column, chars: str) -> Column:
    """Characters of ``chars`` (none special inside brackets but for those escaped) in the text."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _windows(words: Column, n: Column) -> Column:
    """A 64-bit hash for every 3-word window."""
    shifted = F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(n, F.lit(1))).alias("b"),
                           F.slice(words, 3, F.greatest(n, F.lit(1))).alias("c"))
    return F.transform(F.slice(shifted, 1, F.greatest(n - 2, F.lit(0))), lambda z: F.xxhash64(z))


def _sorted_windows(windows: Column) -> Column:
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeats(pairs: Column) -> Column:
    """Positions of the windows that have an equal neighbour in the sorted order, ascending."""
    marked = F.transform(pairs, lambda p, k: F.when((F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]), p["i"]))
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def statistics(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the counts of the base rule and the rates of :data:`STATISTICS`, per row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(*keep, text.alias("text"), common.words_of(F.col("text")).alias("words"))
    counted = split.select(
        *keep, "words", F.size("words").alias("n"),
        F.length(F.regexp_replace("text", common.SPACE, "")).cast("long").alias("word_chars"),
        _count_chars(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda s: s.rlike(common.WORD)).alias("lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        _count_chars(F.col("text"), "!?").alias("n_marks"),
        _count_chars(F.col("text"), "0123456789").alias("n_digits"))
    hashed = counted.select(
        "*", _windows(F.col("words"), F.col("n")).alias("windows"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.transform("words", lambda w, i: F.xxhash64(w, i - i % DISTINCT_WINDOW)))).alias("n_distinct"))
    # Most texts end at the distinct count; the others sort (hash, position), so the cost stays n log n.
    ordered = hashed.withColumn("pairs", F.when(F.size(F.array_distinct("windows")) < F.size("windows"),
                                                _sorted_windows(F.col("windows"))))
    repeated = ordered.withColumn("at", F.coalesce(_repeats(F.col("pairs")), F.array().cast("array<int>")))
    covered = F.aggregate(
        F.transform("at", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - i, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    done = repeated.select(
        *keep, F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        covered.alias("n_repeat_words"), "n_upper", "n_marks", "n_digits", "n_distinct", F.size("lines").alias("n_lines"))
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return common.settled(done.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("n_symbols") / n).alias("symbol_rate"), (F.col("n_dup_lines") / lines).alias("dup_line_rate"),
        (F.col("n_repeat_words") / n).alias("repeat_rate"), (chars / n).alias("mean_word"),
        (F.col("n_distinct") / n).alias("distinct_rate"), (F.col("n_upper") / chars).alias("upper_rate"),
        (F.col("n_marks") / n).alias("mark_rate"), (F.col("n_digits") / chars).alias("digit_rate"),
        (lines / n).alias("line_rate")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.name] > self.threshold if self.above else row[self.name] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.name)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _split(rows: list[dict], rule: Rule) -> tuple[list[dict], list[dict]]:
    inside = [all(c.holds(r) for c in rule) for r in rows]
    return [r for r, i in zip(rows, inside, strict=True) if i], [r for r, i in zip(rows, inside, strict=True) if not i]


def _candidates(rows: list[dict], thresholds: int) -> list[Condition]:
    out = []
    for name in STATISTICS:
        values = sorted({r[name] for r in rows})
        step = max(1, len(values) // thresholds)
        for low, high in zip(values[::step], values[step::step] or values[1:2], strict=False):
            out += [Condition(name, above, (low + high) / 2) for above in (True, False)]
    return out


def _gains(rows: list[dict], thresholds: int) -> list[tuple[float, Condition]]:
    """Conditions of positive FOIL gain on the rows, best first."""
    p0 = sum(r["junk"] for r in rows)
    out = []
    for c in _candidates(rows, thresholds) if 0 < p0 < len(rows) else ():
        inside = [r["junk"] for r in rows if c.holds(r)]
        p = sum(inside)
        if p >= MIN_COVER and (gain := p * (math.log2(p / len(inside)) - math.log2(p0 / len(rows)))) > 1e-9:
            out.append((gain, c))
    return sorted(out, key=lambda g: -g[0])


def _grow(rows: list[dict], first: Condition, thresholds: int) -> Rule:
    """From a first condition, add that of the largest gain until only junk is covered or none gains."""
    rule, rows = (first,), [r for r in rows if first.holds(r)]
    while gains := _gains(rows, thresholds):
        rule, rows = (*rule, gains[0][1]), [r for r in rows if gains[0][1].holds(r)]
    return rule


def _worth(rows: list[dict], rule: Rule) -> float:
    inside, _ = _split(rows, rule)
    p = sum(r["junk"] for r in inside)
    return (2 * p - len(inside)) / len(inside) if inside else -1.0


def _prune(rows: list[dict], rule: Rule) -> Rule:
    """The shortest beginning of the rule that is worth most on rows it was not grown on."""
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (_worth(rows, r), -len(r)), default=())


def _next_rule(grow: list[dict], prune: list[dict], thresholds: int) -> Rule | None:
    """Of the rules grown from each statistic's best first condition, pruned, the one that covers most junk
    among those precise enough on both parts."""
    firsts = {c.name: c for _, c in reversed(_gains(grow, thresholds))}
    best, most = None, 0
    for first in firsts.values():
        rule = _prune(prune, _grow(grow, first, thresholds))
        held, seen = _split(prune, rule)[0], _split(grow, rule)[0]
        p, q = sum(r["junk"] for r in held), sum(r["junk"] for r in seen)
        if p and p >= MIN_PRECISION * len(held) and q >= max(MIN_COVER, MIN_PRECISION * len(seen)) and p + q > most:
            best, most = rule, p + q
    return best


def learn_rules(rows: list[dict], thresholds: int = THRESHOLDS) -> list[Rule]:
    """Ordered rules for junk from rows of statistics with ``junk`` (0/1) and ``fold``.

    Rules are added as long as one is precise and covers labelled junk that the earlier ones leave."""
    grow, prune = [r for r in rows if r["fold"]], [r for r in rows if not r["fold"]]
    rules: list[Rule] = []
    while rule := _next_rule(grow, prune, thresholds):
        rules.append(rule)
        grow, prune = _split(grow, rule)[1], _split(prune, rule)[1]
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = labelled.SAMPLE_ROWS, thresholds: int = THRESHOLDS) -> list[Rule]:
    chosen = labelled.sample(docs, labels, "quality", rows)
    stats = statistics(chosen, keep=("label", "fold")).select((1 - F.col("label")).alias("junk"), "fold", *STATISTICS)
    return learn_rules([r.asDict() for r in stats.collect()], thresholds)


def rejects(rules: list[Rule]) -> Column:
    """Number of the first rule that covers a row, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        condition = F.lit(True)
        for c in rules[k - 1]:
            condition = condition & c.column()
        out = F.when(condition, F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts, ``base_failed``, ``rule`` (the rejecting one) and ``kept`` per row."""
    return statistics(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), rejects(rules).alias("rule"),
        (~base_failed() & rejects(rules).isNull()).alias("kept"))
