"""Filter interaction audit: what five filters remove in each of their 120 orders.

A document's failures are a mask of five bits.  In an order, the document goes
at the first step whose filter it fails; the orders in which that is step s
with a given beginning are neighbours in lexicographic order, so each mask and
step covers intervals of Lehmer ranks.  Per part the counts of a mask are added
where such an interval begins and subtracted where it ends, and prefix sums
over the 120 ranks give what each step of each order removes.  The intervals
come from a rule and are one fixed table of at most ``32 * 5 * 60`` rows.

At scale: the texts are read once, map-only, and leave as a mask, a 256-bit
digest and a few numbers a row.  These meet the labels on ``doc_id``; copies
are counted per digest with partial sums, so that a text that a third of all
rows hold costs one row a task.  What follows has a bounded number of rows per
part.

Defined results: a null text is empty; a null language is the part of the
empty string; rows that repeat a ``doc_id`` count one by one, and none of them
is a later copy of another of the same id; a row without an id is never a
later copy and makes none; several labels of an id count as their largest
values, and null as 0; very long texts are taken whole; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm import common

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
SYMBOLS = "#$%&*|"

ORDERS = ["".join(p) for p in permutations(FILTERS)]         # by Lehmer rank


def lehmer_rank(order: str) -> int:
    """Place of an order among all, from 0: every letter weighs the smaller ones that follow it."""
    rank = 0
    for i, c in enumerate(order):
        rank = rank * (len(order) - i) + sum(d < c for d in order[i + 1:])
    return rank


def intervals(filters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """``mask, step, first, end``: the orders (ranks, end exclusive) in which a document of this mask goes at this step."""
    n = len(filters)
    found: dict[tuple[int, int], list[list[int]]] = {}
    for step in range(1, n + 1):
        for beginning in permutations(filters, step):
            rest = sorted(set(filters) - set(beginning))
            first, end = lehmer_rank("".join([*beginning, *rest])), lehmer_rank("".join([*beginning, *rest[::-1]])) + 1
            before = sum(1 << filters.index(c) for c in beginning[:-1])
            own = 1 << filters.index(beginning[-1])
            for mask in range(1 << n):
                if mask & own and not mask & before:
                    runs = found.setdefault((mask, step), [])
                    if runs and runs[-1][1] == first:
                        runs[-1][1] = end
                    else:
                        runs.append([first, end])
    return [(mask, step, a, b) for (mask, step), runs in sorted(found.items()) for a, b in runs]


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, digest`` per row: the mask without ``E``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = common.words_of(F.col("text"))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    n = F.size("words")
    upper = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    marked = F.length(F.translate("text", SYMBOLS, "")) < F.length("text")
    fails = [n < MIN_WORDS, 100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * n,
             100 * upper > MAX_UPPER_PERCENT * F.length("text"), marked]
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: rows per part and mask of failures, all filters included."""
    def label(name: str) -> Column:
        return F.max(F.coalesce((F.col(name) == 1).cast("int"), F.lit(0))).alias(name)

    per_id = labels.select("doc_id", "quality", "toxic").groupBy("doc_id").agg(label("quality"), label("toxic"))
    rows = failures(docs).join(per_id, "doc_id", "left").select(
        "doc_id", "part", "mask", "digest", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")])
    key = ("digest", "part", "mask", "quality", "toxic")
    per_row = rows.groupBy("doc_id", *key).agg(F.count(F.lit(1)).alias("n"))
    # Per digest and kind of row: all of them, those without an id, the smallest id and how many rows have it.
    kinds = per_row.groupBy(*key).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"))
    of_text = F.min("low").over(Window.partitionBy("digest"))       # as many rows as a text has parts and labels
    first = F.when(F.col("low") == F.col("least"), F.col("n_low")).otherwise(0) + F.col("nameless")
    split = kinds.withColumn("least", of_text).select("part", "mask", "quality", "toxic", F.explode(F.array(
        F.struct(F.lit(0).alias("copy"), first.alias("n")),
        F.struct(F.lit(1 << FILTERS.index("E")).alias("copy"), (F.col("n") - first).alias("n")))).alias("x"))
    n = F.col("x.n")
    return split.groupBy("part", (F.col("mask") + F.col("x.copy")).alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("quality")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def _interval_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(intervals(), "mask int, step int, first int, end int")


def audit(counts: DataFrame) -> DataFrame:
    """Per part, order and step the counts of the audit, from ``part, mask, n, good, toxic``."""
    counts = common.staged(counts, "mask-counts")
    sums = ("n", "good", "toxic")
    covered = counts.join(F.broadcast(_interval_table(counts.sparkSession)), "mask")
    # The difference arrays: plus where an interval begins, minus where it ends; zeros make every rank there.
    ends = covered.select("part", "step", F.inline(F.array(
        F.struct(F.col("first").alias("rank"), *[F.col(c) for c in sums]),
        F.struct(F.col("end").alias("rank"), *[(-F.col(c)).alias(c) for c in sums]))))
    zeros = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    zeros = zeros.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("rank"),
                         *[F.lit(0).cast("long").alias(c) for c in sums])
    steps = ends.unionByName(zeros).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in sums])
    along = Window.partitionBy("part", "step").orderBy("rank")
    steps = steps.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in sums]).filter(F.col("rank") < len(ORDERS))
    order = F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.col("rank") + 1)
    named = steps.withColumn("filter_order", order).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bits = F.explode(F.array(*[F.struct(F.lit(c).alias("filter"), F.lit(1 << i).alias("bit")) for i, c in enumerate(FILTERS)])).alias("x")
    failing = counts.select("part", "mask", "n", bits).groupBy("part", F.col("x.filter").alias("filter")).agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("x.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("mask") == F.col("x.bit"), F.col("n")).otherwise(0)).alias("unique_fails"))
    total = counts.groupBy("part").agg(F.sum("n").alias("total"))
    gone = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step"))
    by_filter = F.sum("n").over(Window.partitionBy("part", "filter"))
    full = named.withColumn("gone", gone).withColumn("shapley", by_filter).join(failing, ["part", "filter"]).join(total, "part")
    return full.select("part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), F.col("n").alias("removed"),
                       (F.col("failing") - F.col("n")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"),
                       F.col("toxic").alias("toxic_lost"), "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(mask_counts(docs, labels))
