"""Mixing sources to target weights.

Tokens (words) are summed per source; the sources share ``budget`` times all
tokens by weight, no source above ``max_repeats`` times its own tokens, the
excess reshared among the others until none is above.  A source's repetition
rate is its target over its tokens, and each document is emitted
``floor(rate)`` times plus one Bernoulli copy with the fraction as its
probability, drawn from a hash of the seed and the document, so that reruns
agree and no state is kept.

Defined results: a null text has size 0; a null source is a source of its
own, last in the weight order; a source without words gets target 0; rows
that agree in id and text draw the same copies; extra columns pass through
:func:`mix_documents` untouched, whatever their names; an empty table gives
an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm import common

#: Weights dealt to the sources in code point order (null last), repeating.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_REPEATS = 2
SEED = "mix-1"
_DRAW_DIGITS = 13           # hex digits of the md5 that make up a draw


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    The rows are first summed per source (partial sums before the shuffle,
    so a hot source costs one row a task); the windows below run over one
    row per source.  Sources reach their cap in the order of cap / weight:
    with the first k of that order capped, the level is what is left of the
    budget over the remaining weight, and the right k is the first whose
    level stays below the next source's cap / weight.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    deal = F.array(*[F.lit(int(w)) for w in weights])
    weighed = per_source.withColumn("w", F.element_at(deal, ((rank - 1) % len(weights) + 1).cast("int")))
    capped = weighed.withColumn("cap", F.col("source_size") * max_repeats).withColumn("full_at", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    levelled = capped.withColumn("level", level)
    final = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    share = F.least(F.col("cap").cast("double"), F.coalesce(final, F.lit(float("inf"))) * F.col("w"))
    return levelled.select("source", "source_size", share.alias("target"))


def draw(key: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by seed, key and text."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    digits = F.conv(F.substring(F.md5(name), 1, _DRAW_DIGITS), 16, 10).cast("double")
    return digits / F.lit(float(16 ** _DRAW_DIGITS))


def copies_of(size: Column, source_size: Column, target: Column, u: Column, max_repeats: int = MAX_REPEATS) -> Column:
    rate = F.when(source_size > 0, F.least(target / source_size, F.lit(float(max_repeats)))).otherwise(F.lit(0.0))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET,
             max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text, source``): ``doc_id, size, source_size, target, copies, taken``."""
    slim = docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size"),
                       draw(F.col("doc_id"), F.col("text"), seed).alias("u"))
    targets = source_targets(docs.select("source", common.n_words(F.col("text")).alias("size")),
                             weights, budget, max_repeats).withColumnRenamed("source", "of_source")
    joined = slim.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
    planned = joined.withColumn("copies", copies_of(F.col("size"), F.col("source_size"), F.col("target"), F.col("u"), max_repeats))
    return planned.select("doc_id", "size", "source_size", "target", "copies",
                          (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET,
                  max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, with its columns.

    Rows without words belong to no token budget and are left out.
    """
    names = {n: common.fresh(docs, n) for n in ("of_source", "source_size", "target", "copy")}
    targets = source_targets(docs.select("source", common.n_words(F.col("text")).alias("size")),
                             weights, budget, max_repeats)
    targets = targets.select(F.col("source").alias(names["of_source"]), F.col("source_size").alias(names["source_size"]),
                             F.col("target").alias(names["target"]))
    joined = docs.join(targets, docs["source"].eqNullSafe(targets[names["of_source"]]))
    size = common.n_words(docs["text"])
    n = copies_of(size, F.col(names["source_size"]), F.col(names["target"]), draw(docs["doc_id"], docs["text"], seed), max_repeats)
    taken = joined.withColumn(names["copy"], F.when(size > 0, n).otherwise(F.lit(0)).cast("int"))
    taken = taken.filter(F.col(names["copy"]) > 0)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return taken.select(*columns, F.explode(F.sequence(F.lit(1), F.col(names["copy"]))).alias(names["copy"])).select(*columns)
