"""pass@k, pass@t, solved counts, token cost and defect-detection scores.

Everything works from one row per task (the verdict counts), so after the
single shuffle on the task key the metric grid is a narrow projection:
``explode`` of the k / t grid, no further shuffle until the tiny suite-level
aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.defect import DEFECT, ERROR, NO_DEFECT, classify_defect_answer, truncate_defect_answer
from evalspark.functions.estimators import pass_at_k
from evalspark.functions.tokens import count_tokens
from evalspark.operators.verdicts import count_col

#: ``(texts, keys, text column)`` to ``keys, n_tokens``: the tokens of all texts of each key.
TokenCounter = Callable[[DataFrame, list[str], str], DataFrame]


def _flags_long(counts: DataFrame, flags: list[str], keys: list[str], extra: list[str]) -> DataFrame:
    """(keys, extra, flag, c): one row per task and flag."""
    long = counts.select(*keys, *extra, F.explode(F.array(*[
        F.struct(F.lit(f).alias("flag"), F.col(count_col(f)).cast("long").alias("c")) for f in flags
    ])).alias("__f"))
    return long.select(*keys, *extra, "__f.flag", "__f.c")


def pass_at_k_task(counts: DataFrame, flags: list[str], k_grid: list[int],
                   keys: list[str] | None = None) -> DataFrame:
    """Per task, flag and k: the unbiased pass@k, only where ``total >= k``."""
    keys = keys or ["task_idx"]
    long = _flags_long(counts, flags, keys, ["total"])
    long = long.withColumn("param", F.explode(F.array(*[F.lit(float(k)) for k in k_grid])))
    long = long.filter(F.col("total") >= F.col("param"))
    n, c, k = F.col("total"), F.col("c"), F.col("param")
    return long.select(*keys, "flag", F.lit("pass@k").alias("metric"), k.alias("param"),
                       n.alias("n"), c.alias("c"), pass_at_k(n, c, k).alias("value"))


def pass_at_t_task(counts: DataFrame, flags: list[str], t_grid: list[int],
                   keys: list[str] | None = None) -> DataFrame:
    """Token-budget pass@t: real ``k = t / (total_tokens / n)``, only where
    ``total_tokens >= t`` (which keeps ``k <= n``)."""
    keys = keys or ["task_idx"]
    long = _flags_long(counts, flags, keys, ["total", "total_tokens"])
    long = long.withColumn("param", F.explode(F.array(*[F.lit(float(t)) for t in t_grid])))
    long = long.filter(F.col("total_tokens") >= F.col("param"))
    n, c = F.col("total"), F.col("c")
    k = F.col("param") / (F.col("total_tokens") / n)
    return long.select(*keys, "flag", F.lit("pass@t").alias("metric"), F.col("param"),
                       n.alias("n"), c.alias("c"), pass_at_k(n, c, k).alias("value"))


def suite_pass_metrics(task_metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro mean over the eligible tasks (ineligible tasks are absent, not 0)."""
    by = by or []
    return (task_metrics.groupBy(*by, "flag", "metric", "param")
            .agg(F.count(F.lit(1)).alias("n_tasks"), F.avg("value").alias("value")))


def suite_solved_counts(counts: DataFrame, flags: list[str], by: list[str] | None = None) -> DataFrame:
    """Tasks with at least one passing sample per flag; tasks; timed-out samples."""
    by = by or []
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(F.col(count_col(f)) > 0).alias("solved_" + f.removeprefix("pass_")) for f in flags]
    aggs.append(F.sum("timed_out").cast("long").alias("timed_out"))
    return counts.groupBy(*by).agg(*aggs)


def with_total_tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("total_tokens", F.col("input_tokens") * 0.5 + F.col("output_tokens"))


def token_cost(samples: DataFrame, prompts: DataFrame, key: str = "task_idx", raw_output: str = "raw_output",
               prompt: str = "prompt", counter: TokenCounter | None = None) -> DataFrame:
    """Per task: input counted once per sample, raw (not post-processed) output.

    The prompt is the same for every sample of a task, so it is tokenized once
    per task on the small side and multiplied by the sample count, instead of
    once per sample after a join.  ``counter`` takes the place of the built-in
    pre-tokenizer, e.g. :func:`evalspark.operators.pieces.counter`.
    """
    if counter:
        n_samples = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n_samples"))
        per_task = n_samples.join(counter(samples, [key], raw_output).withColumnRenamed("n_tokens", "output_tokens"), key)
        p = counter(prompts, [key], prompt).withColumnRenamed("n_tokens", "prompt_tokens")
        return _cost(per_task, p, key)
    per_task = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n_samples"),
                                        F.sum(count_tokens(F.col(raw_output))).cast("long").alias("output_tokens"))
    p = prompts.select(key, count_tokens(F.col(prompt)).cast("long").alias("prompt_tokens"))
    return _cost(per_task, p, key)


def _cost(per_task: DataFrame, prompt_tokens: DataFrame, key: str) -> DataFrame:
    j = per_task.join(prompt_tokens, key, "left")
    return with_total_tokens(j.select(key, "n_samples",
                                      (F.coalesce(F.col("prompt_tokens"), F.lit(0)) * F.col("n_samples"))
                                      .alias("input_tokens"), "output_tokens"))


def task_metrics_long(counts: DataFrame, flags: list[str], k_grid: list[int], t_grid: list[int],
                      keys: list[str] | None = None, carry: list[str] | None = None,
                      keep_ineligible: bool = False) -> DataFrame:
    """pass@k and pass@t rows together: one explode of the (metric, param)
    grid and a single estimator expression (cheap to plan, no union).
    ``carry`` columns of the counts row ride along unchanged."""
    keys = keys or ["task_idx"]
    carry = list(carry or [])
    extra = ["total"] + (["total_tokens"] if "total_tokens" in counts.columns else [])
    extra += [c for c in carry if c not in extra]
    long = _flags_long(counts, flags, keys, extra)
    n = F.col("total")
    grid = [F.struct(F.lit("pass@k").alias("metric"), F.lit(float(k)).alias("param"),
                     (n >= k).alias("ok"), F.lit(float(k)).alias("k")) for k in k_grid]
    if "total_tokens" in counts.columns:
        tt = F.col("total_tokens")
        grid += [F.struct(F.lit("pass@t").alias("metric"), F.lit(float(t)).alias("param"),
                          (tt >= t).alias("ok"), (F.lit(float(t)) / (tt / n)).alias("k")) for t in t_grid]
    g = long.withColumn("__g", F.explode(F.array(*grid)))
    value = pass_at_k(n, F.col("c"), F.col("__g.k"))
    if keep_ineligible:
        value = F.when(F.col("__g.ok"), value)
    else:
        g = g.filter(F.col("__g.ok"))
    return g.select(*keys, *carry, "flag", F.col("__g.metric").alias("metric"), F.col("__g.param").alias("param"),
                    n.alias("n"), F.col("c"), value.alias("value"))


def _metric_name(flag: str, metric: str, param: float, sep: str) -> str:
    return f"{flag}{sep}{metric.replace('@', '_at_')}_{int(param)}"


def task_detail_flat(counts: DataFrame, flags: list[str], k_grid: list[int], t_grid: list[int],
                     keys: list[str] | None = None, sep: str = "__", digits: int | None = None,
                     carry_cols: list[str] | None = None) -> DataFrame:
    """One row per task: counts, tokens, ``carry_cols`` (e.g. coverage) and every eligible
    metric as a leaf column ``flag__pass_at_k_5`` (NULL where the task is not eligible).

    The long metric rows are pivoted back with an explicit value list; the
    pivot groups by the task key the counts are already partitioned on.
    """
    keys = keys or ["task_idx"]
    has_tokens = "total_tokens" in counts.columns
    more = list(carry_cols or [])
    base = [*keys, "total", "timed_out"] + (["total_tokens"] if has_tokens else []) + more
    cnt = [count_col(f) for f in flags]
    carry = [c for c in base if c not in keys] + cnt
    long = task_metrics_long(counts.select(*base, *cnt), flags, k_grid, t_grid, keys, carry=carry,
                             keep_ineligible=True)
    names = []
    for f in flags:
        names += [_metric_name(f, "pass@k", k, sep) for k in k_grid]
        names += [_metric_name(f, "pass@t", t, sep) for t in (t_grid if has_tokens else [])]
    name = F.concat(F.col("flag"), F.lit(sep), F.regexp_replace("metric", "@", "_at_"), F.lit("_"),
                    F.col("param").cast("long").cast("string"))
    # Ineligible grid points stay as NULL values, so every task keeps its row.
    j = long.withColumn("__name", name).groupBy(*keys, *carry).pivot("__name", names).agg(F.first("value"))

    def rnd(c):
        return F.round(F.col(c), digits).alias(c) if digits is not None else F.col(c)

    out = [F.col(c) for c in keys + ["total", "timed_out"]] + ([rnd("total_tokens")] if has_tokens else []) + [rnd(c) for c in more]
    for f in flags:
        out.append(F.col(count_col(f)).alias(f"{f}{sep}count"))
        out += [rnd(nm) for nm in names if nm.startswith(f + sep)]
    return j.select(*out)


def task_detail_report(counts: DataFrame, flags: list[str], k_grid: list[int], t_grid: list[int],
                       keys: list[str] | None = None, carry_cols: list[str] | None = None) -> DataFrame:
    """One nested row per task: ``struct(count, pass_at_k_*, pass_at_t_*)`` per flag, and the ``carry_cols``."""
    keys = keys or ["task_idx"]
    flat = task_detail_flat(counts, flags, k_grid, t_grid, keys, carry_cols=carry_cols)
    base = [c for c in flat.columns if "__" not in c]
    per_flag = [F.struct(*[F.col(c).alias(c.split("__", 1)[1]) for c in flat.columns if c.startswith(f + "__")]).alias(f)
                for f in flags]
    return flat.select(*base, *per_flag)


def label_answers(answers: DataFrame, output: str = "output") -> DataFrame:
    """Truncate at the first marker, then classify the truncated text."""
    t = truncate_defect_answer(F.col(output))
    return answers.withColumn("truncated", t).withColumn("label", classify_defect_answer(F.col("truncated")))


def defect_confusion(labelled: DataFrame, by: list[str] | None = None, label: str = "label",
                     defective: str = "defective") -> DataFrame:
    """total, error, correct, tp, tn, fp, fn.  Error labels count in total and error only."""
    by = by or []
    lab, d = F.col(label), F.col(defective)
    tp = (lab == DEFECT) & d
    tn = (lab == NO_DEFECT) & ~d
    return labelled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(lab == ERROR).alias("error"),
        F.count_if(tp | tn).alias("correct"),
        F.count_if(tp).alias("tp"), F.count_if(tn).alias("tn"),
        F.count_if((lab == DEFECT) & ~d).alias("fp"),
        F.count_if((lab == NO_DEFECT) & d).alias("fn"),
    )


def defect_scores(confusion: DataFrame) -> DataFrame:
    """acc, acc_w_error, precision, recall, f1; a zero denominator gives NULL."""
    c = F.col
    precision = F.try_divide(c("tp").cast("double"), c("tp") + c("fp"))
    recall = F.try_divide(c("tp").cast("double"), c("tp") + c("fn"))
    return confusion.select(
        "*",
        F.try_divide(c("correct").cast("double"), c("total") - c("error")).alias("acc"),
        F.try_divide(c("correct").cast("double"), c("total")).alias("acc_w_error"),
        precision.alias("precision"), recall.alias("recall"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
    )


def defect_variants(labelled: DataFrame, sample_idx: str = "sample_idx") -> DataFrame:
    """The same rows tagged ``all`` and, for each task's first sample, ``one``.

    One pass: every row is emitted once per variant it belongs to, then a
    single grouped aggregate per variant follows.
    """
    variants = F.when(F.col(sample_idx) == 0, F.array(F.lit("all"), F.lit("one"))).otherwise(F.array(F.lit("all")))
    return labelled.withColumn("variant", F.explode(variants))
