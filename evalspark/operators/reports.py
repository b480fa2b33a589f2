"""Metric reports of a run: what a suite's ``report`` hook builds from samples and verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions import tokens
from evalspark.operators import coverage as cov
from evalspark.operators import metrics as met
from evalspark.operators import verdicts as ver
from evalspark.operators.joins import require_present, strict_lookup


@dataclass
class EvalReport:
    samples: DataFrame            # task_idx, sample_idx, input, output, raw_output
    task_counts: DataFrame | None = None
    task_metrics: DataFrame | None = None
    suite_metrics: DataFrame | None = None
    solved: DataFrame | None = None
    detail: DataFrame | None = None
    coverage: DataFrame | None = None
    diff_coverage: DataFrame | None = None
    defect: DataFrame | None = None


def sample_tokens(samples: DataFrame, keys: list[str], counter: met.TokenCounter | None = None) -> DataFrame:
    """Per sample the tokens of its prompt and of its raw output, counted where the texts are read:
    no text crosses a shuffle (with a ``counter``, what that one shuffles)."""
    if counter:
        on = [*keys, "sample_idx"]
        counts = [counter(samples, on, text).withColumnRenamed("n_tokens", name)
                  for text, name in (("input", "input_tokens"), ("raw_output", "output_tokens"))]
        return counts[0].join(counts[1], on)
    return samples.select(*keys, "sample_idx",
                          tokens.count_tokens(F.col("input")).cast("long").alias("input_tokens"),
                          tokens.count_tokens(F.col("raw_output")).cast("long").alias("output_tokens"))


def defect_report(suite, samples: DataFrame, verdicts: DataFrame | None = None, tasks: DataFrame | None = None,
                  coverage_lines: DataFrame | None = None, run_keys: list[str] | None = None,
                  require_verdicts: bool = False) -> EvalReport:
    """Labels of the answers against the tasks' ``defective``: all samples, and the first of each task."""
    if tasks is None:
        raise ValueError(f"suite {suite.name!r} is scored against the tasks' labels: pass tasks with task_idx and defective")
    labelled = met.label_answers(samples)
    labelled = strict_lookup(labelled, tasks.select("task_idx", "defective"), "task_idx", "sample refers to a task_idx missing from the task table")
    confusion = met.defect_confusion(met.defect_variants(labelled), by=[*(run_keys or []), "variant"])
    return EvalReport(samples=samples, defect=met.defect_scores(confusion))


def pass_report(suite, samples: DataFrame, verdicts: DataFrame | None = None, tasks: DataFrame | None = None,
                coverage_lines: DataFrame | None = None, run_keys: list[str] | None = None,
                require_verdicts: bool = False, counter: met.TokenCounter | None = None,
                counts_path: str | None = None) -> EvalReport:
    """pass@k, pass@t, solved counts and coverage from per-sample verdicts.

    One population for every metric: the samples that have a verdict.  With
    ``counts_path`` the per-task counts are written there and all tables of
    the report read them, instead of scoring the samples once per table.
    """
    if verdicts is None:
        raise ValueError(f"suite {suite.name!r} is scored from execution results: pass run_steps (facts) or verdicts "
                         f"with task_idx, sample_idx, {', '.join(suite.flags)}, timed_out")
    run_keys = list(run_keys or [])
    keys = run_keys + ["task_idx"]
    on = keys + ["sample_idx"]
    flags, k_grid, t_grid = list(suite.flags), list(suite.k_grid), list(suite.t_grid)
    judged = verdicts.withColumn("__judged", F.lit(True))
    scored = sample_tokens(samples, keys, counter).join(judged, on, "left" if require_verdicts else "inner")
    if require_verdicts:
        scored = require_present(scored, "__judged", "a selected sample has no verdict")
    # One grouped pass: verdict counts, tokens and coverage of the same rows.
    extra = [F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")]
    carry = []
    if suite.has_coverage:
        carry = ["line_coverage", "condition_coverage"]
        extra += [F.avg(c).alias(c) for c in carry]
    counts = met.with_total_tokens(ver.task_verdict_counts(scored, flags, task_keys=keys, extra_aggs=extra))
    if counts_path:
        counts.write.mode("overwrite").parquet(counts_path)
        counts = samples.sparkSession.read.schema(counts.schema).parquet(counts_path)
    task_metrics = met.task_metrics_long(counts, flags, k_grid, t_grid, keys)
    report = EvalReport(samples=samples, task_counts=counts, task_metrics=task_metrics,
                        suite_metrics=met.suite_pass_metrics(task_metrics, by=run_keys),
                        solved=met.suite_solved_counts(counts, flags, by=run_keys))
    if suite.has_coverage:
        report.coverage = counts.groupBy(*run_keys).agg(*[F.avg(c).alias(c) for c in carry])
        if coverage_lines is not None:
            if "sample_idx" not in coverage_lines.columns:
                raise ValueError("coverage_lines need sample_idx: lines of samples that are not scored must not count")
            lines = coverage_lines.join(samples.select(*on), on, "left_semi")
            report.diff_coverage = cov.diff_coverage(lines, counts.select(*keys), keys)
            counts = counts.join(report.diff_coverage, keys)          # on the keys that both are grouped by
            carry = [*carry, "diff_coverage"]
    report.detail = met.task_detail_report(counts, flags, k_grid, t_grid, keys, carry)
    return report
