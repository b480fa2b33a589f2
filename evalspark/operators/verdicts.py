"""Verdicts from run facts, and per-task verdict counts.

Running code is outside Spark: each execution step arrives as a fact row
(exit code, timeout flag, stdout lines).  The rules that turn facts into
``pass_*`` flags are grouped aggregations over those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.logs import parse_coverage_summary, tests_ok
from evalspark.operators.joins import require_present

# Step outcomes as small integers: aggregation buffers stay fixed-width, so
# the reducers run as hash aggregates (no sort of the fact rows).
OK, FAILED, COMPILE_FAIL, TIMEOUT = 0, 1, 2, 3


def step_status(exit_code: Column, timed_out: Column, stdout_lines: Column) -> Column:
    """Outcome of one test step.

    A killed step (timeout) and a non-zero exit leave no test log; an exit 0
    passes only when its last log line reports zero failing tests.
    """
    return status_from(exit_code, timed_out, tests_ok(stdout_lines))


def status_from(exit_code: Column, timed_out: Column, log_ok: Column) -> Column:
    return (F.when(F.coalesce(timed_out, F.lit(False)), F.lit(TIMEOUT))
            .when(exit_code != 0, F.lit(COMPILE_FAIL))
            .when(F.coalesce(log_ok, F.lit(False)), F.lit(OK))
            .otherwise(F.lit(FAILED)))


def _with_status(steps: DataFrame, lines: str) -> DataFrame:
    return steps.withColumn("__status", step_status(F.col("exit_code"), F.col("timed_out"), F.col(lines)))


def reduce_patch_verdict(steps: DataFrame, run_keys: list[str], syntax_ok: str | None = "syntax_ok",
                         lines: str = "stdout_lines") -> DataFrame:
    """complete / repair verdict per run (one sample's execution).

    Trigger steps run in ``step_no`` order and stop at the first failure,
    whose kind sets ``pass_compile`` / ``timed_out``.  Without a trigger
    failure the full-suite step decides: a failed exit or timeout fails
    ``pass_trigger``; a clean log passes ``pass_all``.  A syntax error fails
    every flag.  One grouped aggregation per run; later steps after the first
    failure are ignored.  (The harness always runs the full suite after
    passing triggers; a run whose facts lack the suite step keeps
    ``pass_trigger`` from its trigger steps and fails ``pass_all``.)
    """
    s = _with_status(steps, lines)
    trig = F.col("kind") == "trigger"
    failing = trig & (F.col("__status") != OK)
    aggs = [
        F.min_by("__status", F.when(failing, F.col("step_no"))).alias("first_fail"),
        F.max_by("__status", F.when(F.col("kind") == "suite", F.col("step_no"))).alias("suite"),
    ]
    aggs.append((F.bool_and(F.col(syntax_ok)) if syntax_ok else F.lit(True)).alias("syntax"))
    r = s.groupBy(*run_keys).agg(*aggs)
    ff, suite, syn = F.col("first_fail"), F.col("suite"), F.coalesce(F.col("syntax"), F.lit(True))
    bugg = ff.isNotNull() | F.coalesce(suite.isin(TIMEOUT, COMPILE_FAIL), F.lit(False))
    return r.select(
        *run_keys,
        syn.alias("pass_syntax"),
        (syn & ~F.coalesce(ff == COMPILE_FAIL, F.lit(False))).alias("pass_compile"),
        (syn & ~bugg).alias("pass_trigger"),
        (syn & ff.isNull() & F.coalesce(suite == OK, F.lit(False))).alias("pass_all"),
        (syn & F.coalesce(ff == TIMEOUT, F.lit(False))).alias("timed_out"),
    )


def reduce_testgen_verdict(steps: DataFrame, run_keys: list[str], syntax_ok: str | None = "syntax_ok",
                           lines: str = "stdout_lines", test_kind: str = "test",
                           coverage_kind: str = "coverage") -> DataFrame:
    """testgen verdict per run: one test step, then a coverage step.

    The test must pass; the coverage step must exit 0 without timeout; the
    line coverage must be non-zero.  Coverage values are 0 unless the
    coverage step ran and succeeded.
    """
    s = _with_status(steps, lines)
    is_test = F.col("kind") == test_kind
    is_cov = F.col("kind") == coverage_kind
    cov_ok = (F.col("exit_code") == 0) & ~F.coalesce(F.col("timed_out"), F.lit(False))
    summary = parse_coverage_summary(F.col(lines))
    cov_order = F.when(is_cov, F.col("step_no"))
    aggs = [
        F.min_by("__status", F.when(is_test, F.col("step_no"))).alias("test"),
        F.min_by(cov_ok, cov_order).alias("cov_ok"),
        F.min_by(summary["line_coverage"], cov_order).alias("cov_line"),
        F.min_by(summary["condition_coverage"], cov_order).alias("cov_cond"),
        (F.bool_and(F.col(syntax_ok)) if syntax_ok else F.lit(True)).alias("syntax"),
    ]
    r = s.groupBy(*run_keys).agg(*aggs)
    r = r.withColumn("cov", F.when(F.coalesce(F.col("cov_ok"), F.lit(False)), F.struct(
        F.col("cov_line").alias("line_coverage"), F.col("cov_cond").alias("condition_coverage"))))
    return _coverage_verdict(r, run_keys, F.col("test") == OK, F.col("test") == COMPILE_FAIL,
                             F.col("test") == TIMEOUT)


def _coverage_verdict(r: DataFrame, run_keys: list[str], test_passed: Column, compile_fail: Column,
                      timed_out: Column) -> DataFrame:
    syn = F.coalesce(F.col("syntax"), F.lit(True))
    passed = F.coalesce(test_passed, F.lit(False))
    line_cov = F.when(syn & passed, F.coalesce(F.col("cov.line_coverage"), F.lit(0.0))).otherwise(F.lit(0.0))
    cond_cov = F.when(syn & passed, F.coalesce(F.col("cov.condition_coverage"), F.lit(0.0))).otherwise(F.lit(0.0))
    cov_ran = F.col("cov").isNotNull()
    return r.select(
        *run_keys,
        syn.alias("pass_syntax"),
        (syn & ~F.coalesce(compile_fail, F.lit(False))).alias("pass_compile"),
        (syn & passed & cov_ran & (line_cov != 0)).alias("pass_trigger"),
        line_cov.alias("line_coverage"),
        cond_cov.alias("condition_coverage"),
        (syn & F.coalesce(timed_out, F.lit(False))).alias("timed_out"),
    )


def pair_twin_runs(facts: DataFrame, key: list[str], version: str = "version",
                   fields: tuple[str, ...] = ("exit_code", "timed_out", "last_line")) -> DataFrame:
    """One row per sample with ``fixed_*`` and ``buggy_*`` fields.

    Conditional aggregation in one grouped pass instead of a self-join.
    Fixed-width fields use plain ``max``; when a field is variable-width
    (a log line) each side's fields travel as one struct through
    ``collect_list`` (object hash aggregate; at most one row per side),
    so no sort of the fact rows is needed.
    """
    types = dict(facts.dtypes)
    fixed_width = all(types[f] in ("int", "bigint", "smallint", "tinyint", "boolean", "double", "float")
                      for f in fields)
    if fixed_width:
        aggs = [F.max(F.when(F.col(version) == side, F.col(f))).alias(f"{side}_{f}")
                for side in ("fixed", "buggy") for f in fields]
        return facts.groupBy(*key).agg(*aggs)
    aggs = [F.array_max(F.collect_list(F.when(F.col(version) == side, F.struct(*fields)))).alias(f"__{side}")
            for side in ("fixed", "buggy")]
    r = facts.groupBy(*key).agg(*aggs)
    return r.select(*key, *[F.col(f"__{side}.{f}").alias(f"{side}_{f}") for side in ("fixed", "buggy") for f in fields])


def reduce_issue_verdict(paired: DataFrame, key: list[str], syntax_ok: str | None = None,
                         coverage: str | None = "coverage") -> DataFrame:
    """Issue-revealing test verdict from a fixed/buggy pair.

    The test must fail on the buggy version (any failure, including compile
    errors and timeouts) and pass on the fixed one.  ``pass_compile`` and
    ``timed_out`` combine both sides.  Each side carries ``exit_code``,
    ``timed_out`` and either ``tests_ok`` or ``last_line``.  Coverage (a
    ``struct(line_coverage, condition_coverage)`` from the fixed side's
    coverage step, NULL when that step failed) must be non-zero.
    """
    def status(side):
        if f"{side}_tests_ok" in paired.columns:
            log_ok = F.col(f"{side}_tests_ok")
        else:
            log_ok = tests_ok(F.array(F.col(f"{side}_last_line")))
        return status_from(F.col(f"{side}_exit_code"), F.col(f"{side}_timed_out"), log_ok)

    fixed, buggy = status("fixed"), status("buggy")
    r = paired.withColumn("syntax", F.col(syntax_ok) if syntax_ok else F.lit(True))
    r = r.withColumn("cov", F.col(coverage) if coverage else F.lit(None).cast(
        "struct<line_coverage:double,condition_coverage:double>"))
    revealing = (fixed == OK) & (buggy != OK)
    compile_fail = (fixed == COMPILE_FAIL) | (buggy == COMPILE_FAIL)
    timed_out = (fixed == TIMEOUT) | (buggy == TIMEOUT)
    return _coverage_verdict(r, key, revealing, compile_fail, timed_out)


def issue_verdict_from_facts(steps: DataFrame, key: list[str], coverage: DataFrame | None = None) -> DataFrame:
    """Issue verdicts from run facts with ``version`` (fixed / buggy) and ``kind`` (test / coverage).

    The twin tests are the ``test`` steps; ``timed_out`` looks at them only.
    Coverage comes from the fixed version's ``coverage`` step if it ended
    well.  A sample without both test runs fails the job: an absent run is
    neither a pass nor a failure.
    """
    facts = steps.withColumn("tests_ok", tests_ok(F.col("stdout_lines")))
    paired = pair_twin_runs(facts.filter(F.col("kind") == "test"), key, fields=("exit_code", "timed_out", "tests_ok"))
    for side in ("fixed", "buggy"):
        paired = require_present(paired.withColumn("__ran", F.col(f"{side}_tests_ok")), "__ran",
                                 f"a sample has no test run on the {side} version")
    ended = (F.col("exit_code") == 0) & ~F.coalesce(F.col("timed_out"), F.lit(False))
    summary = parse_coverage_summary(F.col("stdout_lines"))
    cov_step = (F.col("kind") == "coverage") & (F.col("version") == "fixed") & ended
    rest = facts.groupBy(*key).agg(
        (F.bool_and("syntax_ok") if "syntax_ok" in facts.columns else F.lit(True)).alias("syntax_ok"),
        F.max_by(summary["line_coverage"], F.when(cov_step, F.col("step_no"))).alias("line"),
        F.max_by(summary["condition_coverage"], F.when(cov_step, F.col("step_no"))).alias("condition"))
    own = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("line_coverage"), F.col("condition").alias("condition_coverage")))
    rest = rest.select(*key, "syntax_ok", own.alias("coverage"))
    if coverage is not None:
        rest = rest.drop("coverage").join(coverage, key, "left")
    # A syntax error leaves no test runs; such samples fail without them.
    broken = rest.filter(~F.coalesce(F.col("syntax_ok"), F.lit(True)))
    whole = reduce_issue_verdict(paired.join(rest, key), key, syntax_ok="syntax_ok")
    failed = broken.join(paired.select(*key), key, "left_anti").select(
        *key, *[F.lit(False).alias(c) for c in ("pass_syntax", "pass_compile", "pass_trigger")],
        F.lit(0.0).alias("line_coverage"), F.lit(0.0).alias("condition_coverage"), F.lit(False).alias("timed_out"))
    return whole.unionByName(failed)


def count_col(flag: str) -> str:
    """Count column of a flag: ``pass_syntax`` -> ``c_syntax``."""
    return "c_" + flag.removeprefix("pass_")


def task_verdict_counts(verdicts: DataFrame, flags: list[str], task_keys: list[str] | None = None,
                        extra_aggs: list[Column] | None = None) -> DataFrame:
    """Per task: number of samples, number true per flag, timed-out samples."""
    task_keys = task_keys or ["task_idx"]
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(F.col(f)).alias(count_col(f)) for f in flags]
    aggs.append(F.count_if(F.col("timed_out")).alias("timed_out"))
    aggs += extra_aggs or []
    return verdicts.groupBy(*task_keys).agg(*aggs)


def compiler_error_histogram(steps: DataFrame, by: list[str] | None = None, stderr: str = "stderr") -> DataFrame:
    """Failed steps grouped by their first compiler-error line (triage table)."""
    from evalspark.functions.logs import first_compiler_error
    failed = steps.filter(F.col("exit_code") != 0)
    return (failed.withColumn("first_error", first_compiler_error(F.col(stderr)))
            .groupBy(*(by or []), "first_error").agg(F.count(F.lit(1)).alias("steps")))
