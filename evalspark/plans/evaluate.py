"""End-to-end evaluation of one run, as one Spark job graph.

Mirrors the reference's evaluate entry point: range filter (closed), first
``num_samples`` outputs, post-processing by suite and mode, a persisted
post-processed stage, token cost, verdicts and the metric reports.  Long
format throughout: one row per sample; the task table is looked up with a
size-checked broadcast; one grouped aggregation per task feeds every
metric.
"""

from __future__ import annotations

import inspect
import re
import time
from dataclasses import fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions import text
from evalspark.operators import samples as smp
from evalspark.operators.joins import require_present
from evalspark.operators.reports import EvalReport
from evalspark.session import scratch_path
from evalspark.suites import SuiteConfig, get_suite


def postprocess(samples: DataFrame, suite: SuiteConfig, mode: str, run_keys: list[str] | None = None) -> DataFrame:
    """Clean raw outputs by the suite's hook of the mode.

    ``samples`` carries ``output`` plus the task columns the suite needs
    (its complete-mode prefix column, ``function_signature``, prompts).
    Adds ``input`` (stripped prompt), replaces ``output`` by the cleaned
    text and keeps ``raw_output`` (output through the cleaned text).
    """
    pure = suite.cleaned(mode)
    return samples.select(
        *(run_keys or []), "task_idx", "sample_idx",
        text.py_strip(F.col(f"prompt_{mode}")).alias("input"),
        pure.alias("output"),
        text.reconstruct_raw_output(F.col("output"), pure).alias("raw_output"),
    )


def prepare_samples(spark: SparkSession, suite_name: str, tasks: DataFrame, generations: DataFrame, mode: str,
                    begin: int = -1, end: int = -1, num_samples: int | None = None,
                    stage_path: str | None = None, run_keys: list[str] | None = None) -> DataFrame:
    """Generations to post-processed samples.

    ``generations`` holds one array row per task (``outputs``) or one row per
    sample (``sample_idx, output``); the long form never gathers a task in one
    row.  ``run_keys`` (e.g. model and mode) keep several runs of one table
    apart.  The post-processed stage is written to ``stage_path`` (a folder
    under the shared checkpoint root by default) and read back: evaluation
    can be replayed from it and the lineage is cut there.
    """
    suite = get_suite(suite_name)
    keys = [*(run_keys or []), "task_idx"]
    gens = smp.filter_evaluate_range(generations, begin, end)
    if "outputs" in gens.columns:
        samples = smp.flatten_samples(smp.first_n_outputs(gens, num_samples).select(*keys, "outputs"))
    else:
        samples = smp.first_n_samples(gens.select(*keys, "sample_idx", "output"), num_samples, part=keys)
    need = sorted({c for c in (suite.complete_prefix_col, "function_signature", "prompt_complete", "prompt_chat", *suite.task_columns)
                   if c and c in tasks.columns})
    samples = smp.attach_task(samples, tasks, need)
    pp = postprocess(samples, suite, mode, run_keys)
    path = stage_path or scratch_path(spark, f"postprocessed-{suite_name}-{mode}")
    pp.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def score(samples: DataFrame, suite_name: str, verdicts: DataFrame | None = None,
          tasks: DataFrame | None = None, coverage_lines: DataFrame | None = None,
          run_keys: list[str] | None = None, require_verdicts: bool = False, counter=None,
          counts_path: str | None = None) -> EvalReport:
    """Metric reports from post-processed samples and per-sample verdicts.

    ``verdicts``: ``task_idx, sample_idx`` + the suite's flags + ``timed_out``
    (+ ``line_coverage``, ``condition_coverage`` for coverage suites), e.g.
    from :func:`verdicts_from_facts`.  Defect detection needs ``tasks``
    (``defective``) instead.

    One population for every metric: the samples in ``samples`` that have a
    verdict.  Verdicts, tokens and coverage lines of other samples do not
    count; with ``require_verdicts`` a sample without a verdict fails the job.

    ``run_keys`` (e.g. ``["model_id", "gen_mode"]``) score many runs in one
    job: every grouping carries them, the task level is ``run_keys +
    task_idx`` and the suite level is per run.  ``counter`` counts the tokens of pass@t
    in place of the built-in pre-tokenizer (:func:`evalspark.operators.pieces.counter`).
    ``counts_path`` stages the per-task counts there, so that several tables of
    the report read them instead of scoring the samples once each.
    """
    suite = get_suite(suite_name)
    more = {"counter": counter} if counter else {}       # report hooks without token metrics need not know it
    known = inspect.signature(suite.report).parameters
    if counts_path and ("counts_path" in known or any(x.kind is x.VAR_KEYWORD for x in known.values())):
        more["counts_path"] = counts_path
    return suite.report(suite, samples=samples, verdicts=verdicts, tasks=tasks, coverage_lines=coverage_lines,
                        run_keys=run_keys, require_verdicts=require_verdicts, **more)


def verdicts_from_facts(suite_name: str, run_steps: DataFrame, coverage: DataFrame | None = None,
                        keys: list[str] | None = None) -> DataFrame:
    """Per-sample verdicts from execution facts keyed by ``keys`` (``task_idx, sample_idx``).

    Twin suites pair the ``test`` steps of the fixed and the buggy version and
    read coverage from the fixed version's ``coverage`` step, unless
    ``coverage`` (keys + a ``coverage`` struct) brings it.
    """
    return get_suite(suite_name).verdict(run_steps, keys or ["task_idx", "sample_idx"], coverage)


def run_evaluate(spark: SparkSession, suite_name: str, tasks: DataFrame, generations: DataFrame, mode: str,
                 begin: int = -1, end: int = -1, num_samples: int | None = None,
                 run_steps: DataFrame | None = None, verdicts: DataFrame | None = None,
                 coverage_lines: DataFrame | None = None, stage_path: str | None = None,
                 run_keys: list[str] | None = None, counter=None) -> EvalReport:
    """Score the selected samples: closed task range, first ``num_samples`` outputs.

    Facts are cut to the selected samples before they are reduced; a selected
    sample without facts fails the job.
    """
    samples = prepare_samples(spark, suite_name, tasks, generations, mode, begin, end, num_samples, stage_path, run_keys)
    facts = verdicts is None and run_steps is not None
    if facts:
        on = [*(run_keys or []), "task_idx", "sample_idx"]
        verdicts = verdicts_from_facts(suite_name, run_steps.join(samples.select(*on), on, "left_semi"), keys=on)
    return score(samples, suite_name, verdicts=verdicts, tasks=tasks, coverage_lines=coverage_lines,
                 run_keys=run_keys, require_verdicts=facts, counter=counter)


def evaluate_files(spark: SparkSession, suite_name: str, tasks_path: str, generations_path: str, mode: str,
                   output_path: str, begin: int = -1, end: int = -1, num_samples: int | None = None,
                   run_steps_path: str | None = None, generations_multiline: bool = True,
                   run_keys: dict | None = None, coverage_lines_path: str | None = None,
                   model_id: str = "model", suffix: str = "default", counter=None) -> DataFrame:
    """File in, report out, like the original evaluate entry point.

    Reads the tasks file and the generations document, writes the
    post-processed stage beside the generations (``<name>-postprocess``),
    scores with the run facts when given, and writes the long metric table
    plus one results document per run under ``output_path``.  Coverage
    suites may add ``coverage_lines_path`` (Parquet: ``task_idx, sample_idx, class,
    file, number, hit`` per covered line) for ``diff_coverage``; ``counter``
    replaces the built-in token counter.  ``time_cost``
    and ``end_time`` are measured on the driver around the scoring jobs.

    The results document, with the detail of every task in index order, is
    ``log/<model_id>/<suite>/evaluation-<suffix>-<mode>.json`` under
    ``output_path``; what is returned has the same results without the detail.
    """
    from evalspark.sources import files

    run_keys = run_keys or {"bench_name": suite_name, "gen_mode": mode}
    tasks = files.load_tasks(spark, suite_name, tasks_path)
    gens = files.load_generations(spark, generations_path, multi_line=generations_multiline)
    stage = generations_path.rstrip("/").removesuffix(".json") + "-postprocess"
    samples = prepare_samples(spark, suite_name, tasks, gens, mode, begin, end, num_samples, stage_path=stage)
    start = time.time()
    verdicts = None
    if run_steps_path:
        on = ["task_idx", "sample_idx"]
        facts = files.load_run_steps(spark, run_steps_path).join(samples.select(*on), on, "left_semi")
        verdicts = verdicts_from_facts(suite_name, facts)
    lines = spark.read.parquet(coverage_lines_path) if coverage_lines_path else None
    rep = score(samples, suite_name, verdicts=verdicts, tasks=tasks, coverage_lines=lines, require_verdicts=bool(run_steps_path),
                counter=counter, counts_path=scratch_path(spark, "task-counts"))
    lit_keys = [F.lit(v).alias(k) for k, v in run_keys.items()]
    rep = replace(rep, **{f.name: frame.select(*lit_keys, "*") for f in fields(rep) if (frame := getattr(rep, f.name)) is not None})
    back = _write_report(rep, get_suite(suite_name), list(run_keys), output_path, start)
    detail = rep.detail.drop(*run_keys) if rep.detail is not None else None
    write_run_document(back, detail, output_path, model_id, suite_name, mode, suffix)
    return back


def evaluate_runs(spark: SparkSession, suite_name: str, tasks_path: str, generations_path: str, mode: str, output_path: str,
                  run_keys: tuple[str, ...] = ("model_id",), begin: int = -1, end: int = -1, num_samples: int | None = None,
                  run_steps_path: str | None = None, coverage_lines_path: str | None = None, suffix: str = "default",
                  counter=None) -> DataFrame:
    """Every run of a merged table in one job graph: :func:`evaluate_files` for a sweep.

    ``generations_path`` is Parquet as the merge of the log writes it, any
    folders by run included: ``run_keys``, ``task_idx`` (or ``task_id``, looked
    up in the tasks) and ``outputs``, or one row per sample with ``sample_idx,
    output``; a ``gen_mode`` or ``bench_name`` that is no run key prunes to the mode and the
    suite.  Facts and coverage lines carry the run keys, too.  All groupings
    hold the run keys, so a sweep costs the shuffles of one run, and a hot run
    is spread by its tasks.  Run keys are read as text (``007`` stays) and must
    not be null: such a row fails the job, as does a selected sample without
    facts.  A run without selected samples has no document.

    Writes what :func:`evaluate_files` writes, with
    ``log/<run keys>/<suite>/evaluation-<suffix>-<mode>.json`` per run (values
    URL-encoded, so no two runs share a document), and returns ``run_keys,
    document``.
    """
    from evalspark.schemas import RUN_STEPS
    from evalspark.sources import files

    keys = list(run_keys)
    on = [*keys, "task_idx", "sample_idx"]
    tasks = files.load_tasks(spark, suite_name, tasks_path)
    gens = _with_text_keys(spark, generations_path, keys)
    for column, value in (("gen_mode", mode), ("bench_name", suite_name)):
        if column in gens.columns and column not in keys:
            gens = gens.filter(F.col(column) == value)
    if "task_idx" not in gens.columns:
        gens = smp.attach_task(gens, tasks.select("task_id", "task_idx"), ["task_idx"], key="task_id")
    has_run = F.when(F.concat(*keys).isNotNull(), True)
    gens = require_present(gens.withColumn("__run", has_run), "__run", f"a generation has no value in {keys}")
    samples = prepare_samples(spark, suite_name, tasks, gens, mode, begin, end, num_samples, run_keys=keys)
    start = time.time()
    verdicts = None
    if run_steps_path:
        columns = [(k, T.StringType()) for k in keys]
        columns += [(f.name, f.dataType) for f in RUN_STEPS.fields if f.name in ("task_idx", "sample_idx", "version")]
        facts = files.load_run_steps(spark, run_steps_path, run_keys=columns)
        verdicts = verdicts_from_facts(suite_name, facts.join(samples.select(*on), on, "left_semi"), keys=on)
    lines = _with_text_keys(spark, coverage_lines_path, keys) if coverage_lines_path else None
    rep = score(samples, suite_name, verdicts=verdicts, tasks=tasks, coverage_lines=lines, run_keys=keys,
                require_verdicts=bool(run_steps_path), counter=counter, counts_path=scratch_path(spark, "task-counts"))
    back = _write_report(rep, get_suite(suite_name), keys, output_path, start)
    run = F.concat_ws("/", *[F.url_encode(F.col(k)) for k in keys])
    _write_documents(back, rep.detail, output_path, F.concat(F.lit("log/"), run, F.lit(f"/{suite_name}/evaluation-{suffix}-{mode}.json")), keys)
    return back


def _with_text_keys(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """A Parquet table with its run keys as text, also where they are folders with names like numbers."""
    found = spark.read.parquet(path)
    row = found.select(F.input_file_name().alias("file")).first()
    folders = [k for k in keys if row and f"/{k}=" in row["file"]]
    declared = T.StructType([T.StructField(f.name, T.StringType()) if f.name in folders else f for f in found.schema.fields])
    table = spark.read.schema(declared).parquet(path)
    return table.withColumns({k: F.col(k).cast("string") for k in keys if k not in folders})


def _write_report(rep: EvalReport, suite: SuiteConfig, keys: list[str], output_path: str, start: float) -> DataFrame:
    """Metric, detail and document tables by run; the documents (``keys, document``) as read back."""
    from evalspark.sources import sinks

    if rep.defect is not None:
        rep.defect.write.mode("overwrite").partitionBy(*keys).parquet(f"{output_path}/defect")
        end_time = time.time()
        cells = F.struct(*[c for c in rep.defect.columns if c not in ("variant", *keys)])
        doc = rep.defect.groupBy(*keys).agg(F.to_json(F.struct(
            *[F.max_by(cells, F.when(F.col("variant") == v, F.lit(1))).alias(f"results_{v}") for v in ("all", "one")],
            F.lit(end_time - start).alias("time_cost"), F.lit(end_time).alias("end_time"))).alias("document"))
    else:
        rep.suite_metrics.write.mode("overwrite").partitionBy(*keys).parquet(f"{output_path}/metrics")
        rep.detail.write.mode("overwrite").partitionBy(*keys).parquet(f"{output_path}/detail")
        end_time = time.time()
        scalars = rep.coverage
        if rep.diff_coverage is not None:
            mean = rep.diff_coverage.groupBy(*keys).agg(F.avg("diff_coverage").alias("diff_coverage"))
            scalars = scalars.join(mean, keys, "left") if scalars is not None else mean
        doc = sinks.results_document(rep.suite_metrics, rep.solved, keys, list(suite.flags),
                                     {"time_cost": end_time - start, "end_time": end_time}, scalars=scalars)
    doc.write.mode("overwrite").partitionBy(*keys).json(f"{output_path}/documents")
    return doc.sparkSession.read.schema(doc.schema).json(f"{output_path}/documents").select(*keys, "document")


def write_run_document(documents: DataFrame, detail: DataFrame | None, output_path: str, model_id: str, suite_name: str, mode: str,
                       suffix: str = "default") -> str:
    """The document of one run, with the tasks' ``detail`` if the suite has one; its path under ``output_path``."""
    name = f"log/{model_id}/{suite_name}/evaluation-{suffix}-{mode}.json"
    _write_documents(documents, detail, output_path, F.lit(name), [])
    return f"{output_path}/{name}"


def _write_documents(documents: DataFrame, detail: DataFrame | None, output_path: str, name: Column, keys: list[str]) -> None:
    """One file per row of ``documents``, at ``name`` (of the run ``keys``), with the detail of the run's tasks."""
    from evalspark.sources.documents import write_documents

    heads = documents.select(name.alias("document"), F.col("document").alias("head"))
    if detail is None:
        entries = heads.sparkSession.createDataFrame([], "document string, idx long, entry string")
    else:
        rest = []
        for f in detail.schema.fields:
            if f.dataType.typeName() == "struct":        # a flag: its metrics by their names in the document
                rest.append(F.struct(*[F.col(f"{f.name}.{x}").alias(re.sub(r"_at_(.)_", r"@\1-", x)) for x in f.dataType.names]).alias(f.name))
            elif f.name not in ("task_idx", *keys):
                rest.append(F.col(f.name))
        entries = detail.select(name.alias("document"), F.col("task_idx").alias("idx"), F.to_json(F.struct(*rest)).alias("entry"))
    write_documents(heads, entries, output_path)
