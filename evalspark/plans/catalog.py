"""One query per operator of the inventory, over the driver tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame.  Inputs are the
fixture adapters in :mod:`evalspark.fixtures`, read whole.  Doubles are
rounded to 9 digits so results compare across engines.  Column names match
the SQL in :mod:`evalspark.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark import fixtures as fx
from evalspark.functions import braces, defect, logs, text, tokens
from evalspark.operators import coverage as cov
from evalspark.operators import metrics as met
from evalspark.operators import pieces
from evalspark.operators import prompts, samples as smp, verdicts as ver
from evalspark.operators.joins import lookup_join
from evalspark.schemas import VERDICT_FLAGS
from evalspark.session import scratch_path
from evalspark.sources import files, sinks
from evalspark.streaming import partials as spart
from evalspark.streaming import stop as sstop
from evalspark.suites import K_GRID_COMPLETE, SuiteConfig, T_GRID, get_suite, register_suite

SEP = "\x1e"          # joins arrays into one comparable string
R = 9                 # rounding digits for doubles


def r9(c):
    return F.round(c, R)


# --- 2.1 sources and sinks -------------------------------------------------

def q_load_tasks(spark, sf):
    path = scratch_path(spark, "tasks")
    fx.v_tasks(spark, sf).write.parquet(path)
    t = files.load_tasks(spark, "defectdetection", path)
    return t.select("task_idx", "task_id", "prompt_complete", "prompt_chat", "project", "bug_id", "defective")


def _flat(generations: DataFrame) -> DataFrame:
    """Samples of records of ``PER_RECORD`` outputs."""
    flat = smp.flatten_samples(generations.select("task_idx", "ord", "outputs"))
    return flat.select("task_idx", (F.col("ord") * fx.PER_RECORD + F.col("sample_idx")).cast("int").alias("sample_idx"), "output")


def q_load_generations(spark, sf):
    """JSON array documents, read in ranges of bytes."""
    path = scratch_path(spark, "generations")
    sinks.write_generations_array(fx.v_generations(spark, sf), path)
    return _flat(files.load_generations(spark, path, range_bytes=1 << 20))


def _partials_records(spark, sf):
    p = fx.v_partials(spark, sf)
    return p.select(F.col("task_id").cast("string").alias("task_id"), "ord", "gen_mode",
                    F.array("output").alias("outputs"))


def _explode_partials(df):
    return df.select("task_id", "ord", "gen_mode", F.explode("outputs").alias("output"))


def q_load_partials(spark, sf):
    path = scratch_path(spark, "partials")
    _partials_records(spark, sf).write.json(path)
    return _explode_partials(files.load_partials(spark, path))


def q_load_coverage_xml(spark, sf):
    x = fx.v_cov_xml(spark, sf)
    return cov.coverage_lines_from_xml(x, "xml", keep=["l_orderkey", "l_linenumber"])


def _steps_facts(spark, sf):
    s = fx.v_steps(spark, sf)
    return s.select("user_id", "run_day", F.col("step_no").cast("int").alias("step_no"), "kind", "exit_code",
                    "timed_out", F.array("last_line").alias("stdout_lines"),
                    F.array().cast("array<string>").alias("stderr_lines"),
                    (F.col("value") >= 1.0).alias("syntax_ok"), "value")


def q_load_run_steps(spark, sf):
    path = scratch_path(spark, "run_steps")
    _steps_facts(spark, sf).write.parquet(path)
    st = files.load_run_steps(spark, path, run_keys=[("user_id", T.LongType()), ("run_day", T.DateType())])
    return st.select("user_id", F.col("run_day").cast("string").alias("run_day"), "step_no", "kind", "exit_code",
                     "timed_out", logs.line_from_end(F.col("stdout_lines"), 1).alias("last_line"))


def q_write_partials(spark, sf):
    path = scratch_path(spark, "partial-log")
    recs = _partials_records(spark, sf)
    # Two appends (as two generation workers would); nothing is overwritten.
    sinks.write_partials(recs.filter(F.col("gen_mode") == "assistant"), path)
    sinks.write_partials(recs.filter(F.col("gen_mode") != "assistant"), path)
    return _explode_partials(files.load_partials(spark, path))


def _merged(spark, sf, num_samples=5):
    p = fx.v_partials(spark, sf).withColumn("task_id", F.col("task_id").cast("string"))
    return smp.merge_partials(p, num_samples, keep_first=["gen_mode"], sep=SEP)


def q_write_merged(spark, sf):
    path = scratch_path(spark, "merged")
    m = _merged(spark, sf).withColumn("model_id", F.lit("m0")).withColumn("bench_name", F.lit("b0"))
    sinks.write_merged(m, path)
    back = spark.read.parquet(path)
    return back.select("task_id", "outputs", "gen_mode", F.col("n_outputs").cast("long").alias("n_outputs"))


def _postprocessed(spark, sf):
    """Complete-mode post-processing of V_samples against V_tasks."""
    s = fx.v_samples(spark, sf)
    t = fx.v_tasks(spark, sf).select("task_idx", "prompt_complete")
    j = smp.attach_task(s, t, ["prompt_complete"])
    pure = braces.stop_at_function(text.drop_prompt_prefix(F.col("output"), F.col("prompt_complete")))
    return j.select("task_idx", "sample_idx", text.py_strip(F.col("prompt_complete")).alias("input"),
                    pure.alias("pure"), "output").select(
        "task_idx", "sample_idx", "input", F.col("pure").alias("output"),
        text.reconstruct_raw_output(F.col("output"), F.col("pure")).alias("raw_output"))


def q_write_postprocessed(spark, sf):
    path = scratch_path(spark, "postprocessed")
    sinks.write_postprocessed(_postprocessed(spark, sf), path)
    return spark.read.parquet(path)


def _suite_metrics(spark, sf):
    v = fx.v_verdicts(spark, sf)
    counts = ver.task_verdict_counts(v, VERDICT_FLAGS)
    m = met.pass_at_k_task(counts, VERDICT_FLAGS, K_GRID_COMPLETE)
    return met.suite_pass_metrics(m)


def q_write_results(spark, sf):
    path = scratch_path(spark, "results")
    m = _suite_metrics(spark, sf).withColumn("model_id", F.lit("m0")).withColumn("bench_name", F.lit("complete"))
    sinks.write_results(m, path, ["model_id", "bench_name"], timing={"time_cost": 0.0})
    back = spark.read.parquet(f"{path}/metrics")
    return back.select("flag", "metric", "param", "n_tasks", r9(F.col("value")).alias("value"))


# --- 2.2 projections, filters, row generation ------------------------------

def q_select_prompt(spark, sf):
    both = smp.select_prompt(fx.v_tasks(spark, sf), "complete").withColumnRenamed("prompt", "complete_prompt")
    return smp.select_prompt(both, "chat").select("task_idx", "complete_prompt", F.col("prompt").alias("chat_prompt"))


def q_filter_generate_range(spark, sf):
    return smp.filter_generate_range(fx.v_samples(spark, sf), 2, 30).select("task_idx", "sample_idx", "doc_id")


def q_filter_evaluate_range(spark, sf):
    return smp.filter_evaluate_range(fx.v_samples(spark, sf), 2, 30).select("task_idx", "sample_idx", "doc_id")


def _requests(spark, sf):
    t = smp.select_prompt(fx.v_tasks(spark, sf), "complete")
    return smp.expand_requests(t, num_samples=20, batch_size=3).select("task_idx", "task_id", "copy_no", "prompt")


def q_expand_requests(spark, sf):
    return _requests(spark, sf)


def q_flatten_samples(spark, sf):
    return _flat(fx.v_generations(spark, sf))


def q_first_n_samples(spark, sf):
    return smp.first_n_samples(fx.v_samples(spark, sf), 3).select("task_idx", "sample_idx", "doc_id")


def q_flag_error_outputs(spark, sf):
    a = fx.v_answers(spark, sf)
    o = F.col("output")
    marked = (F.when(o.endswith(" $ERROR$"), F.lit("$ERROR$")).when(o.endswith(" ERROR"), F.lit("ERROR"))
              .otherwise(o))
    return smp.flag_error_outputs(a.withColumn("output", marked)).select("task_idx", "sample_idx", "is_error")


# --- 2.3 joins ---------------------------------------------------------------

def q_attach_task(spark, sf):
    s = fx.v_samples(spark, sf).select("task_idx", "sample_idx")
    return smp.attach_task(s, fx.v_tasks(spark, sf), ["project", "bug_id", "defective"])


def q_attach_prompt(spark, sf):
    s = fx.v_samples(spark, sf).select("task_idx", "sample_idx")
    return smp.attach_prompt(s, fx.v_tasks(spark, sf), "chat")


def q_pair_twin_runs(spark, sf):
    return ver.pair_twin_runs(fx.v_twin(spark, sf), ["sample_idx"])


# --- 2.4 aggregations ----------------------------------------------------------

def q_merge_partials(spark, sf):
    return _merged(spark, sf).select("task_id", "outputs", "gen_mode", F.col("n_outputs").cast("long").alias("n_outputs"))


def q_task_verdict_counts(spark, sf):
    return ver.task_verdict_counts(fx.v_verdicts(spark, sf), VERDICT_FLAGS)


def _rounded_task_metrics(m):
    return m.select("task_idx", "flag", "metric", "param", "n", "c", r9(F.col("value")).alias("value"))


def q_pass_at_k_task(spark, sf):
    counts = ver.task_verdict_counts(fx.v_verdicts(spark, sf), VERDICT_FLAGS)
    return _rounded_task_metrics(met.pass_at_k_task(counts, VERDICT_FLAGS, K_GRID_COMPLETE))


def _counts_with_tokens(spark, sf):
    """One aggregation per task: verdict counts and output tokens together."""
    scored = fx.scored_samples(spark, sf)
    counts = ver.task_verdict_counts(scored, VERDICT_FLAGS, extra_aggs=[
        F.sum(tokens.count_tokens(F.col("output"))).cast("long").alias("output_tokens")])
    prompts_ = smp.select_prompt(fx.v_tasks(spark, sf), "complete").select(
        "task_idx", tokens.count_tokens(F.col("prompt")).cast("long").alias("prompt_tokens"))
    j = lookup_join(counts, prompts_, "task_idx", "left")
    j = j.withColumn("input_tokens", F.coalesce(F.col("prompt_tokens"), F.lit(0)) * F.col("total"))
    return met.with_total_tokens(j)


def q_pass_at_t_task(spark, sf):
    return _rounded_task_metrics(met.pass_at_t_task(_counts_with_tokens(spark, sf), VERDICT_FLAGS, T_GRID))


def q_suite_pass_metrics(spark, sf):
    c = _counts_with_tokens(spark, sf)
    s = met.suite_pass_metrics(met.task_metrics_long(c, VERDICT_FLAGS, K_GRID_COMPLETE, T_GRID))
    return s.select("flag", "metric", "param", "n_tasks", r9(F.col("value")).alias("value"))


def q_suite_solved_counts(spark, sf):
    counts = ver.task_verdict_counts(fx.v_verdicts(spark, sf), VERDICT_FLAGS)
    return met.suite_solved_counts(counts, VERDICT_FLAGS)


def q_task_detail_report(spark, sf):
    return met.task_detail_flat(_counts_with_tokens(spark, sf), VERDICT_FLAGS, K_GRID_COMPLETE, T_GRID, digits=R)


def q_token_cost(spark, sf):
    s = fx.v_samples(spark, sf).select("task_idx", F.col("output").alias("raw_output"))
    p = smp.select_prompt(fx.v_tasks(spark, sf), "complete")
    tc = met.token_cost(s, p)
    return tc.select("task_idx", F.col("n_samples").cast("long").alias("n_samples"), "input_tokens",
                     "output_tokens", r9(F.col("total_tokens")).alias("total_tokens"))


def _run_keys_out(df):
    return df.withColumn("run_day", F.col("run_day").cast("string"))


def q_reduce_patch_verdict(spark, sf):
    v = ver.reduce_patch_verdict(_steps_facts(spark, sf), ["user_id", "run_day"])
    return _run_keys_out(v)


def _testgen_facts(spark, sf):
    s = _steps_facts(spark, sf)
    v = F.floor(F.col("value")).cast("long")
    cov_lines = F.array(
        F.concat(F.lit("Line coverage: "), (v % 100).cast("string"), F.lit(".5%")),
        F.concat(F.lit("Condition coverage: "), (v % 7).cast("string"), F.lit(".0%")))
    kind = F.when(F.col("step_no") == 1, F.lit("test")).when(F.col("step_no") == 2, F.lit("coverage")) \
        .otherwise(F.lit("other"))
    lines = F.when(F.col("step_no") == 2, cov_lines).otherwise(F.col("stdout_lines"))
    return s.withColumn("kind", kind).withColumn("stdout_lines", lines)


def q_reduce_testgen_verdict(spark, sf):
    v = ver.reduce_testgen_verdict(_testgen_facts(spark, sf), ["user_id", "run_day"])
    return _run_keys_out(v).select("user_id", "run_day", "pass_syntax", "pass_compile", "pass_trigger",
                                   r9(F.col("line_coverage")).alias("line_coverage"),
                                   r9(F.col("condition_coverage")).alias("condition_coverage"), "timed_out")


def q_reduce_issue_verdict(spark, sf):
    t = fx.v_twin(spark, sf)
    vfl = F.floor(F.col("value")).cast("long")
    # Facts per side: test outcome, and on the fixed side the coverage step.
    t = t.select("sample_idx", "version", "exit_code", "timed_out",
                 logs.tests_ok(F.array("last_line")).alias("tests_ok"),
                 (vfl % 9 != 0).alias("cov_ok"), (vfl % 20 / 20.0).alias("cov_line"),
                 (vfl % 7 / 7.0).alias("cov_cond"), (F.col("value") >= 1.0).alias("syntax_ok"))
    paired = ver.pair_twin_runs(t, ["sample_idx"],
                                fields=("exit_code", "timed_out", "tests_ok", "cov_ok", "cov_line", "cov_cond",
                                        "syntax_ok"))
    paired = paired.select(
        "*", F.when(F.col("fixed_cov_ok"), F.struct(F.col("fixed_cov_line").alias("line_coverage"),
                                                    F.col("fixed_cov_cond").alias("condition_coverage")))
        .alias("coverage"),
        F.coalesce(F.col("fixed_syntax_ok") & F.col("buggy_syntax_ok"),
                   F.coalesce(F.col("fixed_syntax_ok"), F.col("buggy_syntax_ok"))).alias("syntax_ok"))
    v = ver.reduce_issue_verdict(paired, ["sample_idx"], syntax_ok="syntax_ok")
    return v.select("sample_idx", "pass_syntax", "pass_compile", "pass_trigger",
                    r9(F.col("line_coverage")).alias("line_coverage"),
                    r9(F.col("condition_coverage")).alias("condition_coverage"), "timed_out")


def _labelled_answers(spark, sf):
    a = met.label_answers(fx.v_answers(spark, sf))
    t = fx.v_tasks(spark, sf).select("task_idx", "defective")
    return smp.attach_task(a, t, ["defective"])


def q_defect_confusion(spark, sf):
    return met.defect_confusion(_labelled_answers(spark, sf))


def _scores_rounded(df):
    return df.select(*[r9(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def q_defect_scores(spark, sf):
    return _scores_rounded(met.defect_scores(met.defect_confusion(_labelled_answers(spark, sf))))


def q_defect_variants(spark, sf):
    v = met.defect_variants(_labelled_answers(spark, sf))
    return _scores_rounded(met.defect_scores(met.defect_confusion(v, by=["variant"])))


def _level_rows(per_task, values):
    """Task rows plus the macro mean over tasks, from one pass (rollup)."""
    r = per_task.rollup("task_idx").agg(F.grouping_id().alias("__g"), *[F.avg(v).alias(v) for v in values])
    return r.select(F.when(F.col("__g") == 0, F.lit("task")).otherwise(F.lit("suite")).alias("level"),
                    "task_idx", *[r9(F.col(v)).alias(v) for v in values])


def q_coverage_means(spark, sf):
    per_sample = cov.sample_line_coverage(fx.v_cov(spark, sf), ["task_idx", "sample_key"])
    per_task, _ = cov.coverage_means(per_sample)
    return _level_rows(per_task, ["line_coverage", "condition_coverage"])


def _cov_tasks(spark, sf):
    return fx.table(spark, sf, "part").select((F.col("p_partkey") % 100).cast("int").alias("task_idx")).distinct()


def q_diff_coverage_incremental(spark, sf):
    """Lines of open and of finished statements are stored as bits, a batch each; the ratio is read from the bits."""
    store = cov.CoverageStore(spark, scratch_path(spark, "coverage-bits"), ["task_idx"])
    lines = fx.v_cov(spark, sf)
    for batch, part in (("open", F.col("cond_hit")), ("finished", ~F.col("cond_hit"))):
        store.add(batch, lines.filter(part))
    return _level_rows(store.diff_coverage(_cov_tasks(spark, sf)), ["diff_coverage"])


def q_diff_coverage(spark, sf):
    per_task = cov.diff_coverage(fx.v_cov(spark, sf), _cov_tasks(spark, sf))
    return _level_rows(per_task, ["diff_coverage"])


def q_target_classes(spark, sf):
    c = fx.v_classes(spark, sf)
    arr = cov.target_classes(F.split(F.col("names"), ",", -1))
    return c.select("p_partkey", F.array_join(arr, ",").alias("classes"))


# --- 2.5 sorts, sampling ---------------------------------------------------------

def q_order_by_task(spark, sf):
    return smp.order_by_task(_merged(spark, sf).select("task_id", F.col("n_outputs").cast("long").alias("n_outputs")))


def q_shard_requests(spark, sf):
    return smp.shard_requests(_requests(spark, sf), n_shards=8, seed=42).select("task_idx", "copy_no", "shard_id")


# --- 2.6 string and array functions ----------------------------------------

def q_strip_line_comments(spark, sf):
    s = fx.v_signatures(spark, sf)
    return s.select("page_id", text.strip_line_comments(F.col("sig")).alias("sig"))


def q_clean_signature(spark, sf):
    s = fx.v_signatures(spark, sf)
    return s.select("page_id", text.clean_signature(F.col("sig")).alias("c")).select("page_id", "c.pre", "c.sub")


def q_drop_prompt_prefix(spark, sf):
    s = fx.v_samples(spark, sf).select("task_idx", "sample_idx", "output")
    j = smp.attach_task(s, fx.v_tasks(spark, sf), ["prompt_complete"])
    return j.select("task_idx", "sample_idx",
                    text.drop_prompt_prefix(F.col("output"), F.col("prompt_complete")).alias("output"))


def q_stop_at_function(spark, sf):
    c = fx.v_code(spark, sf)
    return c.select("page_id", braces.stop_at_function(F.col("answer")).alias("function"))


def q_extract_chat_function(spark, sf):
    c = fx.v_code(spark, sf)
    cfg = get_suite("complete")
    return c.select("page_id", text.extract_chat_function(F.col("answer"), F.col("sig"), cfg.strip_signature)
                    .alias("function"))


STOP_TOKENS = ["\n", "public", "/**"]


def q_stop_at_stop_token(spark, sf):
    d = fx.v_docs(spark, sf)
    return d.select("doc_id", text.stop_at_stop_token(F.col("text"), STOP_TOKENS).alias("text"))


def q_truncate_defect_answer(spark, sf):
    a = fx.v_answers(spark, sf)
    return a.select("task_idx", "sample_idx", defect.truncate_defect_answer(F.col("output")).alias("truncated"))


def q_classify_defect_answer(spark, sf):
    a = met.label_answers(fx.v_answers(spark, sf))
    return a.select("task_idx", "sample_idx", "label")


def q_reconstruct_raw_output(spark, sf):
    c = fx.v_code(spark, sf)
    return c.select("page_id", text.reconstruct_raw_output(F.col("answer"), F.col("pure")).alias("raw_output"))


def q_splice_patch(spark, sf):
    s = fx.v_samples(spark, sf).select("task_idx", "sample_idx", "output", "n_chars")
    j = smp.attach_task(s, fx.v_tasks(spark, sf), ["prompt_complete"])
    start = (F.col("n_chars") % 7).cast("int")
    end = start + (F.col("n_chars") % 3).cast("int")
    return j.select("task_idx", "sample_idx",
                    text.splice_patch(F.col("output"), F.col("prompt_complete"), start, end).alias("spliced"))


def q_parse_test_log(spark, sf):
    s = _steps_facts(spark, sf)
    return _run_keys_out(s.select("user_id", "run_day", "step_no", logs.tests_ok(F.col("stdout_lines")).alias("tests_ok")))


def q_parse_coverage_summary(spark, sf):
    c = fx.v_cov_log(spark, sf)
    sm = logs.parse_coverage_summary(text.log_lines(F.col("log")))
    return c.select("o_orderkey", r9(sm["line_coverage"]).alias("line_coverage"),
                    r9(sm["condition_coverage"]).alias("condition_coverage"))


def q_first_compiler_error(spark, sf):
    e = fx.v_err_log(spark, sf)
    return e.select("event_id", F.when(F.col("failed"), logs.first_compiler_error(F.col("stderr"))).alias("first_error"))


MAX_PROMPT_TOKENS = 64


def q_truncate_prompt_tokens(spark, sf):
    text = F.col("text")
    d = fx.v_docs(spark, sf).select("doc_id", "text", tokens.tokens(text).alias("toks"), tokens.gaps(text).alias("gaps"))
    return d.select("doc_id", *[tokens.truncate_prompt(text, F.col("toks"), F.col("gaps"), MAX_PROMPT_TOKENS, m).alias(f"{m}_kept")
                                for m in ("complete", "chat")])


# Fixed parameters of the chat cleanup query.
CHAT_STOP = "###"
CHAT_SPECIAL = ["<s>", "</s>", "<unk>"]


def q_clean_chat_output(spark, sf):
    t = fx.v_turns(spark, sf)
    lead = F.when(F.col("role") == "system", F.lit("###")).when(F.col("role") == "assistant", F.lit("Assistant: ")) \
        .otherwise(F.lit(""))
    raw = F.concat(lead, F.lit("<s>"), F.col("text"), F.lit(" ###tail</s>"))
    return t.select("conv_id", "turn", text.clean_chat_output(raw, CHAT_STOP, CHAT_SPECIAL, True).alias("cleaned"))


def q_render_chat_prompt(spark, sf):
    return prompts.render_chat_prompt(fx.v_turns(spark, sf), prompts.ChatTemplate(system="SYS\n"))


def q_count_tokens(spark, sf):
    d = fx.v_docs(spark, sf)
    return d.select("doc_id", tokens.count_tokens(F.col("text")).cast("long").alias("n_tokens"))


def _piece_counter():
    import public_tokenizers      # vocabulary files; any byte-level BPE file's path will do
    return pieces.counter(public_tokenizers.path("byte_bpe_50k.json"))


def q_count_tokens_pieces(spark, sf):
    return _piece_counter()(fx.table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text")


def q_token_cost_pieces(spark, sf):
    s = fx.v_samples(spark, sf).select("task_idx", F.col("output").alias("raw_output"))
    tc = met.token_cost(s, smp.select_prompt(fx.v_tasks(spark, sf), "complete"), counter=_piece_counter())
    return tc.select("task_idx", F.col("n_samples").cast("long").alias("n_samples"), "input_tokens",
                     "output_tokens", r9(F.col("total_tokens")).alias("total_tokens"))


def q_pass_at_t_pieces(spark, sf):
    """pass@t under the budget of exact token counts."""
    counts = ver.task_verdict_counts(fx.scored_samples(spark, sf), VERDICT_FLAGS)
    counts = counts.join(q_token_cost_pieces(spark, sf).select("task_idx", "total_tokens"), "task_idx")
    return _rounded_task_metrics(met.pass_at_t_task(counts, VERDICT_FLAGS, T_GRID))


def q_syntax_screen(spark, sf):
    c = fx.v_code(spark, sf)
    return c.select("page_id", braces.syntax_screen(F.col("answer")).alias("structurally_ok"))


# --- 2.7 streaming ---------------------------------------------------------------

# Fixed parameter: the function signature the chat / complete stream rules wait for.
STREAM_SIGNATURE = "f()"


def _chunk_stream(spark, sf):
    """A log of chunks in three micro-batches, out of order, and its closing row."""
    path = scratch_path(spark, "chunks")
    chunks = fx.v_chunks(spark, sf)
    for part in (2, 0, 1):
        chunks.filter(F.col("seq") % 3 == part).write.mode("append").parquet(path)
    sstop.closing_row(spark, chunks.schema, "ts").write.mode("append").parquet(path)
    return (spark.readStream.schema(chunks.schema)
            .option("maxFilesPerTrigger", max(1, chunks.rdd.getNumPartitions())).parquet(path))


def _run_stop(spark, sf, suite, mode):
    out = scratch_path(spark, f"stop-{suite}-{mode}")
    tasks = fx.v_eval_tasks(spark, sf).withColumn("function_signature", F.lit(STREAM_SIGNATURE))
    stopped = sstop.stop_stream_for_suite(_chunk_stream(spark, sf), tasks, suite, mode, event_time="ts")
    sstop.run_available_now(stopped, out, out + "-checkpoint")
    return spark.read.schema(sstop.OUTPUT_SCHEMA).parquet(out)


def q_stream_stop_function(spark, sf):
    return _run_stop(spark, sf, "repair", "chat")


def q_stream_stop_marker(spark, sf):
    return _run_stop(spark, sf, "defectdetection", "chat")


def q_stream_stop_signature(spark, sf):
    return _run_stop(spark, sf, "complete", "complete")


def q_stream_stop_chat(spark, sf):
    return _run_stop(spark, sf, "complete", "chat")


def q_stream_collect_partials(spark, sf):
    """The merge of the partial log, carried on by three micro-batches, of which the last brings repeats."""
    path = scratch_path(spark, "partial-stream")
    p = fx.v_partials(spark, sf).withColumn("task_id", F.col("task_id").cast("string"))
    for part in (1, 0, 0):
        p.filter(F.col("ord") % 2 == part).write.mode("append").parquet(path)
    src = (spark.readStream.schema(p.schema).option("maxFilesPerTrigger", max(1, p.rdd.getNumPartitions())).parquet(path))
    state = scratch_path(spark, "partial-merge")
    merge = spart.IncrementalMerge(state, 5, ["task_id"], "ord")
    last = merge.run(src, state + "-checkpoint")
    m = merge.merged(spark, last, keep_first=["gen_mode"], sep=SEP)
    return m.select("task_id", "outputs", "gen_mode", F.col("n_outputs").cast("long").alias("n_outputs"))


# --- 2.8 extension surface ---------------------------------------------------------

def q_register_suite(spark, sf):
    """Two registered suites scored in one job over the same verdict table."""
    register_suite(SuiteConfig("complete_k3", "prompt_complete_with_comment", "signature", True,
                               tuple(VERDICT_FLAGS), (1, 3)))
    v = fx.v_verdicts(spark, sf)
    counts = ver.task_verdict_counts(v, VERDICT_FLAGS)
    parts = []
    for name in ("complete", "complete_k3"):
        cfg = get_suite(name)
        parts.append(met.pass_at_k_task(counts, list(cfg.flags), list(cfg.k_grid)).withColumn("suite", F.lit(name)))
    m = parts[0].unionByName(parts[1])
    s = met.suite_pass_metrics(m, by=["suite"])
    return s.select("suite", "flag", "metric", "param", "n_tasks", r9(F.col("value")).alias("value"))


# --- end to end --------------------------------------------------------------------

def q_evaluate_complete(spark, sf):
    """run_evaluate for the complete suite in complete mode: post-processing,
    persisted stage, token cost and the suite metric table."""
    from evalspark.plans.evaluate import run_evaluate
    rep = run_evaluate(spark, "complete", fx.v_eval_tasks(spark, sf), fx.v_samples(spark, sf), "complete",
                       verdicts=fx.v_verdicts(spark, sf))
    return rep.suite_metrics.select("flag", "metric", "param", "n_tasks", r9(F.col("value")).alias("value"))


def q_evaluate_complete_range(spark, sf):
    """As evaluate_complete, for a closed task range and the first outputs of each task."""
    from evalspark.plans.evaluate import run_evaluate
    rep = run_evaluate(spark, "complete", fx.v_eval_tasks(spark, sf), fx.v_samples(spark, sf), "complete",
                       begin=2, end=30, num_samples=7, verdicts=fx.v_verdicts(spark, sf))
    return rep.suite_metrics.select("flag", "metric", "param", "n_tasks", r9(F.col("value")).alias("value"))


def q_reorg_partials(spark, sf):
    """reorg_output_file on a log of two models without ``ord``, two whole texts per record."""
    from evalspark.plans.generation import reorg_output_file
    path, out = scratch_path(spark, "reorg-log"), scratch_path(spark, "reorg-merged")
    d = spark.read.parquet(f"{sf}/documents.parquet").filter(F.col("doc_id").isNotNull())
    log = d.select(
        F.concat(F.lit("task-"), F.col("source")).alias("task_id"), F.lit("complete").alias("gen_mode"),
        F.concat(F.lit("model-"), (F.col("doc_id") % 2).cast("string")).alias("model_id"),
        F.array(F.coalesce("text", F.lit("")), F.concat(F.lit("again "), F.coalesce("text", F.lit("")))).alias("outputs"),
        F.col("doc_id").cast("double").alias("tstamp"))
    log.write.json(path)
    merged = reorg_output_file(spark, path, out, num_samples=25)
    return merged.select("model_id", "task_id", F.md5(F.array_join("outputs", SEP)).alias("outputs_md5"),
                         F.size("outputs").cast("long").alias("n_outputs"))


def q_evaluate_defectdetection(spark, sf):
    """run_evaluate for defect detection in chat mode: truncation, labels,
    confusion and scores for all samples and for the first sample per task."""
    from evalspark.plans.evaluate import run_evaluate
    rep = run_evaluate(spark, "defectdetection", fx.v_tasks(spark, sf), fx.v_answers(spark, sf), "chat")
    return _scores_rounded(rep.defect)


def _report_rows(rep):
    """Suite metrics, and per task the counts and coverage of the detail, in one long table."""
    suite = rep.suite_metrics.select(F.lit("suite").alias("level"), F.lit(None).cast("int").alias("task_idx"), "flag", "metric", "param",
                                     F.col("n_tasks").cast("long").alias("n"), r9(F.col("value")).alias("value"))
    names = [c for c in ("line_coverage", "condition_coverage", "diff_coverage") if c in rep.detail.columns]
    cells = [F.struct(F.lit("pass_trigger").alias("flag"), F.lit("count").alias("metric"),
                      F.col("pass_trigger.count").cast("double").alias("value"))]
    cells += [F.struct(F.lit("coverage").alias("flag"), F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names]
    task = rep.detail.select("task_idx", "total", F.explode(F.array(*cells)).alias("c"))
    return suite.unionByName(task.select(F.lit("task").alias("level"), "task_idx", "c.flag", "c.metric", F.lit(0.0).alias("param"),
                                         F.col("total").alias("n"), r9(F.col("c.value")).alias("value")))


def q_evaluate_repair(spark, sf):
    """run_evaluate for the repair suite from run facts."""
    from evalspark.plans.evaluate import run_evaluate
    return _report_rows(run_evaluate(spark, "repair", fx.v_eval_tasks(spark, sf), fx.v_samples(spark, sf), "complete",
                                     run_steps=fx.v_patch_facts(spark, sf)))


def q_evaluate_complete_chat(spark, sf):
    """run_evaluate for the complete suite in chat mode: functions cut out of answers, from run facts."""
    from evalspark.plans.evaluate import run_evaluate
    return _report_rows(run_evaluate(spark, "complete", fx.v_eval_tasks(spark, sf), fx.v_chat_samples(spark, sf), "chat",
                                     run_steps=fx.v_patch_facts(spark, sf)))


def q_evaluate_testgen(spark, sf):
    """run_evaluate for the testgen suite from run facts and coverage lines, for a closed range of tasks and their first outputs."""
    from evalspark.plans.evaluate import run_evaluate
    return _report_rows(run_evaluate(spark, "testgen", fx.v_eval_tasks(spark, sf), fx.v_samples(spark, sf), "complete", begin=1, end=30,
                                     num_samples=9, run_steps=fx.v_test_facts(spark, sf), coverage_lines=fx.v_sample_lines(spark, sf)))


def q_evaluate_testgenissue(spark, sf):
    """run_evaluate for the testgenissue suite in chat mode from twin run facts and coverage lines."""
    from evalspark.plans.evaluate import run_evaluate
    return _report_rows(run_evaluate(spark, "testgenissue", fx.v_eval_tasks(spark, sf), fx.v_chat_samples(spark, sf), "chat",
                                     run_steps=fx.v_issue_facts(spark, sf), coverage_lines=fx.v_sample_lines(spark, sf)))


def q_evaluate_runs(spark, sf):
    """evaluate_runs: a merged table of two models (samples of even and of odd number), scored together from files of facts."""
    from evalspark.plans.evaluate import evaluate_runs
    root = scratch_path(spark, "runs")
    model = F.concat(F.lit("model-"), (F.col("sample_idx") % 2).cast("string")).alias("model_id")
    fx.v_eval_tasks(spark, sf).write.parquet(f"{root}/tasks")
    (fx.v_samples(spark, sf).select("task_idx", "sample_idx", "output", model, F.lit("complete").alias("gen_mode"))
     .write.partitionBy("model_id", "gen_mode").parquet(f"{root}/generations"))
    fx.v_patch_facts(spark, sf).select("*", model).write.parquet(f"{root}/facts")
    documents = evaluate_runs(spark, "repair", f"{root}/tasks", f"{root}/generations", "complete", f"{root}/out", run_steps_path=f"{root}/facts")
    total = documents.select("model_id", F.get_json_object("document", "$.total").cast("long").alias("run_total"))
    metrics = spark.read.parquet(f"{root}/out/metrics")
    return metrics.join(total, "model_id").select("model_id", "run_total", "flag", "metric", "param", "n_tasks", r9(F.col("value")).alias("value"))


# --- flagship ---------------------------------------------------------------------

def q_leaderboard(spark, sf):
    """V_verdicts -> counts -> pass@k -> macro means (the headline report)."""
    s = _suite_metrics(spark, sf)
    return s.select("flag", "metric", "param", "n_tasks", r9(F.col("value")).alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "load_tasks": q_load_tasks,
    "load_generations": q_load_generations,
    "load_partials": q_load_partials,
    "load_coverage_xml": q_load_coverage_xml,
    "load_run_steps": q_load_run_steps,
    "write_partials": q_write_partials,
    "write_merged": q_write_merged,
    "write_postprocessed": q_write_postprocessed,
    "write_results": q_write_results,
    "select_prompt": q_select_prompt,
    "filter_generate_range": q_filter_generate_range,
    "filter_evaluate_range": q_filter_evaluate_range,
    "expand_requests": q_expand_requests,
    "flatten_samples": q_flatten_samples,
    "first_n_samples": q_first_n_samples,
    "flag_error_outputs": q_flag_error_outputs,
    "attach_task": q_attach_task,
    "attach_prompt": q_attach_prompt,
    "pair_twin_runs": q_pair_twin_runs,
    "merge_partials": q_merge_partials,
    "task_verdict_counts": q_task_verdict_counts,
    "pass_at_k_task": q_pass_at_k_task,
    "pass_at_t_task": q_pass_at_t_task,
    "suite_pass_metrics": q_suite_pass_metrics,
    "suite_solved_counts": q_suite_solved_counts,
    "task_detail_report": q_task_detail_report,
    "token_cost": q_token_cost,
    "reduce_patch_verdict": q_reduce_patch_verdict,
    "reduce_testgen_verdict": q_reduce_testgen_verdict,
    "reduce_issue_verdict": q_reduce_issue_verdict,
    "defect_confusion": q_defect_confusion,
    "defect_scores": q_defect_scores,
    "defect_variants": q_defect_variants,
    "coverage_means": q_coverage_means,
    "diff_coverage": q_diff_coverage,
    "diff_coverage_incremental": q_diff_coverage_incremental,
    "target_classes": q_target_classes,
    "order_by_task": q_order_by_task,
    "shard_requests": q_shard_requests,
    "strip_line_comments": q_strip_line_comments,
    "clean_signature": q_clean_signature,
    "drop_prompt_prefix": q_drop_prompt_prefix,
    "stop_at_function": q_stop_at_function,
    "extract_chat_function": q_extract_chat_function,
    "stop_at_stop_token": q_stop_at_stop_token,
    "truncate_defect_answer": q_truncate_defect_answer,
    "classify_defect_answer": q_classify_defect_answer,
    "reconstruct_raw_output": q_reconstruct_raw_output,
    "splice_patch": q_splice_patch,
    "parse_test_log": q_parse_test_log,
    "parse_coverage_summary": q_parse_coverage_summary,
    "first_compiler_error": q_first_compiler_error,
    "truncate_prompt_tokens": q_truncate_prompt_tokens,
    "clean_chat_output": q_clean_chat_output,
    "render_chat_prompt": q_render_chat_prompt,
    "count_tokens": q_count_tokens,
    "count_tokens_pieces": q_count_tokens_pieces,
    "token_cost_pieces": q_token_cost_pieces,
    "pass_at_t_pieces": q_pass_at_t_pieces,
    "syntax_screen": q_syntax_screen,
    "stream_stop_function": q_stream_stop_function,
    "stream_stop_marker": q_stream_stop_marker,
    "stream_stop_signature": q_stream_stop_signature,
    "stream_stop_chat": q_stream_stop_chat,
    "stream_collect_partials": q_stream_collect_partials,
    "register_suite": q_register_suite,
    "evaluate_complete": q_evaluate_complete,
    "evaluate_complete_range": q_evaluate_complete_range,
    "reorg_partials": q_reorg_partials,
    "evaluate_defectdetection": q_evaluate_defectdetection,
    "evaluate_repair": q_evaluate_repair,
    "evaluate_complete_chat": q_evaluate_complete_chat,
    "evaluate_testgen": q_evaluate_testgen,
    "evaluate_testgenissue": q_evaluate_testgenissue,
    "evaluate_runs": q_evaluate_runs,
    "leaderboard": q_leaderboard,
}

#: Queries that SQL cannot express (merges of a tokenizer); tests/test_pieces.py holds them against the tokenizer.
WITHOUT_SQL = {"count_tokens_pieces", "token_cost_pieces", "pass_at_t_pieces"}
