"""Adapters from the driver tables to the engine's data model.

Each ``v_*`` builds, with the DataFrame API, the view of the same name in
FIXTURES.md (tasks, samples, verdicts, run facts, coverage, chunks, ...).
They read whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

NL = "\n"


# Driver tables whose rows carry per-row CPU work (text, XML, run facts).
ROW_WORK_TABLES = {"documents", "pages", "lineitem", "events", "orders", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ROW_WORK_TABLES else df


TASK_ROWS = 500_000          # of a scan that one task works through


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan round-robin that would leave most cores idle, or give a task more than ``TASK_ROWS`` rows.

    Spark cuts files by bytes, but all rows of a row group go to one split: a
    file of one row group is worked through (XML parsing, regex token counts,
    brace folds) by one task, however many splits it has, and narrow rows come
    by the million in a split.  So a scan with fewer splits that hold rows than
    there are cores is spread, and one with more rows a split than a task
    should work through: its tasks become more with the table, not longer.
    Rows are only counted (from the footers, no column is read).
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        rows, most, busy = _rows_of_splits(df)
        want = max(cores, -(-rows // TASK_ROWS))
        return df if busy >= cores and most <= 2 * TASK_ROWS else df.repartition(want)
    except Exception:       # no RDD view (e.g. a Spark Connect session): leave the scan as is
        return df


def _rows_of_splits(df: DataFrame) -> tuple[int, int, int]:
    """Rows of a scan, the most in one of its splits, and how many splits hold any."""
    sizes = df.select(F.spark_partition_id().alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return tuple(sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count("n")).first())


def v_tasks(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    item = F.col("item_id")
    return b.select(
        item.cast("int").alias("task_idx"),
        F.concat(F.lit("task-"), F.lpad(item.cast("string"), 6, "0")).alias("task_id"),
        F.concat(F.lit("  "), F.col("text"), F.lit(NL)).alias("prompt_complete"),
        F.concat(F.lit("Q: "), F.col("text")).alias("prompt_chat"),
        F.concat(F.lit("P"), (item % 5).cast("string")).alias("project"),
        (item + 1).cast("int").alias("bug_id"),
        (item % 2 == 0).alias("defective"),
    )


def n_tasks_scalar(spark, sf_dir):
    """Number of tasks as a scalar subquery (evaluated once, no join)."""
    return table(spark, sf_dir, "benchmark").select(F.count(F.lit(1))).scalar()


def v_samples(spark, sf_dir) -> DataFrame:
    n = n_tasks_scalar(spark, sf_dir)
    d = table(spark, sf_dir, "documents")
    return d.select(
        (F.col("doc_id") % n).cast("int").alias("task_idx"),
        F.floor(F.col("doc_id") / n).cast("int").alias("sample_idx"),
        "doc_id", F.col("text").alias("output"), "lang", "n_chars",
    )


def scored_samples(spark, sf_dir, samples: DataFrame | None = None) -> DataFrame:
    """Samples with their verdict flags and text (V_samples joined to labels)."""
    s = samples if samples is not None else v_samples(spark, sf_dir)
    lab = table(spark, sf_dir, "labels")
    q, tox = F.col("quality"), F.col("toxic")
    return s.join(lab, "doc_id").select(
        "task_idx", "sample_idx", "doc_id", "output",
        ((q == 1) | (F.col("n_chars") >= 600)).alias("pass_syntax"),
        (q == 1).alias("pass_compile"),
        ((q == 1) & (tox == 0)).alias("pass_trigger"),
        ((q == 1) & (tox == 0) & (F.col("lang") == "fr")).alias("pass_all"),
        (F.col("n_chars") >= 5000).alias("timed_out"),
    )


def v_verdicts(spark, sf_dir, samples: DataFrame | None = None) -> DataFrame:
    return scored_samples(spark, sf_dir, samples).select(
        "task_idx", "sample_idx", "pass_syntax", "pass_compile", "pass_trigger", "pass_all", "timed_out")


# The answer endings of the defect-detection fixture, by doc_id % 13.
ANSWER_ENDINGS = [
    "Yes, it has defects", "No, it doesn't have defects", "Note: there is a potential defect",
    "this doesn't has defect", "ERROR", "$ERROR$", "here is a potential issue",
    "there are no real defects", "I cannot determine", "no defects. Yes?",
    "There are quite a few issues", "this function is not flawed", "",
]


def v_answers(spark, sf_dir) -> DataFrame:
    s = v_samples(spark, sf_dir)
    r = F.col("doc_id") % 13
    ending = F.when(r == 0, F.lit(ANSWER_ENDINGS[0]))
    for i, e in enumerate(ANSWER_ENDINGS[1:-1], start=1):
        ending = ending.when(r == i, F.lit(e))
    ending = ending.otherwise(F.lit(ANSWER_ENDINGS[-1]))
    return s.select("task_idx", "sample_idx", "doc_id",
                    F.concat(F.replace(F.col("output"), F.lit("No"), F.lit("no")), F.lit(" "), ending)
                    .alias("output"))


def v_code(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id").cast("string")
    r7 = F.col("page_id") % 7
    body = (F.when(r7 == 0, F.lit("(int a) no body "))
            .when(r7 == 1, F.lit("(int a) { return 1; } tail }"))
            .when(r7 == 2, F.lit('(int a) { s = "}"; { x(); } } tail'))
            .when(r7 == 3, F.lit("} { y }"))
            .when(r7 == 4, F.lit("(int a) { open "))
            .when(r7 == 5, F.concat(F.lit("(int a) { c = '\"'; } public int f"), pid, F.lit("(int b) { }")))
            .otherwise(F.lit("{}")))
    lead = F.when(F.col("page_id") % 6 == 0, F.lit("Sure: ")).otherwise(F.concat(F.lit("Sure: public int f"), pid))
    r3 = F.col("page_id") % 3
    pure = F.when(r3 == 0, F.lit("")).when(r3 == 1, F.lit("return 1; }")).otherwise(F.lit("absent-text"))
    return p.select("page_id", F.concat(F.lit("public int f"), pid, F.lit("(int a)")).alias("sig"),
                    F.concat(lead, body, F.col("html")).alias("answer"), pure.alias("pure"))


def v_signatures(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    r = F.col("page_id") % 5
    sig = (F.when(r == 0, F.lit("public int f(int a)"))
           .when(r == 1, F.lit("@Override\npublic void g(String s)"))
           .when(r == 2, F.lit("int h( // first\n int b)"))
           .when(r == 3, F.lit("@Test public void t()"))
           .otherwise(F.concat(F.lit("static T k"), F.col("page_id").cast("string"), F.lit(" (T x) // end"))))
    return p.select("page_id", F.concat(sig, F.lit(NL), F.coalesce("html", F.lit(""))).alias("sig"))


def v_steps(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", "event_type", "value", F.to_date("ts").alias("run_day"))
    run = Window.partitionBy("user_id", "run_day")
    e = e.select("*", F.row_number().over(run.orderBy("ts", "event_id")).alias("step_no"),
                 F.count(F.lit(1)).over(run).alias("n_steps"))
    err = F.col("event_type") == "error"
    return e.select(
        "user_id", "run_day", "step_no",
        F.when(F.col("step_no") == F.col("n_steps"), F.lit("suite")).otherwise(F.lit("trigger")).alias("kind"),
        F.when(err, 1).otherwise(0).alias("exit_code"),
        (~err & (F.col("value") >= 140)).alias("timed_out"),
        F.when(F.col("event_type") == "view", F.lit("Failing tests: 2"))
        .otherwise(F.lit("Failing tests: 0")).alias("last_line"),
        "value",
    )


def v_twin(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    err = F.col("event_type") == "error"
    return e.select(
        F.floor(F.col("event_id") / 2).cast("long").alias("sample_idx"),
        F.when(F.col("event_id") % 2 == 0, F.lit("fixed")).otherwise(F.lit("buggy")).alias("version"),
        F.when(err, 1).otherwise(0).alias("exit_code"),
        (~err & (F.col("value") >= 140)).alias("timed_out"),
        F.when(F.col("event_type").isin("view", "signup"), F.lit("Failing tests: 1"))
        .otherwise(F.lit("Failing tests: 0")).alias("last_line"),
        "value",
    )


def v_cov(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cls = F.concat(F.lit("C"), F.col("l_suppkey").cast("string"))
    return li.select(
        (F.col("l_partkey") % 100).cast("int").alias("task_idx"),
        F.col("l_orderkey").alias("sample_key"),
        cls.alias("class"), F.concat(cls, F.lit(".java")).alias("file"),
        F.col("l_linenumber").cast("string").alias("number"),
        (F.col("l_quantity") > 30).alias("hit"),
        (F.col("l_linestatus") == "O").alias("cond_hit"),
    )


def v_cov_xml(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    supp = F.col("l_suppkey").cast("string")
    num = F.col("l_linenumber").cast("string")
    hits = (F.col("l_quantity").cast("int") % 3).cast("string")
    xml = F.concat(
        F.lit('<coverage><packages><package name="p"><classes><class name="C'), supp,
        F.lit('" filename="C'), supp, F.lit('.java"><methods><method name="m"><lines><line number="'), num,
        F.lit('" hits="'), hits, F.lit('"/></lines></method></methods><lines><line number="'), num,
        F.lit('" hits="'), hits,
        F.lit('"/><line number="99" hits="0"/></lines></class></classes></package></packages></coverage>'))
    return li.select("l_orderkey", "l_linenumber", xml.alias("xml"))


def v_cov_log(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    r = k % 4
    log = (F.when(r == 0, F.lit(""))
           .when(r == 1, F.concat(F.lit("x\nLine coverage: "), (k % 101).cast("string"),
                                  F.lit(".5%\nCondition coverage: 40.0%")))
           .when(r == 2, F.lit("Condition coverage: 7.0%"))
           .otherwise(F.lit("Line coverage: 0.0%\nother")))
    return o.select("o_orderkey", log.alias("log"))


def v_err_log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stderr = F.when(F.col("event_type") == "error",
                    F.concat(F.lit("note\nA"), (F.col("user_id") % 7).cast("string"),
                             F.lit(".java:3: error: bad\nB.java:9: error: later"))).otherwise(F.lit("warn"))
    return e.select("event_id", stderr.alias("stderr"), (F.col("event_type") == "error").alias("failed"))


def v_partials(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("ord"),
                    F.col("text").alias("output"), F.col("role").alias("gen_mode"))


def v_turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def chunk_text(turn, text):
    """V_chunks text rule."""
    r = turn % 4
    head = text
    return (F.when(r == 0, F.concat(F.lit("f() { a"), head))
            .when(r == 1, F.concat(head, F.lit("{ b } Yes, it has")))
            .when(r == 2, F.concat(F.lit(" defects } done"), head))
            .otherwise(F.concat(F.lit(" }"), head)))


FIRST_CHUNK = 1_700_000_000   # seconds since 1970


def v_chunks(spark, sf_dir) -> DataFrame:
    """Turns as chunks; system turns are special tokens.  ``ts``: a second per turn."""
    n = n_tasks_scalar(spark, sf_dir)
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"),
                    chunk_text(F.col("turn"), F.col("text")).alias("text"), (F.col("role") == "system").alias("special"),
                    (F.col("conv_id") % n).cast("int").alias("task_idx"), F.timestamp_seconds(F.col("turn") + FIRST_CHUNK).alias("ts"))


def v_classes(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat_ws(",", "p_brand", "p_type", "p_brand").alias("names"))


def v_docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")


PER_RECORD = 20              # outputs of one generation record, as a run writes them


def v_generations(spark, sf_dir, samples: DataFrame | None = None) -> DataFrame:
    """Records of at most ``PER_RECORD`` outputs of a task, ordered by sample index; ``ord`` numbers a task's records."""
    s = samples if samples is not None else v_samples(spark, sf_dir)
    block = F.floor(F.col("sample_idx") / PER_RECORD).cast("long")
    return (s.groupBy("task_idx", block.alias("ord"))
            .agg(F.array_sort(F.collect_list(F.struct("sample_idx", "output"))).alias("_o"))
            .select("task_idx", "ord",
                    F.concat(F.lit("task-"), F.lpad(F.col("task_idx").cast("string"), 6, "0")).alias("task_id"),
                    F.transform("_o", lambda x: x["output"]).alias("outputs")))


def v_chat_samples(spark, sf_dir) -> DataFrame:
    """V_samples with answers that hold the task's signature twice in three, with a closed body in one."""
    s = v_samples(spark, sf_dir)
    sig = F.concat(F.lit("Sure: public int f"), F.col("task_idx").cast("string"), F.lit("(int a)"))
    r = F.col("doc_id") % 3
    return s.withColumn("output", F.when(r == 1, F.concat(sig, F.lit(" { return 1; } "), F.col("output")))
                        .when(r == 2, F.concat(sig, F.lit(" { "), F.col("output"))).otherwise(F.col("output")))


def _facts(samples: DataFrame, steps: list) -> DataFrame:
    """Run facts: ``steps`` are (version, kind, exit code, timed out, log lines) per sample, in order."""
    rows = [F.struct(F.lit(v).alias("version"), F.lit(k).cast("int").alias("step_no"), F.lit(kind).alias("kind"),
                     F.when(code, 1).otherwise(0).alias("exit_code"), late.alias("timed_out"), lines.alias("stdout_lines"))
            for k, (v, kind, code, late, lines) in enumerate(steps, 1)]
    return samples.select("task_idx", "sample_idx", (F.col("n_chars") % 17 != 0).alias("syntax_ok"), F.explode(F.array(*rows)).alias("s")).select(
        "task_idx", "sample_idx", "s.*", "syntax_ok")


def _failing(n) -> F.Column:
    return F.array(F.concat(F.lit("Failing tests: "), n.cast("string")))


def _coverage_log() -> F.Column:
    return F.array(F.concat(F.lit("Line coverage: "), (F.col("n_chars") % 101).cast("string"), F.lit(".0%")),
                   F.concat(F.lit("Condition coverage: "), (F.col("doc_id") % 101).cast("string"), F.lit(".0%")))


def v_patch_facts(spark, sf_dir) -> DataFrame:
    d, n = F.col("doc_id"), F.col("n_chars")
    return _facts(v_samples(spark, sf_dir), [(None, "trigger", d % 7 == 0, n >= 5000, _failing(d % 3)),
                                             (None, "suite", d % 11 == 0, n % 13 == 0, _failing(d % 2))])


def v_test_facts(spark, sf_dir) -> DataFrame:
    d, n = F.col("doc_id"), F.col("n_chars")
    return _facts(v_samples(spark, sf_dir), [(None, "test", d % 7 == 0, n >= 5000, _failing(d % 3)),
                                             (None, "coverage", d % 11 == 0, n % 13 == 0, _coverage_log())])


def v_issue_facts(spark, sf_dir) -> DataFrame:
    d, n = F.col("doc_id"), F.col("n_chars")
    return _facts(v_samples(spark, sf_dir), [("fixed", "test", d % 7 == 0, n >= 5000, _failing(d % 3)),
                                             ("buggy", "test", d % 5 == 0, n < 0, _failing(d % 4)),
                                             ("fixed", "coverage", d % 11 == 0, n % 13 == 0, _coverage_log())])


def v_sample_lines(spark, sf_dir) -> DataFrame:
    """Two covered or missed lines per sample."""
    s = v_samples(spark, sf_dir)
    cls = F.concat(F.lit("C"), F.col("task_idx").cast("string"))
    lines = F.explode(F.array(
        F.struct((F.col("n_chars") % 17).cast("string").alias("number"), (F.col("doc_id") % 2 == 0).alias("hit")),
        F.struct((F.col("doc_id") % 13).cast("string").alias("number"), (F.col("n_chars") % 2 == 0).alias("hit"))))
    return s.select("task_idx", "sample_idx", cls.alias("class"), F.concat(cls, F.lit(".java")).alias("file"), lines.alias("l")).select(
        "task_idx", "sample_idx", "class", "file", "l.number", "l.hit")


def v_eval_tasks(spark, sf_dir) -> DataFrame:
    """V_tasks with the columns the complete suite's post-processing reads."""
    t = v_tasks(spark, sf_dir)
    return (t.withColumn("prompt_complete_with_comment", F.col("prompt_complete"))
            .withColumn("function_signature",
                        F.concat(F.lit("public int f"), F.col("task_idx").cast("string"), F.lit("(int a)"))))
