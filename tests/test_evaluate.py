import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from evalspark.plans.evaluate import run_evaluate, verdicts_from_facts
from evalspark.suites import get_suite


def _tasks(spark, n):
    return spark.createDataFrame([Row(task_idx=i, task_id=f"t{i}", prompt_complete=f"  p{i} {{\n",
                                      prompt_chat=f"Q{i}", prompt_complete_with_comment=f"  p{i} {{\n",
                                      function_signature=f"int f{i}()", defective=i % 2 == 0) for i in range(n)])


def _gens(spark, outputs):
    return spark.createDataFrame([Row(task_idx=i, outputs=o) for i, o in enumerate(outputs)])


def test_complete_suite_from_run_facts(spark):
    tasks = _tasks(spark, 2)
    gens = _gens(spark, [["  p0 {\n{ return 1; } junk", "  p0 {\n{ never"], ["  p1 {\nx } y", "ERROR", "  p1 {\n}"]])
    ok, bad = ["Failing tests: 0"], ["Failing tests: 1"]
    steps = [
        # task 0 sample 0: everything passes; sample 1: trigger test fails
        Row(task_idx=0, sample_idx=0, step_no=1, kind="trigger", exit_code=0, timed_out=False, stdout_lines=ok, syntax_ok=True),
        Row(task_idx=0, sample_idx=0, step_no=2, kind="suite", exit_code=0, timed_out=False, stdout_lines=ok, syntax_ok=True),
        Row(task_idx=0, sample_idx=1, step_no=1, kind="trigger", exit_code=0, timed_out=False, stdout_lines=bad, syntax_ok=True),
        Row(task_idx=0, sample_idx=1, step_no=2, kind="suite", exit_code=0, timed_out=False, stdout_lines=ok, syntax_ok=True),
        # task 1: compile failure, syntax error, trigger ok but suite fails tests
        Row(task_idx=1, sample_idx=0, step_no=1, kind="trigger", exit_code=1, timed_out=False, stdout_lines=[], syntax_ok=True),
        Row(task_idx=1, sample_idx=1, step_no=1, kind="suite", exit_code=0, timed_out=False, stdout_lines=ok, syntax_ok=False),
        Row(task_idx=1, sample_idx=2, step_no=1, kind="trigger", exit_code=0, timed_out=False, stdout_lines=ok, syntax_ok=True),
        Row(task_idx=1, sample_idx=2, step_no=2, kind="suite", exit_code=0, timed_out=False, stdout_lines=bad, syntax_ok=True),
    ]
    rep = run_evaluate(spark, "complete", tasks, gens, "complete", run_steps=spark.createDataFrame(steps))
    samples = {(r.task_idx, r.sample_idx): r for r in rep.samples.collect()}
    assert samples[(0, 0)].output == "{ return 1; }"
    assert samples[(0, 0)].raw_output == "  p0 {\n{ return 1; }"
    assert samples[(1, 0)].output == "x } y"
    assert samples[(0, 1)].output == "{ never"
    assert samples[(0, 0)].input == "p0 {"
    counts = {r.task_idx: r for r in rep.task_counts.collect()}
    assert (counts[0].total, counts[0].c_syntax, counts[0].c_compile, counts[0].c_trigger, counts[0].c_all) == (2, 2, 2, 1, 1)
    assert (counts[1].total, counts[1].c_syntax, counts[1].c_compile, counts[1].c_trigger, counts[1].c_all) == (3, 2, 1, 1, 0)
    m = {(r.flag, r.metric, r.param): r for r in rep.suite_metrics.collect()}
    assert m[("pass_trigger", "pass@k", 1.0)].value == pytest.approx((0.5 + 1 / 3) / 2)
    assert m[("pass_all", "pass@k", 1.0)].n_tasks == 2
    solved = rep.solved.first()
    assert (solved.total, solved.solved_all, solved.solved_trigger) == (2, 1, 2)
    detail = {r.task_idx: r for r in rep.detail.collect()}
    assert detail[0].pass_trigger.pass_at_k_1 == pytest.approx(0.5)
    assert detail[1].pass_all["count"] == 0


def test_testgen_and_issue_suites_from_facts(spark):
    cov_lines = ["Line coverage: 40.0%", "Condition coverage: 10.0%"]
    steps = spark.createDataFrame([
        Row(task_idx=0, sample_idx=0, step_no=1, kind="test", exit_code=0, timed_out=False,
            stdout_lines=["Failing tests: 0"], syntax_ok=True),
        Row(task_idx=0, sample_idx=0, step_no=2, kind="coverage", exit_code=0, timed_out=False,
            stdout_lines=cov_lines, syntax_ok=True),
        Row(task_idx=0, sample_idx=1, step_no=1, kind="test", exit_code=0, timed_out=True,
            stdout_lines=[], syntax_ok=True),
    ])
    v = {r.sample_idx: r for r in verdicts_from_facts("testgen", steps).collect()}
    assert (v[0].pass_trigger, v[0].line_coverage, v[0].condition_coverage) == (True, 0.4, 0.1)
    assert (v[1].pass_trigger, v[1].timed_out, v[1].line_coverage) == (False, True, 0.0)

    twin = spark.createDataFrame([
        Row(task_idx=0, sample_idx=0, version="fixed", step_no=1, kind="test", exit_code=0, timed_out=False,
            stdout_lines=["Failing tests: 0"]),
        Row(task_idx=0, sample_idx=0, version="buggy", step_no=1, kind="test", exit_code=0, timed_out=False,
            stdout_lines=["Failing tests: 1"]),
        Row(task_idx=0, sample_idx=1, version="fixed", step_no=1, kind="test", exit_code=0, timed_out=False,
            stdout_lines=["Failing tests: 0"]),
        Row(task_idx=0, sample_idx=1, version="buggy", step_no=1, kind="test", exit_code=0, timed_out=False,
            stdout_lines=["Failing tests: 0"]),
        # a compile failure on the buggy version leaves no log and still reveals the issue
        Row(task_idx=0, sample_idx=2, version="fixed", step_no=1, kind="test", exit_code=0, timed_out=False,
            stdout_lines=["Failing tests: 0"]),
        Row(task_idx=0, sample_idx=2, version="buggy", step_no=1, kind="test", exit_code=1, timed_out=False,
            stdout_lines=[]),
    ])
    coverage = spark.createDataFrame([Row(task_idx=0, sample_idx=i, coverage=Row(line_coverage=0.5, condition_coverage=0.2))
                                      for i in range(3)])
    iv = {r.sample_idx: r for r in verdicts_from_facts("testgenissue", twin, coverage).collect()}
    assert iv[0].pass_trigger and not iv[1].pass_trigger
    assert iv[0].line_coverage == 0.5 and iv[1].line_coverage == 0.0
    assert iv[2].pass_trigger and not iv[2].pass_compile


def test_defect_suite_chat_mode(spark):
    tasks = _tasks(spark, 2)
    gens = _gens(spark, [["Yes, it has defects. No.", "I cannot determine"], ["No, it doesn't have defects"]])
    rep = run_evaluate(spark, "defectdetection", tasks, gens, "chat")
    d = {r.variant: r for r in rep.defect.collect()}
    assert (d["all"].total, d["all"].error, d["all"].tp, d["all"].tn) == (3, 1, 1, 1)
    assert (d["one"].total, d["one"].correct) == (2, 2)
    outs = sorted(r.output for r in rep.samples.collect())
    assert outs == ["I cannot determine", "No, it doesn't have defects", "Yes, it has defect"]


def test_unknown_suite_and_mode(spark):
    with pytest.raises(KeyError):
        get_suite("nope")
    with pytest.raises(NotImplementedError):
        run_evaluate(spark, "complete", _tasks(spark, 1), _gens(spark, [["x"]]), "other")


def test_evaluate_files_writes_reference_shaped_report(spark):
    import json
    import os
    from evalspark.plans.evaluate import evaluate_files
    from evalspark.session import scratch_path
    root = scratch_path(spark, "eval-files")
    os.makedirs(root, exist_ok=True)
    tasks_path = os.path.join(root, "tasks")
    _tasks(spark, 2).withColumn("task_idx", F.col("task_idx").cast("int")).write.parquet(tasks_path)
    gens_path = os.path.join(root, "generations.json")
    with open(gens_path, "w") as f:      # the merged generations file: one JSON array, indented
        json.dump([{"task_idx": 0, "task_id": "t0", "outputs": ["  p0 {\n{ a }", "  p0 {\n{ b"]},
                   {"task_idx": 1, "task_id": "t1", "outputs": ["  p1 {\n{ c }"]}], f, indent=4)
    ok = ["Failing tests: 0"]
    steps = spark.createDataFrame([
        (t, s_, 1, "suite", 0, False, ok if (t, s_) != (0, 1) else ["Failing tests: 2"], True)
        for t, s_ in ((0, 0), (0, 1), (1, 0))],
        "task_idx int, sample_idx int, step_no int, kind string, exit_code int, timed_out boolean, "
        "stdout_lines array<string>, syntax_ok boolean")
    steps_path = os.path.join(root, "steps")
    steps.write.parquet(steps_path)
    docs = evaluate_files(spark, "complete", tasks_path, gens_path, "complete", os.path.join(root, "out"),
                          run_steps_path=steps_path).collect()
    assert len(docs) == 1
    d = json.loads(docs[0].document)
    assert d["total"] == 2 and d["timed_out"] == 0
    assert d["pass_all"]["count"] == 2.0
    assert d["pass_all"]["pass@k-1"] == pytest.approx((0.5 + 1.0) / 2)
    assert "time_cost" in d and "end_time" in d
    with open(os.path.join(root, "out", "log/model/complete/evaluation-default-complete.json")) as f:
        whole = json.load(f)
    assert {k: whole[k] for k in d} == d and list(whole["detail"]) == ["0", "1"]
    assert whole["detail"]["0"]["total"] == 2 and whole["detail"]["0"]["pass_all"]["count"] == 1
    assert whole["detail"]["0"]["pass_all"]["pass@k-1"] == pytest.approx(0.5)
    stage = spark.read.parquet(os.path.join(root, "generations-postprocess"))
    assert sorted(r.output for r in stage.collect()) == ["{ a }", "{ b", "{ c }"]


def test_evaluate_files_defect_report(spark):
    import json
    import os
    from evalspark.plans.evaluate import evaluate_files
    from evalspark.session import scratch_path
    root = scratch_path(spark, "eval-files-defect")
    os.makedirs(root, exist_ok=True)
    tasks_path = os.path.join(root, "tasks")
    _tasks(spark, 2).withColumn("task_idx", F.col("task_idx").cast("int")).write.parquet(tasks_path)
    gens_path = os.path.join(root, "generations.json")
    with open(gens_path, "w") as f:
        json.dump([{"task_idx": 0, "task_id": "t0", "outputs": ["Yes, it has defects", "unclear"]},
                   {"task_idx": 1, "task_id": "t1", "outputs": ["No, it doesn't have defects"]}], f, indent=4)
    docs = evaluate_files(spark, "defectdetection", tasks_path, gens_path, "chat", os.path.join(root, "out")).collect()
    d = json.loads(docs[0].document)
    assert d["results_all"]["total"] == 3 and d["results_all"]["error"] == 1
    assert d["results_one"]["acc"] == 1.0
    with open(os.path.join(root, "out", "log/model/defectdetection/evaluation-default-chat.json")) as f:
        assert json.load(f)["results_one"] == d["results_one"]


def test_many_runs_in_one_job_equal_one_job_per_run(spark):
    from paths import SF_SMALL
    from evalspark import fixtures as fx
    from evalspark.plans.evaluate import score
    s = fx.v_samples(spark, SF_SMALL).select("task_idx", "sample_idx", F.lit("prompt text").alias("input"),
                                             F.col("output").alias("raw_output"))
    v = fx.v_verdicts(spark, SF_SMALL)
    runs_s = s.withColumn("model_id", F.lit("m0")).unionByName(s.withColumn("model_id", F.lit("m1")))
    runs_v = v.withColumn("model_id", F.lit("m0")).unionByName(
        v.withColumn("model_id", F.lit("m1")).withColumn("pass_compile", ~F.col("pass_compile")))
    together = score(runs_s, "complete", verdicts=runs_v, run_keys=["model_id"])

    def rows(df, drop=()):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r)
                      for r in df.drop(*drop).collect())

    for m in ("m0", "m1"):
        alone = score(runs_s.filter(F.col("model_id") == m).drop("model_id"), "complete",
                      verdicts=runs_v.filter(F.col("model_id") == m).drop("model_id"))
        assert rows(together.suite_metrics.filter(F.col("model_id") == m), ["model_id"]) == \
            rows(alone.suite_metrics.select(*[c for c in together.suite_metrics.columns if c != "model_id"]))
        assert rows(together.solved.filter(F.col("model_id") == m), ["model_id"]) == rows(alone.solved)


def test_runs_of_a_merged_table_equal_their_single_evaluations(spark):
    """evaluate_runs: documents of many runs at once, run keys as text, null keys and missing facts refused."""
    import json
    import os
    from evalspark.plans.evaluate import evaluate_files, evaluate_runs
    from evalspark.session import scratch_path
    root = scratch_path(spark, "eval-runs")
    _tasks(spark, 2).withColumn("task_idx", F.col("task_idx").cast("int")).write.parquet(f"{root}/tasks")
    outputs = {("007", "a/b"): [["{ test }", "{ t2 }"], ["{ x }"]], ("7", "a/b"): [["{ one }"]], ("org/m", "c"): [["{ p }", "{ q }"], ["{ r }"]]}
    steps_ddl = ("task_idx int, sample_idx int, step_no int, kind string, exit_code int, timed_out boolean, "
                 "stdout_lines array<string>, syntax_ok boolean")
    lines_ddl = "task_idx int, sample_idx int, class string, file string, number string, hit boolean"
    gens, steps, lines, alone = [], [], [], {}
    for r, (run, tasks) in enumerate(outputs.items()):
        step_rows = [row for t, outs in enumerate(tasks) for n in range(len(outs)) for row in (
            (t, n, 1, "test", 0, False, [f"Failing tests: {(t + n + r) % 2}"], True),
            (t, n, 2, "coverage", 0, False, [f"Line coverage: {10 * (r + n + 1)}.0%", "Condition coverage: 20.0%"], True))]
        line_rows = [(t, n, "A", "A.java", str(k), (k + r + n) % 2 == 0) for t, outs in enumerate(tasks) for n in range(len(outs)) for k in range(3 + r)]
        gens += [(*run, t, outs) for t, outs in enumerate(tasks)]
        steps += [(*run, *row) for row in step_rows]
        lines += [(*run, *row) for row in line_rows]
        at = f"{root}/alone-{r}"
        spark.createDataFrame(step_rows, steps_ddl).write.parquet(f"{at}/steps")
        spark.createDataFrame(line_rows, lines_ddl).write.parquet(f"{at}/lines")
        with open(f"{root}/alone-{r}/generations.json", "w") as f:
            json.dump([{"task_idx": t, "task_id": f"t{t}", "outputs": outs} for t, outs in enumerate(tasks)], f)
        evaluate_files(spark, "testgen", f"{root}/tasks", f"{at}/generations.json", "complete", f"{at}/out", run_steps_path=f"{at}/steps",
                       coverage_lines_path=f"{at}/lines")
        with open(f"{at}/out/log/model/testgen/evaluation-default-complete.json") as f:
            alone[run] = json.load(f)
    keys = "model_id string, version_id string, "
    runs = ("model_id", "version_id")
    table = spark.createDataFrame(gens, keys + "task_idx int, outputs array<string>")
    other = table.withColumn("gen_mode", F.lit("chat")).withColumn("outputs", F.array(F.lit("of another mode")))
    table.withColumn("gen_mode", F.lit("complete")).unionByName(other).write.partitionBy(*runs, "gen_mode").parquet(f"{root}/merged")
    spark.createDataFrame(steps, keys + steps_ddl).write.parquet(f"{root}/steps")
    spark.createDataFrame(lines, keys + lines_ddl).write.parquet(f"{root}/lines")
    docs = evaluate_runs(spark, "testgen", f"{root}/tasks", f"{root}/merged", "complete", f"{root}/out", runs, run_steps_path=f"{root}/steps",
                         coverage_lines_path=f"{root}/lines").collect()
    assert {(d.model_id, d.version_id) for d in docs} == set(outputs)
    timing = ("time_cost", "end_time")
    for run, name in ((("007", "a/b"), "007/a%2Fb"), (("7", "a/b"), "7/a%2Fb"), (("org/m", "c"), "org%2Fm/c")):
        with open(os.path.join(root, "out/log", name, "testgen/evaluation-default-complete.json")) as f:
            whole = json.load(f)
        assert {k: v for k, v in whole.items() if k not in timing} == {k: v for k, v in alone[run].items() if k not in timing}
    spark.createDataFrame(gens + [(None, "v", 0, ["x"])], keys + "task_idx int, outputs array<string>").write.parquet(f"{root}/null-key")
    with pytest.raises(Exception, match="no value in"):
        evaluate_runs(spark, "testgen", f"{root}/tasks", f"{root}/null-key", "complete", f"{root}/out2", runs, run_steps_path=f"{root}/steps")
    spark.createDataFrame([g for g in steps if g[0] != "7"], keys + steps_ddl).write.parquet(f"{root}/fewer-steps")
    with pytest.raises(Exception, match="no verdict"):
        evaluate_runs(spark, "testgen", f"{root}/tasks", f"{root}/merged", "complete", f"{root}/out3", runs, run_steps_path=f"{root}/fewer-steps")


def test_counted_once_then_read(spark):
    """With counts_path the tables of a report read the staged counts and equal those scored without it; a counter reaches pass@t."""
    from evalspark.plans.evaluate import score
    from evalspark.session import scratch_path
    samples = spark.createDataFrame([(0, 0, "a b", "c d e"), (0, 1, "a b", "f"), (1, 0, "a", "")], "task_idx int, sample_idx int, input string, raw_output string")
    verdicts = spark.createDataFrame([(0, 0, True, True, True, True, False), (0, 1, True, True, False, False, True), (1, 0, True, False, False, False, False)],
                                     "task_idx int, sample_idx int, pass_syntax boolean, pass_compile boolean, pass_trigger boolean, "
                                     "pass_all boolean, timed_out boolean")

    def ones(texts, keys, text):
        return texts.groupBy(*keys).agg(F.lit(1).cast("long").alias("n_tokens"))

    path = scratch_path(spark, "counts")
    for counter in (None, ones):
        plain = score(samples, "complete", verdicts=verdicts, counter=counter)
        staged = score(samples, "complete", verdicts=verdicts, counter=counter, counts_path=path)
        for name in ("suite_metrics", "solved", "detail"):
            a, b = getattr(plain, name), getattr(staged, name)
            assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        plan = staged.suite_metrics._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and path.rpartition("/")[2] in plan
    assert {r.total_tokens for r in staged.task_counts.collect()} == {3.0, 1.5}


def test_evaluate_files_testgen_report_has_coverage(spark):
    import json
    import os
    from evalspark.plans.evaluate import evaluate_files
    from evalspark.session import scratch_path
    root = scratch_path(spark, "eval-files-testgen")
    os.makedirs(root, exist_ok=True)
    tasks_path = os.path.join(root, "tasks")
    _tasks(spark, 1).withColumn("task_idx", F.col("task_idx").cast("int")).write.parquet(tasks_path)
    gens_path = os.path.join(root, "generations.json")
    with open(gens_path, "w") as f:
        json.dump([{"task_idx": 0, "task_id": "t0", "outputs": ["  p0 {\n{ test }", "  p0 {\n{ t2 }"]}], f)
    steps = spark.createDataFrame([
        (0, 0, 1, "test", 0, False, ["Failing tests: 0"], True),
        (0, 0, 2, "coverage", 0, False, ["Line coverage: 50.0%", "Condition coverage: 20.0%"], True),
        (0, 1, 1, "test", 1, False, [], True)],
        "task_idx int, sample_idx int, step_no int, kind string, exit_code int, timed_out boolean, "
        "stdout_lines array<string>, syntax_ok boolean")
    steps_path = os.path.join(root, "steps")
    steps.write.parquet(steps_path)
    lines_path = os.path.join(root, "lines")
    spark.createDataFrame([(0, 0, "A", "A.java", "3", True), (0, 1, "A", "A.java", "3", False), (0, 1, "A", "A.java", "4", True),
                           (0, 2, "A", "A.java", "5", False)],                # of a sample that is not selected
                          "task_idx int, sample_idx int, class string, file string, number string, hit boolean").write.parquet(lines_path)
    d = json.loads(evaluate_files(spark, "testgen", tasks_path, gens_path, "complete", os.path.join(root, "out"),
                                  run_steps_path=steps_path, coverage_lines_path=lines_path).first().document)
    assert d["line_coverage"] == pytest.approx(0.25) and d["condition_coverage"] == pytest.approx(0.1)
    assert d["diff_coverage"] == pytest.approx(2 / 3)
    assert d["pass_trigger"]["pass@k-1"] == pytest.approx(0.5) and d["pass_compile"]["count"] == 1.0
    with open(os.path.join(root, "out", "log/model/testgen/evaluation-default-complete.json")) as f:
        task = json.load(f)["detail"]["0"]
    assert task["line_coverage"] == pytest.approx(0.25) and task["condition_coverage"] == pytest.approx(0.1)
    assert task["diff_coverage"] == pytest.approx(2 / 3)


def test_scoring_without_results_says_what_is_needed(spark):
    with pytest.raises(ValueError, match="run_steps.*or verdicts"):
        run_evaluate(spark, "repair", _tasks(spark, 1), _gens(spark, [["x"]]), "complete")
    lines = spark.createDataFrame([(0, "A", "A.java", "1", True)], "task_idx int, class string, file string, number string, hit boolean")
    verdicts = spark.createDataFrame([(0, 0, True, True, True, False, 1.0, 1.0)], "task_idx int, sample_idx int, pass_syntax boolean, "
                                     "pass_compile boolean, pass_trigger boolean, timed_out boolean, line_coverage double, condition_coverage double")
    with pytest.raises(ValueError, match="sample_idx"):
        run_evaluate(spark, "testgen", _tasks(spark, 1), _gens(spark, [["x"]]), "complete", verdicts=verdicts, coverage_lines=lines)


def test_a_suite_is_a_set_of_hooks(spark):
    """A suite with its own cleanup, facts, stop rule and report runs through run_evaluate and the stream stop."""
    from evalspark.operators import reports
    from evalspark.streaming.stop import rule_for
    from evalspark.suites import SuiteConfig, register_suite

    def first_line(cfg):
        return F.concat(F.col("project"), F.lit(":"), F.upper(F.split_part(F.col("output"), F.lit("\n"), F.lit(1))))

    def exit_codes(steps, keys, coverage=None):
        return steps.groupBy(*keys).agg(F.bool_and(F.col("exit_code") == 0).alias("pass_run"), F.lit(False).alias("timed_out"))

    def report(suite, **kw):
        out = reports.pass_report(suite, **kw)
        out.solved = out.solved.withColumn("suite", F.lit(suite.name))
        return out

    register_suite(SuiteConfig("lines", flags=("pass_run",), k_grid=(1, 2), t_grid=(), task_columns=("project",), complete=first_line, chat=first_line,
                               stop_rule=lambda mode: "marker", verdict=exit_codes, report=report))
    tasks = _tasks(spark, 2).withColumn("project", F.lit("P"))
    steps = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 0), (1, 0, 0)], "task_idx int, sample_idx int, exit_code int")
    rep = run_evaluate(spark, "lines", tasks, _gens(spark, [["one\ntwo", "x"], ["y\nz"]]), "chat", run_steps=steps)
    assert sorted(r.output for r in rep.samples.collect()) == ["P:ONE", "P:X", "P:Y"]
    m = {(r.flag, r.param): (r.n_tasks, r.value) for r in rep.suite_metrics.collect()}
    assert m == {("pass_run", 1.0): (2, 0.75), ("pass_run", 2.0): (1, 1.0)}
    assert (rep.solved.first().solved_run, rep.solved.first().suite) == (2, "lines")
    assert rule_for("lines", "chat") == "marker"
