import itertools

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from evalspark.operators import metrics as met
from evalspark.operators import samples as smp
from evalspark.operators import verdicts as ver

TRIG = ["none", "exit", "timeout", "tests"]
SUITE = ["ok", "exit", "timeout", "tests"]

FACT = {"ok": (0, False, "Failing tests: 0"), "exit": (1, False, ""), "timeout": (0, True, ""),
        "tests": (0, False, "Failing tests: 3")}


def reference_patch(first_fail, suite, syntax_ok):
    """The harness loop, stated over facts."""
    if not syntax_ok:
        return (False, False, False, False, False)
    compile_fail = timed_out = bugg = False
    entire_bugg = True
    if first_fail != "none":
        bugg = True
        compile_fail = first_fail == "exit"
        timed_out = first_fail == "timeout"
    else:
        if suite in ("exit", "timeout"):
            bugg = True
        elif suite == "ok":
            entire_bugg = False
    return (True, not compile_fail, not bugg, not entire_bugg, timed_out)


def test_patch_verdict_truth_table(spark):
    rows, expected = [], {}
    for run, (f, s, syn) in enumerate(itertools.product(TRIG, SUITE, [True, False])):
        steps = [("trigger", "ok")]
        if f != "none":
            steps += [("trigger", f), ("trigger", "timeout" if f != "timeout" else "exit")]
        steps += [("suite", s)]
        for no, (kind, st) in enumerate(steps, start=1):
            ex, to, line = FACT[st]
            rows.append(Row(run=run, step_no=no, kind=kind, exit_code=ex, timed_out=to,
                            stdout_lines=[line] if line else [], syntax_ok=syn))
        expected[run] = reference_patch(f, s, syn)
    df = spark.createDataFrame(rows)
    got = {r.run: (r.pass_syntax, r.pass_compile, r.pass_trigger, r.pass_all, r.timed_out)
           for r in ver.reduce_patch_verdict(df, ["run"]).collect()}
    assert got == expected


def test_twin_verdicts(spark):
    rows, expected = [], {}
    for sid, (fx_, bx) in enumerate(itertools.product(["ok", "tests"], ["ok", "tests", "exit", "timeout"])):
        for version, st in (("fixed", fx_), ("buggy", bx)):
            ex, to, line = FACT[st]
            rows.append(Row(sample_idx=sid, version=version, exit_code=ex, timed_out=to, last_line=line))
        expected[sid] = fx_ == "ok" and bx != "ok"
    facts = spark.createDataFrame(rows)
    paired = ver.pair_twin_runs(facts, ["sample_idx"]).withColumn(
        "coverage", F.struct(F.lit(0.5).alias("line_coverage"), F.lit(0.25).alias("condition_coverage")))
    got = {r.sample_idx: r.pass_trigger for r in ver.reduce_issue_verdict(paired, ["sample_idx"]).collect()}
    assert got == expected


def test_testgen_verdict_zero_coverage_fails(spark):
    rows = [Row(run=1, step_no=1, kind="test", exit_code=0, timed_out=False, stdout_lines=["Failing tests: 0"], syntax_ok=True),
            Row(run=1, step_no=2, kind="coverage", exit_code=0, timed_out=False,
                stdout_lines=["Line coverage: 0.0%", "Condition coverage: 5.0%"], syntax_ok=True),
            Row(run=2, step_no=1, kind="test", exit_code=0, timed_out=False, stdout_lines=["Failing tests: 0"], syntax_ok=True),
            Row(run=2, step_no=2, kind="coverage", exit_code=0, timed_out=False,
                stdout_lines=["Line coverage: 50.0%", "Condition coverage: 5.0%"], syntax_ok=True),
            Row(run=3, step_no=1, kind="test", exit_code=1, timed_out=False, stdout_lines=[], syntax_ok=True)]
    got = {r.run: (r.pass_trigger, r.line_coverage, r.pass_compile)
           for r in ver.reduce_testgen_verdict(spark.createDataFrame(rows), ["run"]).collect()}
    assert got == {1: (False, 0.0, True), 2: (True, 0.5, True), 3: (False, 0.0, False)}


def test_merge_then_explode_keeps_multiset(spark):
    rows = [Row(task_id=f"t{i % 7}", ord=i, output=f"o{i}", gen_mode="chat") for i in range(60)]
    p = spark.createDataFrame(rows)
    merged = smp.merge_partials(p, num_samples=100, keep_first=["gen_mode"])
    back = smp.flatten_samples(merged.select("task_id", "outputs"))
    assert sorted(r.output for r in back.collect()) == sorted(r.output for r in rows)
    firsts = {r.task_id: r.outputs[0] for r in merged.collect()}
    assert firsts["t3"] == "o3"
    cut = smp.merge_partials(p, num_samples=2)
    assert all(r.n_outputs == 2 for r in cut.collect())


def test_shards_keep_every_request_once(spark):
    t = spark.createDataFrame([Row(task_idx=i) for i in range(50)])
    req = smp.expand_requests(t, num_samples=10, batch_size=3)
    sh = smp.shard_requests(req, 4, seed=1).collect()
    assert len(sh) == 200 and len({(r.task_idx, r.copy_no) for r in sh}) == 200
    assert {r.shard_id for r in sh} == {0, 1, 2, 3}
    for n in (3, 7, 64, 300):
        sizes = [r["count"] for r in smp.shard_requests(req, n, seed=2).groupBy("shard_id").count().collect()]
        assert sum(sizes) == 200 and len(sizes) == min(n, 200) and max(sizes) - min(sizes) <= 1
    again = smp.shard_requests(req, 4, seed=1).collect()
    assert sorted(map(tuple, sh)) == sorted(map(tuple, again))


def test_attach_task_fails_on_missing_index(spark):
    s = spark.createDataFrame([Row(task_idx=0, sample_idx=0), Row(task_idx=5, sample_idx=0)])
    t = spark.createDataFrame([Row(task_idx=0, project="p")])
    with pytest.raises(Exception, match="missing from the task table"):
        smp.attach_task(s, t, ["project"]).collect()


def test_ranges(spark):
    df = spark.createDataFrame([Row(task_idx=i) for i in range(10)])
    assert [r.task_idx for r in smp.filter_generate_range(df, 2, 5).collect()] == [2, 3, 4]
    assert [r.task_idx for r in smp.filter_evaluate_range(df, 2, 5).collect()] == [2, 3, 4, 5]
    assert len(smp.filter_evaluate_range(df, -1, -1).collect()) == 10


def test_defect_scores_null_on_zero_denominator(spark):
    conf = spark.createDataFrame([Row(total=2, error=2, correct=0, tp=0, tn=0, fp=0, fn=0)])
    r = met.defect_scores(conf).first()
    assert r.acc is None and r.precision is None and r.f1 is None and r.acc_w_error == 0.0


def test_macro_mean_skips_ineligible_tasks(spark):
    v = spark.createDataFrame([Row(task_idx=t, pass_syntax=(i == 0), timed_out=False)
                               for t, n in ((0, 1), (1, 5)) for i in range(n)])
    counts = ver.task_verdict_counts(v, ["pass_syntax"])
    m = met.suite_pass_metrics(met.pass_at_k_task(counts, ["pass_syntax"], [1, 5]))
    got = {r.param: (r.n_tasks, round(r.value, 9)) for r in m.collect()}
    assert got == {1.0: (2, round((1.0 + 0.2) / 2, 9)), 5.0: (1, 1.0)}


def test_generation_side_round_trip(spark):
    from evalspark.plans.generation import build_requests, reorg_output_file
    from evalspark.session import scratch_path
    tasks = spark.createDataFrame([Row(task_idx=i, task_id=f"t{i}", prompt_complete=f" c{i} ", prompt_chat=f"q{i}")
                                   for i in range(6)])
    req = build_requests(tasks, "complete", "chat", num_samples=5, batch_size=2, begin=1, end=4, n_shards=2, seed=3)
    rows = req.collect()
    assert len(rows) == 3 * 3 and {r.question for r in rows} == {"q1", "q2", "q3"}
    log = scratch_path(spark, "partials-log")
    recs = [Row(task_idx=r.task_idx, task_id=r.task_id, outputs=[f"{r.task_id}-{r.copy_no}-a", f"{r.task_id}-{r.copy_no}-b"],
                gen_mode="chat", temperature=0.2, max_new_tokens=64, tstamp=0.0, model_id="m", request_id=None,
                inputs=None, raw_outputs=None, ord=r.copy_no) for r in rows]
    df = spark.createDataFrame(recs, schema=files_schema())
    df.write.mode("append").json(log)
    df.write.mode("append").json(log)          # a re-appending writer duplicates records
    out = reorg_output_file(spark, log, scratch_path(spark, "merged-out"), num_samples=5)
    got = {r.task_id: r.outputs for r in out.collect()}
    assert got["t1"] == ["t1-1-a", "t1-1-b", "t1-2-a", "t1-2-b", "t1-3-a"]


def files_schema():
    from evalspark.sources.files import generations_schema
    return generations_schema()


def test_coverage_xml_files(spark):
    import os
    from evalspark.operators.coverage import load_coverage_xml_files
    from evalspark.session import scratch_path
    d = scratch_path(spark, "cov-xml")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "coverage.xml"), "w") as f:
        f.write('<coverage><packages><package name="p"><classes>'
                '<class name="A" filename="A.java"><methods><method name="m"><lines><line number="3" hits="2"/></lines>'
                '</method></methods><lines><line number="3" hits="2"/><line number="4" hits="0"/></lines></class>'
                '<class name="B" filename="B.java"><lines><line number="1" hits="1"/></lines></class>'
                '</classes></package></packages></coverage>')
    got = sorted((r["class"], r.number, r.hit) for r in load_coverage_xml_files(spark, d).collect())
    assert got == [("A", "3", True), ("A", "3", True), ("A", "4", False), ("B", "1", True)]


def test_reference_solution(spark):
    t = spark.createDataFrame([Row(task_idx=0, function="f()", fix="g()")])
    assert smp.reference_solution(t, "complete").first().reference == "f()"
    assert smp.reference_solution(t, "repair").first().reference == "g()"


def test_error_counts_and_compiler_histogram(spark):
    s = spark.createDataFrame([Row(run="a", output=o) for o in ["x", "ERROR", "$ERROR$", "ERROR"]])
    r = smp.error_output_counts(s, ["run"]).first()
    assert (r.samples, r.n_api_error, r.n_runtime_error) == (4, 1, 2)
    steps = spark.createDataFrame([Row(exit_code=1, stderr="A.java:1: error: x\nmore"), Row(exit_code=1, stderr="warn"),
                                   Row(exit_code=0, stderr="A.java:1: error: x")])
    h = {r.first_error: r.steps for r in ver.compiler_error_histogram(steps).collect()}
    assert h == {"A.java:1: error: x": 1, None: 1}


def test_render_chat_prompt_orders_turns_and_keeps_unknown_roles(spark):
    from evalspark.operators.prompts import ChatTemplate, render_chat_prompt
    turns = spark.createDataFrame([(1, 1, "assistant", "hi"), (1, 0, "user", "q"), (1, 2, "tool", "x")],
                                  "conv_id long, turn long, role string, text string")
    got = render_chat_prompt(turns, ChatTemplate(system="S|")).first().prompt
    assert got == "S|USER: q\nASSISTANT: hi\ntool: x\nASSISTANT:"
