"""End-to-end scoring of selected samples, the issue suite from facts, merges without loss, malformed input."""

import json

import pytest
from pyspark.sql import functions as F

from evalspark.operators import coverage, joins, samples
from evalspark.plans.evaluate import run_evaluate, verdicts_from_facts
from evalspark.plans.generation import reorg_output_file
from evalspark.sources import files


def _tasks(spark, n):
    rows = [(i, f"t{i}", "p ", "q", "p", "int f(int a)") for i in range(n)]
    return spark.createDataFrame(rows, "task_idx int, task_id string, prompt_complete string, prompt_chat string, "
                                       "prompt_complete_with_comment string, function_signature string")


def _verdicts(spark, rows):
    return spark.createDataFrame(rows, "task_idx int, sample_idx int, pass_syntax boolean, pass_compile boolean, "
                                       "pass_trigger boolean, pass_all boolean, timed_out boolean")


def test_only_selected_samples_are_scored(spark):
    gens = spark.createDataFrame([(t, f"t{t}", ["a b", "c", "d", "e"]) for t in range(3)], "task_idx int, task_id string, outputs array<string>")
    verdicts = _verdicts(spark, [(t, s, True, True, s >= 2, False, False) for t in range(3) for s in range(4)])
    for form in (gens, gens.select("task_idx", F.posexplode("outputs").alias("sample_idx", "output"))):
        rep = run_evaluate(spark, "complete", _tasks(spark, 3), form, "complete", 0, 0, 2, verdicts=verdicts)
        counts = rep.task_counts.collect()
        assert [(r["task_idx"], r["total"], r["c_trigger"]) for r in counts] == [(0, 2, 0)]
        at_1 = rep.suite_metrics.filter("flag = 'pass_trigger' AND metric = 'pass@k' AND param = 1").collect()
        assert all(r["value"] == 0.0 for r in at_1)


def test_tokens_and_verdicts_share_a_population(spark):
    gens = spark.createDataFrame([(0, 0, "a b c"), (0, 1, "d e f g h")], "task_idx int, sample_idx int, output string")
    one = _verdicts(spark, [(0, 0, True, True, True, True, False), (7, 0, True, True, True, True, False)])
    both = run_evaluate(spark, "complete", _tasks(spark, 1), gens, "complete", verdicts=one).task_counts.collect()
    assert len(both) == 1 and both[0]["total"] == 1
    alone = run_evaluate(spark, "complete", _tasks(spark, 1), gens.filter("sample_idx = 0"), "complete", verdicts=one).task_counts.collect()
    assert both[0]["total_tokens"] == alone[0]["total_tokens"]


def test_samples_without_facts_fail(spark):
    gens = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "task_idx int, sample_idx int, output string")
    steps = spark.createDataFrame([(0, 0, 0, "trigger", 0, False, ["Failing tests: 0"], True)],
                                  "task_idx int, sample_idx int, step_no int, kind string, exit_code int, timed_out boolean, "
                                  "stdout_lines array<string>, syntax_ok boolean")
    with pytest.raises(Exception, match="no verdict"):
        run_evaluate(spark, "complete", _tasks(spark, 1), gens, "complete", run_steps=steps).task_counts.collect()


def _issue_steps(spark, rows):
    return spark.createDataFrame(rows, "task_idx int, sample_idx int, version string, step_no int, kind string, exit_code int, "
                                       "timed_out boolean, stdout_lines array<string>, syntax_ok boolean")


OK, BAD, COV = ["Failing tests: 0"], ["Failing tests: 1"], ["Line coverage: 50.0%", "Condition coverage: 25.0%"]


def test_issue_suite_from_facts(spark):
    rows = [
        (0, 0, "fixed", 1, "test", 0, False, OK, True), (0, 0, "fixed", 2, "coverage", 0, False, COV, True), (0, 0, "buggy", 3, "test", 0, False, BAD, True),
        (0, 1, "fixed", 1, "test", 0, False, OK, True), (0, 1, "fixed", 2, "coverage", 0, True, COV, True), (0, 1, "buggy", 3, "test", 0, False, BAD, True),
        (0, 2, "fixed", 1, "test", 0, False, OK, False), (0, 2, "fixed", 2, "coverage", 0, False, COV, False), (0, 2, "buggy", 3, "test", 0, False, BAD, False),
        (0, 3, "fixed", 1, "test", 0, False, OK, True), (0, 3, "fixed", 2, "coverage", 0, False, COV, True), (0, 3, "buggy", 3, "test", 0, False, OK, True),
    ]
    got = {r["sample_idx"]: r for r in verdicts_from_facts("testgenissue", _issue_steps(spark, rows)).collect()}
    assert got[0]["pass_trigger"] and (got[0]["line_coverage"], got[0]["condition_coverage"]) == (0.5, 0.25)
    assert not got[1]["pass_trigger"] and not got[1]["timed_out"]          # only the coverage step timed out
    assert not got[2]["pass_syntax"] and not got[2]["pass_trigger"]
    assert not got[3]["pass_trigger"] and got[3]["pass_compile"]           # the buggy version passes


def test_issue_suite_needs_both_runs(spark):
    rows = [(0, 0, "fixed", 1, "test", 0, False, OK, True), (0, 0, "fixed", 2, "coverage", 0, False, COV, True)]
    with pytest.raises(Exception, match="buggy"):
        verdicts_from_facts("testgenissue", _issue_steps(spark, rows)).collect()


def test_merge_keeps_every_record_of_every_run(spark, tmp_path):
    lines = [{"task_id": "t0", "task_idx": 0, "outputs": [f"m{m}r{r}"], "model_id": f"m{m}", "gen_mode": "chat", "tstamp": float(r)}
             for m in range(2) for r in range(4)]
    lines += [{"task_id": "t1", "task_idx": 1, "outputs": ["x", "y"], "model_id": "m0", "gen_mode": "chat", "tstamp": t, "request_id": "q"} for t in (2.0, 1.0)]
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text("\n".join(map(json.dumps, lines)))
    got = {(r["model_id"], r["task_id"]): r["outputs"] for r in reorg_output_file(spark, str(log), str(tmp_path / "out"), 100).collect()}
    assert got == {("m0", "t0"): [f"m0r{r}" for r in range(4)], ("m1", "t0"): [f"m1r{r}" for r in range(4)], ("m0", "t1"): ["x", "y"]}
    cut = reorg_output_file(spark, str(log), str(tmp_path / "cut"), 3).collect()
    assert sorted(len(r["outputs"]) for r in cut) == [2, 3, 3]


def test_merge_needs_a_bound(spark):
    with pytest.raises(ValueError):
        samples.merge_partials(spark.createDataFrame([("t", 0, "x")], "task_id string, ord int, output string"), 0)


def test_malformed_input_fails(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"task_id": "t0", "outputs": ["a"]}\n{"task_id": "t1", "outp')
    with pytest.raises(Exception):
        files.load_partials(spark, str(tmp_path / "log.json")).collect()
    with pytest.raises(Exception):
        files.load_generations(spark, str(tmp_path / "log.json"), multi_line=False).collect()
    broken = spark.createDataFrame([("<coverage><packages><package name='p'><classes>",)], "xml string")
    with pytest.raises(Exception):
        coverage.coverage_lines_from_xml(broken).collect()


def test_broadcast_check_counts_nested_columns(spark):
    wide = spark.range(10).select("id", F.array(F.repeat(F.lit("x"), 100_000)).alias("a"))
    assert not joins.fits_broadcast(wide, max_bytes=500_000)
    assert joins.fits_broadcast(wide.select("id"), max_bytes=500_000)
