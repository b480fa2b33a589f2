"""Declared schemas for every table the engine reads.  No inference."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


# Union of the task fields the suites read; each suite uses a subset.
TASKS = T.StructType([
    _f("task_idx", I, False), _f("task_id", S), _f("prompt_complete", S), _f("prompt_chat", S),
    _f("prompt_complete_with_comment", S), _f("prompt_complete_without_signature", S),
    _f("function_signature", S), _f("function", S), _f("fix", S),
    _f("project", S), _f("bug_id", I), _f("testmethods", T.ArrayType(S)), _f("testmethod", S),
    _f("source_dir", S), _f("location", S), _f("source", S), _f("start", I), _f("end", I),
    _f("start_fixed", I), _f("end_fixed", I), _f("start_buggy", I), _f("end_buggy", I),
    _f("location_fixed", S), _f("location_buggy", S), _f("source_fixed", S), _f("source_buggy", S),
    _f("classmethods", T.ArrayType(T.StructType([_f("be_test_class_name", S)]))),
    _f("classes_modified", T.ArrayType(S)), _f("defective", B),
])

# One record per finished request (partials) or per task (merged file).
GENERATIONS = T.StructType([
    _f("task_idx", I), _f("task_id", S), _f("outputs", T.ArrayType(S)), _f("gen_mode", S),
    _f("temperature", D), _f("max_new_tokens", I), _f("tstamp", D), _f("model_id", S),
    _f("request_id", S), _f("inputs", T.ArrayType(S)), _f("raw_outputs", T.ArrayType(S)),
])

# Observable facts of one execution step (replaces running the process).
RUN_STEPS = T.StructType([
    _f("task_idx", I), _f("sample_idx", I), _f("version", S), _f("step_no", I), _f("kind", S),
    _f("exit_code", I), _f("timed_out", B), _f("stdout_lines", T.ArrayType(S)),
    _f("stderr_lines", T.ArrayType(S)), _f("syntax_ok", B),
])

COVERAGE_LINE = T.StructType([_f("class", S), _f("file", S), _f("number", S), _f("hit", B)])

# Cobertura-style report, as parsed by from_xml (attributes carry "_").
_LINES = T.StructType([_f("line", T.ArrayType(T.StructType([_f("_number", S), _f("_hits", S)])))])
COVERAGE_XML = T.StructType([
    _f("packages", T.StructType([_f("package", T.ArrayType(T.StructType([
        _f("_name", S),
        _f("classes", T.StructType([_f("class", T.ArrayType(T.StructType([
            _f("_name", S), _f("_filename", S),
            _f("methods", T.StructType([_f("method", T.ArrayType(T.StructType([
                _f("_name", S), _f("lines", _LINES)])))])),
            _f("lines", _LINES),
        ])))])),
    ])))])),
])

VERDICT_FLAGS = ["pass_syntax", "pass_compile", "pass_trigger", "pass_all"]
TEST_VERDICT_FLAGS = ["pass_syntax", "pass_compile", "pass_trigger"]
