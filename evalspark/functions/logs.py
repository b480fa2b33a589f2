"""Run-log facts: test outcome, coverage summary, first compiler error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import WS_CLASS, WS_CLASS_NO_NL, py_strip

# The log lines the bug-corpus tool prints.
TESTS_OK_LINE = "Failing tests: 0"
LINE_COVERAGE_LABEL = "Line coverage:"
CONDITION_COVERAGE_LABEL = "Condition coverage:"

# A compiler error line: ":" whitespace "error:" whitespace.  The second
# whitespace may be the line's own newline.
COMPILER_ERROR_RE = "[^\n]*:[" + WS_CLASS_NO_NL + "]error:[" + WS_CLASS + "][^\n]*"


def line_from_end(lines: Column, k: int) -> Column:
    """The k-th line from the end, NULL when the log is shorter.

    (A guarded ``element_at``: ``try_element_at`` with a negative index
    drops out of generated code in this Spark version.)
    """
    return F.when(F.size(lines) >= k, F.element_at(lines, -k))


def tests_ok(stdout_lines: Column) -> Column:
    """Non-empty log whose last line is exactly the zero-failures line."""
    return F.coalesce(line_from_end(stdout_lines, 1) == TESTS_OK_LINE, F.lit(False))


def tests_ok_text(stdout: Column) -> Column:
    """Raw-text form: the log's last line is exactly ``Failing tests: 0``
    followed by its newline (a final line without newline does not count)."""
    line = TESTS_OK_LINE + "\n"
    return F.coalesce((stdout == line) | stdout.endswith("\n" + line), F.lit(False))


def coverage_value(line: Column, label: str) -> Column:
    """Percentage after the last ``:`` of a line holding ``label``, as a fraction."""
    raw = F.replace(py_strip(F.regexp_extract(line, "[^:]*$", 0)), F.lit("%"), F.lit(""))
    value = F.try_divide(raw.try_cast("double"), F.lit(100.0))
    return F.when(F.instr(line, label) > 0, F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))


def parse_coverage_summary(stdout_lines: Column) -> Column:
    """``struct(line_coverage, condition_coverage)`` from the last two lines.

    Missing lines give 0.
    """
    second_last = line_from_end(stdout_lines, 2)
    last = line_from_end(stdout_lines, 1)
    return F.struct(
        F.coalesce(coverage_value(second_last, LINE_COVERAGE_LABEL), F.lit(0.0)).alias("line_coverage"),
        F.coalesce(coverage_value(last, CONDITION_COVERAGE_LABEL), F.lit(0.0)).alias("condition_coverage"),
    )


def first_compiler_error(stderr: Column) -> Column:
    """First stderr line that looks like ``File.java:3: error: ...`` (NULL if none)."""
    hit = F.regexp_extract(stderr, COMPILER_ERROR_RE, 0)
    return F.nullif(F.substring_index(hit, "\n", 1), F.lit(""))
