"""Defect-detection answer handling: truncation and label cascade."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Truncation markers, checked in this order (every defect
# marker before every no-defect marker).
TRUNCATE_DEFECT_MARKERS = ["Yes, it has defect", "Yes", "has defect", "has defect"]
TRUNCATE_NO_DEFECT_MARKERS = ["No, it doesn't have defects", "No",
                              "doesn't have defect", "do not have defect",
                              "do not has defect", "doesn't has defect"]

# The label cascade, checked in this order.  Patterns are
# written as in the original rules; "." never crosses a newline.
DEFECT_PHRASES = [
    "Yes, it has defect", "Yes", "has defect", "has defect", "there are potential defects",
    "is potentially flawed",
    "There are defects",
    "There are several issue",
    "there is a potential defect",
]
DEFECT_PATTERNS = [
    r"here.*?potential issue",
    r"here.*?potential defect",
    r"There.*?a few issue",
    r"there.*?a few issue",
]
NO_DEFECT_PHRASES = [
    "no defects", "No, it doesn't have defects", "No", "doesn't have defect",
    "do not have defect", "do not has defect", "this function is not flawed",
]
NO_DEFECT_PATTERNS = [
    "doesn't has defect",
    r"here are no.*?defect",
    r"do not see.*?defect",
    r"don't see.*?defect",
]

# The verdict sentences a streamed answer stops on.
STREAM_STOP_MARKERS = ["Yes, it has defects", "No, it doesn't have defects"]

DEFECT, NO_DEFECT, ERROR = "defect", "nodefect", "error"


def portable_pattern(pattern: str) -> str:
    """Rewrite ``.`` (any character but newline) so Java, RE2 and Python agree.

    Java's ``.`` also refuses ``\\r`` and some Unicode separators; an explicit
    class does not.
    """
    return pattern.replace(".", "[^\n]")


def pattern_holds(text: Column, pattern: str) -> Column:
    """``rlike`` guarded by the pattern's literal tail.

    A pattern ``a.*?b`` can only match where ``b`` occurs, so a cheap
    substring test skips the regex for most texts; the result is unchanged.
    """
    tail = pattern.split(".*?")[-1]
    regex = text.rlike(portable_pattern(pattern))
    if tail and not any(ch in tail for ch in ".*?+()[]{}|^$\\"):
        return (F.instr(text, tail) > 0) & regex
    return regex


def truncate_defect_answer(text: Column) -> Column:
    """Keep the text through the first occurrence of the first marker that occurs."""
    out = text
    for m in reversed(TRUNCATE_DEFECT_MARKERS + TRUNCATE_NO_DEFECT_MARKERS):
        pos = F.instr(text, m)
        out = F.when(pos > 0, F.concat(F.substring(text, F.lit(1), pos - 1), F.lit(m))).otherwise(out)
    return out


def classify_defect_answer(text: Column) -> Column:
    """``defect`` / ``nodefect`` / ``error`` by the ordered cascade."""
    rules = ([(F.instr(text, s) > 0, DEFECT) for s in DEFECT_PHRASES]
             + [(pattern_holds(text, p), DEFECT) for p in DEFECT_PATTERNS]
             + [(F.instr(text, s) > 0, NO_DEFECT) for s in NO_DEFECT_PHRASES]
             + [(pattern_holds(text, p), NO_DEFECT) for p in NO_DEFECT_PATTERNS])
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for cond, label in rules[1:]:
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(ERROR))
