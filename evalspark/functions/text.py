"""Text post-processing as native Column expressions (no Python UDFs).

Every function takes and returns ``pyspark.sql.Column`` objects, so the work
stays in the JVM inside whole-stage codegen (or interpreted higher-order
functions for the array forms).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.braces import stop_at_function

# The characters Python's str.strip() removes (str.isspace()),
# in code-point order.  Spark's plain trim() only removes spaces.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as a regex character-class body; \x{..} escapes are read
# identically by Java regexes and RE2.
WS_CLASS = "".join("\\x{%x}" % ord(c) for c in PY_WHITESPACE)
WS_CLASS_NO_NL = "".join("\\x{%x}" % ord(c) for c in PY_WHITESPACE if c != "\n")

# Fixed value: the prefix used when a chat answer lacks the target function.
MISSING_FUNCTION_PREFIX = "Can not find target function in answer!\n\n"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove every whitespace character at both ends."""
    return F.trim(c, F.lit(PY_WHITESPACE))


def strip_line_comments(sig: Column) -> Column:
    """Drop ``//`` up to and including the end of line (lines get joined)."""
    return F.regexp_replace(sig, F.lit("//[^\n]*(\n|$)"), F.lit(""))


def clean_signature(sig: Column) -> Column:
    """Split a signature into ``struct(pre, sub)`` after removing line comments.

    Annotated (``@...``): ``pre`` is the text before the first blank or
    newline plus a newline, ``sub`` the stripped rest cut at the first ``(``.
    Otherwise ``pre`` is empty and ``sub`` the unstripped text before ``(``.
    """
    s = strip_line_comments(sig)
    sp = F.instr(s, " ")
    nl = F.instr(s, "\n")
    first_blank = F.least(F.when(sp > 0, sp), F.when(nl > 0, nl))
    # 0-based index where the annotation ends; without any blank the scan
    # ends on the last character, which therefore moves into ``sub``.
    cut = F.coalesce(first_blank - 1, F.length(s) - 1)
    annotated = s.startswith("@")
    pre = F.when(annotated, F.concat(F.substring(s, F.lit(1), cut), F.lit("\n"))).otherwise(F.lit(""))
    rest = F.substring(s, cut + 1, F.length(s))
    sub = F.when(annotated, py_strip(F.split_part(py_strip(rest), F.lit("("), F.lit(1)))) \
        .otherwise(F.split_part(s, F.lit("("), F.lit(1)))
    return F.struct(pre.alias("pre"), sub.alias("sub"))


def drop_prompt_prefix(output: Column, prefix: Column) -> Column:
    """Remove the first ``length(prefix)`` characters, unchecked."""
    return F.substring(output, F.length(prefix) + 1, F.greatest(F.length(output), F.lit(0)) + 1)


def extract_chat_function(answer: Column, sig: Column, strip_sig: bool) -> Column:
    """Cut the target function out of a chat answer.

    Text between the first and second occurrence of the cleaned signature is
    closed with :func:`stop_at_function` and prefixed by ``pre + sub``.  An
    answer without the signature is returned behind a marker line.  An empty
    cleaned signature has no defined result (NULL).
    """
    s = py_strip(sig) if strip_sig else sig
    parts = clean_signature(s)
    pre, sub = parts["pre"], parts["sub"]
    found = F.instr(answer, sub) > 0
    body = stop_at_function(F.split_part(answer, sub, F.lit(2)))
    return (F.when(F.length(sub) == 0, F.lit(None).cast("string"))
            .when(found, F.concat(pre, sub, body))
            .otherwise(F.concat(F.lit(MISSING_FUNCTION_PREFIX), answer)))


def stop_at_stop_token(text: Column, stop_tokens: list[str]) -> Column:
    """Prefix of ``text`` before the earliest occurrence of any stop token."""
    if not stop_tokens:
        return text
    hits = [F.when(F.instr(text, t) > 0, F.instr(text, t)) for t in stop_tokens]
    first = F.least(*hits) if len(hits) > 1 else hits[0]
    return F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1))


def reconstruct_raw_output(output: Column, pure: Column) -> Column:
    """``output`` through the first occurrence of ``pure``; unchanged if absent."""
    pos = F.instr(output, pure)
    return (F.when(F.length(pure) == 0, F.lit(""))
            .when(pos > 0, F.substring(output, F.lit(1), pos - 1 + F.length(pure)))
            .otherwise(output))


def split_lines(text: Column) -> Column:
    """``str.split('\\n')``: every newline separates, trailing empties kept."""
    return F.split(text, F.lit("\n"), -1)


def _py_head(arr: Column, n: Column) -> Column:
    """``arr[:n]`` with Python's meaning of a negative ``n``."""
    size = F.size(arr)
    keep = F.when(n >= 0, n).otherwise(F.greatest(size + n, F.lit(0)))
    return F.slice(arr, F.lit(1), keep)


def _py_tail(arr: Column, k: Column) -> Column:
    """``arr[k:]`` with Python's meaning of a negative ``k``."""
    size = F.size(arr)
    first = F.when(k >= 0, k).otherwise(F.greatest(size + k, F.lit(0))) + 1
    return F.slice(arr, first, F.greatest(size, F.lit(1)))


def splice_patch(source: Column, patch: Column, start: Column, end: Column) -> Column:
    """Replace 0-based inclusive lines ``start..end`` of ``source`` by ``patch``:
    ``lines[:start] + patch_lines + lines[end + 1:]`` with Python slice rules."""
    lines = split_lines(source)
    return F.array_join(F.concat(_py_head(lines, start), split_lines(patch), _py_tail(lines, end + 1)), "\n")


def clean_chat_output(text: Column, stop_str: str | None, special_tokens: list[str],
                      drop_assistant_prefix: bool = False) -> Column:
    """Chat output cleanup after decoding.

    Cut at ``stop_str`` only when it occurs after the first character, delete
    every special token, strip, and for one template drop one leading
    ``Assistant:``.
    """
    t = text
    if stop_str:
        pos = F.instr(t, stop_str)
        t = F.when(pos > 1, F.substring(t, F.lit(1), pos - 1)).otherwise(t)
    for tok in special_tokens:
        t = F.replace(t, F.lit(tok), F.lit(""))
    t = py_strip(t)
    if drop_assistant_prefix:
        t = F.when(t.startswith("Assistant:"),
                   py_strip(F.substring(t, F.lit(len("Assistant:") + 1), F.length(t) + 1))).otherwise(t)
    return t


def log_lines(text: Column) -> Column:
    """Lines as ``readlines()`` yields them, without terminators.

    An empty log has no lines; a single trailing newline ends the last line
    instead of opening an empty one.
    """
    trimmed = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(split_lines(trimmed))
