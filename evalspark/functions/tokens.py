"""Token counting and prompt truncation.

The built-in counter is a regex pre-tokenizer (letter/digit runs, every other
non-space character on its own), evaluated natively.  A column of counts from
another tokenizer can take its place wherever counts are summed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import WS_CLASS

TOKEN_RE = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}" + WS_CLASS + "]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_RE), 0)


def count_tokens(text: Column) -> Column:
    """Number of pre-tokens (Spark plans it as the size of the array of matches)."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_RE)), F.lit(0))


def truncate_prompt_tokens(toks: Column, max_tokens: int, mode: str) -> Column:
    """Over-long prompts: complete mode keeps the last ``max_tokens``, chat the first."""
    if mode == "complete":
        start = F.greatest(F.size(toks) - max_tokens, F.lit(0)) + 1
        return F.slice(toks, start, F.lit(max_tokens))
    if mode == "chat":
        return F.slice(toks, F.lit(1), F.lit(max_tokens))
    raise KeyError(mode)


def gaps(text: Column) -> Column:
    """What stands before, between and behind the tokens: one more than there are tokens."""
    return F.split(text, TOKEN_RE, -1)


def _length_of(pieces: Column, n: Column) -> Column:
    """Code points of the first ``n`` pieces."""
    return F.aggregate(F.slice(pieces, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))


def truncate_prompt(text: Column, toks: Column, between: Column, max_tokens: int, mode: str) -> Column:
    """The kept piece of an over-long prompt, cut from the text itself: complete mode keeps the last ``max_tokens``
    tokens and what follows them, chat mode the first ones.  ``toks`` and ``between`` are columns of
    :func:`tokens` and :func:`gaps`; token offsets are sums of the lengths before them."""
    n = F.size(toks)
    if mode == "complete":
        start = _length_of(between, n - max_tokens + 1) + _length_of(toks, n - max_tokens)
        kept = F.substring(text, start + 1, F.length(text))
    elif mode == "chat":
        kept = F.substring(text, F.lit(1), _length_of(between, F.lit(max_tokens)) + _length_of(toks, F.lit(max_tokens)))
    else:
        raise KeyError(mode)
    return F.when(n > max_tokens, kept).otherwise(text)
