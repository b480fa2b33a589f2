"""Plain-Python statements of the rules, for brute-force checks on small inputs."""

import math
import re
from itertools import accumulate


def first_close(s: str) -> int | None:
    """Where the braces outside quotes are first balanced again, from running sums over the characters."""
    quotes = accumulate(ch == '"' for ch in s)
    steps = [0 if n % 2 else (ch == "{") - (ch == "}") for ch, n in zip(s, quotes)]
    opened = accumulate(step == 1 for step in steps)
    return next((i for i, (depth, n) in enumerate(zip(accumulate(steps), opened)) if n and depth == 0), None)


def stop_at_function(s: str) -> str:
    end = first_close(s)
    return s if end is None else s[:end + 1]


_WHOLE = re.compile(r"""\"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|//[^\n]*|/\*.*?\*/""", re.DOTALL)


def screen(s: str) -> bool:
    """Well-formed strings, char literals and comments taken out: the rest opens none, and its braces balance."""
    bare = _WHOLE.sub(" ", s)
    depths = list(accumulate((ch == "{") - (ch == "}") for ch in bare))
    return not re.search(r"[\"']|/\*", bare) and (not depths or depths[-1] == 0 and min(depths) >= 0)


def pass_at_k(n, c, k):
    if n - c < k:
        return 1.0
    p = 1.0
    for i in range(n - c + 1, n + 1):
        p *= 1.0 - k / i
    return 1.0 - p


def pass_at_k_binomial(n, c, k):
    return 1.0 - math.comb(n - c, k) / math.comb(n, k)
