"""The unbiased pass@k estimator as a Column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD = 64                    # factors that are multiplied; beyond, the closed form


def _stirling_rest(x: Column) -> Column:
    """What Stirling's formula adds to ``(x - 1/2) ln x - x`` for the log of gamma, from ``x = 16`` on below 1e-12."""
    r = 1 / x
    return r / 12 - r * r * r / 360 + r * r * r * r * r / 1260


def _log_product(low: Column, n: Column, k: Column) -> Column:
    """Log of ``prod_{i=low..n} (1 - k/i)`` as four log-gammas, their large terms cancelled on paper.

    ``ln G(n+1-k) - ln G(n+1) - ln G(low-k) + ln G(low)``; needs ``low - k`` of ``HEAD`` or more."""
    def shifted(x: Column) -> Column:
        return (x - k - 0.5) * F.log1p(-k / x) + _stirling_rest(x - k) - _stirling_rest(x)

    top = n + 1.0
    return shifted(top) - shifted(low) - k * F.log1p((top - low) / low)


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """``1 - prod_{i=n-c+1..n} (1 - k/i)``, 1 when ``n - c < k``.

    ``k`` may be fractional (token budgets).  The first ``HEAD`` factors are
    multiplied, the others go through log-gamma, so a cell costs the same for
    any number of samples.  ``c = 0`` is guarded: the product over an empty
    range is 1, but ``sequence(n+1, n)`` would count down.
    """
    low = n - c + 1
    head = F.aggregate(F.sequence(low, F.least(n, low + (HEAD - 1))), F.lit(1.0),
                       lambda acc, i: acc * (F.lit(1.0) - k / i))
    rest = F.when(c > HEAD, F.exp(_log_product((low + HEAD).cast("double"), n.cast("double"), k.cast("double")))).otherwise(F.lit(1.0))
    return (F.when(n - c < k, F.lit(1.0))
            .when(c == 0, F.lit(0.0))
            .otherwise(F.lit(1.0) - reduce(lambda a, b: a * b, [head, rest])))
