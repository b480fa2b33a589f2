"""Lookup joins with a size-checked broadcast.

The reference looks tasks up by position; a missing index is fatal.  Here the
lookup is an equi-join.  The dimension side is broadcast only after its size is
measured (at most ``max_rows`` rows and ``max_bytes`` in all columns); otherwise the planner's shuffle join (and AQE's runtime re-plan) is
used.  Missing keys fail the job from inside the plan, without a second pass.

The measurement executes the dimension's plan once, so it is meant for dimension tables (a scan plus projections), not for derived aggregates;
two aggregates on the same key are joined co-partitioned instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 2_000_000
DEFAULT_MAX_BYTES = 256 * 1024 * 1024


def row_bytes(df: DataFrame):
    """Size of a row: 16 bytes per column, and what its variable-width columns hold (nested ones as text)."""
    size = F.lit(16 * len(df.columns))
    for c, t in df.dtypes:
        if t in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(c)), F.lit(0))
        elif t.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(c)))), F.lit(0))
    return size.cast("long")


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS,
                   max_bytes: int = DEFAULT_MAX_BYTES) -> bool:
    """Rows and bytes of the whole dimension, by one plain aggregate (combined before its shuffle)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def lookup_join(facts: DataFrame, dim: DataFrame, on: list[str] | str, how: str = "inner",
                max_rows: int = DEFAULT_MAX_ROWS, max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    right = F.broadcast(dim) if fits_broadcast(dim, max_rows, max_bytes) else dim
    return facts.join(right, on, how)


def require_present(df: DataFrame, marker: str, message: str) -> DataFrame:
    """Fail the job on any row whose ``marker`` column is NULL; drop the marker."""
    check = F.assert_true(F.col(marker).isNotNull(), F.lit(message))
    return df.filter(check.isNull()).drop(marker)


def strict_lookup(facts: DataFrame, dim: DataFrame, key: str, message: str | None = None,
                  **kw) -> DataFrame:
    """Left join on ``key`` that fails when a fact has no dimension row."""
    dim = dim.withColumn("__present", F.lit(True))
    j = lookup_join(facts, dim, key, "left", **kw)
    return require_present(j, "__present", message or f"{key} not found in lookup table")
