"""Request and sample plumbing: ranges, expansion, flattening, merge, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.text import py_strip
from evalspark.operators.joins import strict_lookup

# In-band failure outputs (API after all retries; batch runtime error).
ERROR_OUTPUTS = ["$ERROR$", "ERROR"]


def filter_generate_range(df: DataFrame, begin: int = -1, end: int = -1, idx: str = "task_idx") -> DataFrame:
    """Half-open ``begin <= idx < end``; a negative bound is ignored."""
    if begin >= 0:
        df = df.filter(F.col(idx) >= begin)
    if end >= 0:
        df = df.filter(F.col(idx) < end)
    return df


def filter_evaluate_range(df: DataFrame, begin: int = -1, end: int = -1, idx: str = "task_idx") -> DataFrame:
    """Closed ``begin <= idx <= end``; a negative bound is ignored."""
    if begin >= 0:
        df = df.filter(F.col(idx) >= begin)
    if end >= 0:
        df = df.filter(F.col(idx) <= end)
    return df


def copies_per_task(num_samples: int, batch_size: int | None = None) -> int:
    if not batch_size:
        return num_samples
    return -(-num_samples // batch_size)


def select_prompt(tasks: DataFrame, mode: str) -> DataFrame:
    """``prompt_complete`` or ``prompt_chat`` by mode, stripped like ``str.strip``."""
    if mode == "complete":
        col = "prompt_complete"
    elif mode == "chat":
        col = "prompt_chat"
    else:
        raise KeyError(mode)
    return tasks.withColumn("prompt", py_strip(F.col(col)))


def reference_solution(tasks: DataFrame, suite_name: str) -> DataFrame:
    """``task_idx`` and the suite's reference solution (``function`` or ``fix``)."""
    from evalspark.suites import get_suite
    col = get_suite(suite_name).reference_col
    return tasks.select("task_idx", F.col(col).alias("reference"))


def expand_requests(tasks: DataFrame, num_samples: int, batch_size: int | None = None) -> DataFrame:
    """One request row per copy: ``num_samples`` copies, or ``ceil(num/batch)``."""
    n_copy = copies_per_task(num_samples, batch_size)
    return tasks.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.lit(n_copy))))


def flatten_samples(generations: DataFrame, outputs: str = "outputs") -> DataFrame:
    """One row per (task, output); ``sample_idx`` is the 0-based array position."""
    rest = [c for c in generations.columns if c != outputs]
    return generations.select(*rest, F.posexplode(outputs).alias("sample_idx", "output"))


def first_n_samples(samples: DataFrame, n: int | None, part: str | list[str] = "task_idx",
                    order: str = "sample_idx") -> DataFrame:
    """Keep the first ``n`` samples of each task (no cut when ``n`` is falsy).

    ``row_number() <= n`` lets Spark place a partial group limit before the
    shuffle, so a hot task ships at most ``n`` rows per map partition.
    """
    if not n:
        return samples
    w = Window.partitionBy(part).orderBy(order)
    return samples.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def first_n_distinct(samples: DataFrame, n: int, keys: list[str], order: str) -> DataFrame:
    """The first ``n`` requests of each key, a request that came twice (equal key and ``order``) once.

    ``dense_rank() <= n`` is cut before the shuffle; repeats are then dropped
    inside the same partitioning, so rows are shuffled once.
    """
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(order))
    cut = samples.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")
    again = F.row_number().over(Window.partitionBy(*keys, order).orderBy(*[c for c in samples.columns if c not in (*keys, order)] or [order]))
    return cut.withColumn("__again", again).filter(F.col("__again") == 1).drop("__again")


def first_n_outputs(generations: DataFrame, n: int | None, outputs: str = "outputs") -> DataFrame:
    """Array form of :func:`first_n_samples`."""
    if not n:
        return generations
    return generations.withColumn(outputs, F.slice(outputs, 1, n))


def flag_error_outputs(samples: DataFrame, output: str = "output") -> DataFrame:
    return samples.withColumn("is_error", F.col(output).isin(*ERROR_OUTPUTS))


def error_output_counts(samples: DataFrame, by: list[str], output: str = "output") -> DataFrame:
    """Per run (``by``): samples, and samples holding each in-band failure value."""
    o = F.col(output)
    return samples.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"),
                                    F.count_if(o == "$ERROR$").alias("n_api_error"),
                                    F.count_if(o == "ERROR").alias("n_runtime_error"))


def attach_task(samples: DataFrame, tasks: DataFrame, columns: list[str], key: str = "task_idx") -> DataFrame:
    """Task columns looked up by index; a missing index fails the job."""
    dim = tasks.select(key, *columns)
    return strict_lookup(samples, dim, key, f"sample refers to a {key} missing from the task table")


def attach_prompt(samples: DataFrame, tasks: DataFrame, mode: str, key: str = "task_idx") -> DataFrame:
    """The stripped prompt, once per sample (the source of per-sample input tokens)."""
    dim = select_prompt(tasks, mode).select(key, F.col("prompt").alias("input"))
    return strict_lookup(samples, dim, key, f"sample refers to a {key} missing from the task table")


def merge_partials(partials: DataFrame, num_samples: int, key: str | list[str] = "task_id", order: str = "ord",
                   output: str = "output", keep_first: list[str] | None = None, sep: str | None = None) -> DataFrame:
    """Concatenate outputs per task in arrival order, cut to ``num_samples``.

    Scalar fields come from the first record.  The cut is applied before the
    collect (partial group limit before the shuffle), so every array holds at
    most ``num_samples`` outputs however hot a task is; it must be given.
    """
    if not num_samples or num_samples < 1:
        raise ValueError("num_samples bounds the outputs of a task and must be positive")
    keep_first = keep_first or []
    keys = [key] if isinstance(key, str) else list(key)
    cut = first_n_samples(partials, num_samples, part=keys, order=order)
    # Scalar fields ride in the sorted list (object hash aggregate, no
    # variable-width aggregation buffer, no sort of the input rows).
    merged = cut.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, output, *keep_first))).alias("__o"))
    outs = F.transform("__o", lambda x: x[output])
    merged = merged.select(*keys, *[F.col("__o")[0][c].alias(c) for c in keep_first], outs.alias("outputs"),
                           F.size("__o").alias("n_outputs"))
    if sep is not None:
        merged = merged.withColumn("outputs", F.array_join("outputs", sep))
    return merged


def order_by_task(df: DataFrame, key: str = "task_id") -> DataFrame:
    """Total order by task (range-partitioned sort)."""
    return df.orderBy(key)


RANK_BLOCKS = 4096           # blocks of hashes whose sizes give the offsets of the ranks


def shard_requests(requests: DataFrame, n_shards: int, seed: int,
                   keys: tuple[str, ...] = ("task_idx", "copy_no")) -> DataFrame:
    """Shards of equal size (they differ by one row at most), reproducible and in no order of the keys.

    Requests are ranked by a hash and dealt in turn.  No task sees all rows:
    the first bits of the hash cut the order into ``RANK_BLOCKS`` blocks of
    about equal size, a window ranks within a block, and the sizes of the blocks
    before it (a table of ``RANK_BLOCKS`` rows) are added.  Nothing is padded or
    dropped; equal requests are dealt in any order.
    """
    parts = [F.lit(str(seed))]
    for k in keys:
        parts += [F.lit("-"), F.col(k).cast("string")]
    digest = F.md5(F.concat(*parts))
    block = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")
    dealt = requests.withColumn("__digest", digest).withColumn("__block", block)
    sizes = dealt.groupBy("__block").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__block", F.coalesce(before, F.lit(0)).alias("__offset"))
    rank = F.row_number().over(Window.partitionBy("__block").orderBy("__digest", *keys))
    ranked = dealt.withColumn("__rank", rank).join(F.broadcast(offsets), "__block")      # at most RANK_BLOCKS rows
    return ranked.withColumn("shard_id", F.pmod(F.col("__offset") + F.col("__rank") - 1, F.lit(n_shards)).cast("int")).select(
        *requests.columns, "shard_id")
