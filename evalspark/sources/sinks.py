"""Writers: partial log, merged generations, post-processed stage, results."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20         # of records that are put in brackets at a time

RUN_KEYS = ("model_id", "bench_name", "gen_mode")


def write_requests(requests: DataFrame, path: str) -> None:
    """Request table, one folder per shard: each serving worker reads only
    its own shard (partition pruning on ``shard_id``)."""
    requests.write.mode("overwrite").partitionBy("shard_id").parquet(path)


def write_partials(df: DataFrame, path: str) -> None:
    """Append finished requests; nothing already written is touched."""
    df.write.mode("append").json(path)


def write_generations(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one array document from its records, a bounded number of bytes at a time and none as a Python object."""
    first, pool = True, pa.default_memory_pool()
    for batch in batches:
        values = batch.column(0)
        ends = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(values):
            taken = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, taken + SLICE_BYTES, side="right")))
            sign = pa.array(["[" if first and i == 0 else "," for i in range(b - a)])
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(sign, values.slice(a, b - a), "")], ["value"])
            first, a = False, b
        del batch, values
        pool.release_unused()
    if not first:
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])


def write_generations_array(df: DataFrame, path: str) -> None:
    """Generations as JSON array documents, one per task of the write: a record a line, brackets and commas around."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])      # executors need not have the package
    lines = df.select(F.to_json(F.struct("*")).alias("value"))
    lines.mapInArrow(_bracketed, "value string").write.mode("overwrite").text(path)


def write_merged(df: DataFrame, path: str, partition_cols: tuple[str, ...] = RUN_KEYS,
                 order: str = "task_id", fmt: str = "parquet") -> None:
    """Merged generations, one folder per run, task-ordered inside each file.

    No repartition on the run keys (a hot run would land in one task); each
    task writes its rows sorted, and readers prune folders by run key.
    """
    cols = [c for c in partition_cols if c in df.columns]
    out = df.sortWithinPartitions(*cols, order)
    out.write.mode("overwrite").partitionBy(*cols).format(fmt).save(path)


def write_postprocessed(df: DataFrame, path: str) -> None:
    """Post-processed samples: the replayable stage between cleanup and scoring."""
    df.write.mode("overwrite").parquet(path)


def write_results(metrics: DataFrame, path: str, run_keys: list[str], timing: dict | None = None) -> DataFrame:
    """Long metrics table partitioned by run, plus one JSON document per run.

    The document nests ``flag -> metric@param -> value``; timing values come
    from the driver (``time_cost``, ``end_time``).
    """
    timing = timing or {}
    m = metrics
    for k, v in timing.items():
        m = m.withColumn(k, F.lit(v))
    m.write.mode("overwrite").partitionBy(*run_keys).parquet(f"{path}/metrics")
    entry = F.struct("flag", "metric", "param", "n_tasks", "value")
    doc = (metrics.groupBy(*run_keys)
           .agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("metrics"),
                                   *[F.lit(v).alias(k) for k, v in timing.items()])).alias("document")))
    doc.write.mode("overwrite").partitionBy(*run_keys).json(f"{path}/documents")
    return doc


def results_document(suite_metrics: DataFrame, solved: DataFrame, run_keys: list[str],
                     flags: list[str], timing: dict | None = None,
                     scalars: DataFrame | None = None) -> DataFrame:
    """One JSON document per run, shaped like the original report:
    ``{"total", "timed_out", "<flag>": {"count", "pass@k-1", "pass@t-1000", ...}}``.

    Built from the suite-level tables (a few dozen rows per run), so the
    per-run collect is bounded by the metric grid; per-task details stay in
    their own table.
    """
    timing = timing or {}
    name = F.concat(F.col("metric"), F.lit("-"), F.col("param").cast("long").cast("string"))
    per_flag = (suite_metrics.groupBy(*run_keys, "flag")
                .agg(F.map_from_entries(F.collect_list(F.struct(name, F.col("value")))).alias("m")))
    per_run = per_flag.groupBy(*run_keys).agg(F.map_from_entries(F.collect_list(F.struct("flag", "m"))).alias("mm"))
    doc = solved.join(per_run, run_keys, "left") if run_keys else solved.crossJoin(per_run)
    extra_cols = []
    if scalars is not None:      # per-run scalar values, e.g. coverage means
        doc = doc.join(scalars, run_keys, "left") if run_keys else doc.crossJoin(scalars)
        extra_cols = [c for c in scalars.columns if c not in run_keys]
    fields = [F.col("total"), F.col("timed_out")] + [F.col(c) for c in extra_cols]
    for f in flags:
        short = f.removeprefix("pass_")
        entry = F.map_concat(F.create_map(F.lit("count"), F.col(f"solved_{short}").cast("double")),
                             F.coalesce(F.col("mm")[f], F.create_map().cast("map<string,double>")))
        fields.append(entry.alias(f))
    fields += [F.lit(v).alias(k) for k, v in timing.items()]
    return doc.select(*run_keys, F.to_json(F.struct(*fields)).alias("document"))
