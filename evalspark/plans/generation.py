"""Generation-side data work: request tables and the merge of partial logs.

Model calls are outside Spark; these build the request table a serving
layer consumes (range, prompt, copies, shards) and turn the append-only log
it produces back into task-ordered generations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.operators import samples as smp
from evalspark.sources import files, sinks
from evalspark.suites import get_suite


def build_requests(tasks: DataFrame, suite_name: str, mode: str, num_samples: int, batch_size: int | None = None,
                   begin: int = -1, end: int = -1, n_shards: int = 1, seed: int = 0) -> DataFrame:
    """Half-open task range, stripped prompt by mode, ``n_copy`` copies per task,
    and a reproducible shard per request (write with ``partitionBy('shard_id')``)."""
    get_suite(suite_name)
    t = smp.filter_generate_range(tasks, begin, end)
    t = smp.select_prompt(t.select("task_idx", "task_id", "prompt_complete", "prompt_chat"), mode)
    req = smp.expand_requests(t.select("task_idx", "task_id", F.col("prompt").alias("question")),
                              num_samples, batch_size)
    return smp.shard_requests(req, n_shards, seed).withColumn("gen_mode", F.lit(mode))


def reorg_output_file(spark: SparkSession, partials_path: str, out_path: str, num_samples: int,
                      run_keys: tuple[str, ...] = sinks.RUN_KEYS) -> DataFrame:
    """Merge the partial log into one record per run and task: outputs
    concatenated in arrival order, scalar fields from the first record, cut to
    ``num_samples``, written task-ordered per run.

    Arrival is ``ord`` where the log has it, else time stamp and request id,
    then the position in the record.  A record is a repeat only if it names
    itself, by request id or ``ord``, as another of its run and task does:
    then the one that arrived first stays."""
    log = files.load_partials(spark, partials_path)
    key = [*(k for k in run_keys if k in log.columns), "task_id"]
    rows = log.select(*key, "task_idx", "temperature", "max_new_tokens", "request_id", "ord", "tstamp",
                      F.posexplode("outputs").alias("pos", "output"))
    rows = rows.withColumn("name", F.coalesce("request_id", F.concat(F.lit("ord "), F.col("ord").cast("string"))))
    again = F.row_number().over(Window.partitionBy(*key, "name", "pos").orderBy("ord", "tstamp", "output"))
    named = F.col("name").isNotNull()
    rows = rows.filter(~named).unionByName(rows.filter(named).withColumn("again", again).filter("again = 1").drop("again"))
    rows = rows.withColumn("arrival", F.struct("ord", "tstamp", "request_id", "pos"))
    merged = smp.merge_partials(rows, num_samples, key=key, order="arrival", keep_first=["task_idx", "temperature", "max_new_tokens"])
    sinks.write_merged(merged, out_path, partition_cols=tuple(c for c in run_keys if c in merged.columns))
    return spark.read.parquet(out_path)
