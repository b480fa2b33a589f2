"""Readers: tasks, generations, partials, run facts.  Schemas are declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.schemas import GENERATIONS, RUN_STEPS, TASKS
from evalspark.sources.jsonarray import RANGE_BYTES, read_json_array
from evalspark.suites import get_suite


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str, **options) -> DataFrame:
    reader = spark.read.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.format(fmt).load(path)


def validate_task_index(tasks: DataFrame, key: str = "task_idx") -> None:
    """``task_idx`` must be unique and exactly 0..N-1 (one small aggregate)."""
    row = tasks.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d"),
                    F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    n, d, lo, hi = row["n"], row["d"], row["lo"], row["hi"]
    if n == 0:
        return
    if d != n or lo != 0 or hi != n - 1:
        raise ValueError(f"{key} must be unique and 0..N-1: n={n} distinct={d} min={lo} max={hi}")


def load_tasks(spark: SparkSession, suite: str, path: str, fmt: str = "parquet",
               validate: bool = True) -> DataFrame:
    """The suite's task rows with the declared union schema.

    The suite name resolves through the registry (unknown name: ``KeyError``).
    Columns a suite does not have read as NULL.
    """
    get_suite(suite)
    tasks = _read(spark, path, TASKS, fmt)
    if validate:
        validate_task_index(tasks)
    return tasks


def generations_schema(task_id_type: T.DataType = T.StringType(), with_ord: bool = True) -> T.StructType:
    fields = [f if f.name != "task_id" else T.StructField("task_id", task_id_type) for f in GENERATIONS.fields]
    if with_ord:
        fields.append(T.StructField("ord", T.LongType()))
    return T.StructType(fields)


def load_generations(spark: SparkSession, path: str, multi_line: bool = True,
                     schema: T.StructType | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Merged generations: a JSON array document (``multi_line``) or JSON lines.

    Both are read by many tasks: lines by Spark's reader, an array by
    :mod:`evalspark.sources.jsonarray`.  A malformed record fails the job.
    """
    schema = schema or generations_schema()
    if multi_line:
        return read_json_array(spark, path, schema, range_bytes)
    return _read(spark, path, schema, "json", mode="FAILFAST")


def load_partials(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The append log: one JSON record per finished request (splittable).
    A malformed record fails the job."""
    return _read(spark, path, schema or generations_schema(), "json", mode="FAILFAST")


def run_steps_schema(run_keys: list[tuple[str, T.DataType]] | None = None) -> T.StructType:
    if run_keys is None:
        return RUN_STEPS
    std = [f for f in RUN_STEPS.fields if f.name not in ("task_idx", "sample_idx", "version")]
    return T.StructType([T.StructField(n, t) for n, t in run_keys] + std)


def load_run_steps(spark: SparkSession, path: str, fmt: str = "parquet",
                   run_keys: list[tuple[str, T.DataType]] | None = None) -> DataFrame:
    """Execution facts: one row per step (exit code, timeout, log lines)."""
    return _read(spark, path, run_steps_schema(run_keys), fmt)
