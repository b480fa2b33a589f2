"""Collect finished requests from a stream: an exactly-once log, or a merge that each micro-batch carries on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from evalspark.operators.samples import first_n_distinct, merge_partials
from evalspark.streaming.stop import run_available_now


def collect_partials(stream_df: DataFrame, sink_path: str, checkpoint: str) -> None:
    """Append every finished request to the sink; the checkpoint makes replays
    after a failure idempotent (file sink + offsets log)."""
    run_available_now(stream_df, sink_path, checkpoint)


def merge_collected(spark: SparkSession, sink_path: str, num_samples: int, keys: list[str], order: str, **merge_kw) -> DataFrame:
    """Batch merge of the collected log: a request is its key and ``order``; one shuffle of text, of at most
    ``num_samples`` requests per key and task."""
    return merge_partials(first_n_distinct(spark.read.parquet(sink_path), num_samples, keys, order), num_samples,
                          key=keys, order=order, **merge_kw)


class IncrementalMerge:
    """The first ``num_samples`` distinct requests per key, carried on by micro-batches.

    State: one folder of Parquet per micro-batch, with at most ``num_samples``
    rows per key.  A batch reads the folder of the one before, cuts both
    together (map-side first) and writes its own, so a replayed batch writes
    the same folder again; what is read back later is the last one, and nothing
    is merged again.  A repeat of a request that the cut dropped is dropped by
    the same cut, so only the kept ones need remembering.
    """

    def __init__(self, state_path: str, num_samples: int, keys: list[str], order: str):
        self.path, self.num_samples, self.keys, self.order = state_path, num_samples, keys, order

    def _folder(self, batch: int) -> str:
        return os.path.join(self.path, f"batch={batch}")

    def add(self, rows: DataFrame, batch: int) -> None:
        """The function of ``foreachBatch``."""
        if batch:
            rows = rows.sparkSession.read.schema(rows.schema).parquet(self._folder(batch - 1)).unionByName(rows)
        first_n_distinct(rows, self.num_samples, self.keys, self.order).write.mode("overwrite").parquet(self._folder(batch))

    def run(self, stream_df: DataFrame, checkpoint: str) -> int:
        """Drain everything available; the number of the last micro-batch."""
        q = (stream_df.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
        return q.lastProgress["batchId"]

    def merged(self, spark: SparkSession, batch: int, **merge_kw) -> DataFrame:
        return merge_partials(spark.read.parquet(self._folder(batch)), self.num_samples, key=self.keys, order=self.order, **merge_kw)
