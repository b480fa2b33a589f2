"""A bounded, reproducible sample of labelled documents for fitting classifiers."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows are used to fit a model.
SAMPLE_ROWS = 20_000


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: a fifth, fixed by the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def held_out_id(doc_id: int | None) -> bool:
    """:func:`held_out` of one id."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, label, fold`` of at most ``rows`` labelled documents that are not held out.

    The rows are the first in the order of a hash of the id.  Their ids, at
    most ``rows`` of them, are a proven bound for the broadcast below, so the
    documents are scanned once and not shuffled.
    """
    picked = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
              .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
              .dropDuplicates(["doc_id"])
              .withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(rows))
    slim = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    joined = slim.join(F.broadcast(picked), "doc_id")
    return joined.select("text", "label", F.pmod("turn", F.lit(3)).cast("int").alias("fold"))
