"""Scans are dealt by rows, so that no task works through a share of the table that grows with it."""

from pyspark.sql import functions as F

from evalspark import fixtures as fx


def test_splits_of_many_rows_are_dealt(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lineitem.parquet")
    spark.range(8_000).repartition(8).write.parquet(path)
    assert max(r[1] for r in fx.table(spark, str(tmp_path), "lineitem").groupBy(F.spark_partition_id()).count().collect()) > 200
    monkeypatch.setattr(fx, "TASK_ROWS", 100)
    dealt = fx.table(spark, str(tmp_path), "lineitem")
    sizes = [r[1] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 80 and max(sizes) <= 200 and sorted(r[0] for r in dealt.collect()) == list(range(8_000))
