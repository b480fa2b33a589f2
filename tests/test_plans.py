import io
from contextlib import redirect_stdout

from paths import SF_MID
from evalspark import fixtures as fx
from evalspark.operators import coverage as cov
from evalspark.operators import samples as smp
from evalspark.plans import catalog
from evalspark.session import scratch_path


def plan(df):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_attach_task_broadcasts_checked_small_side(spark):
    s = fx.v_samples(spark, SF_MID).select("task_idx", "sample_idx")
    p = plan(smp.attach_task(s, fx.v_tasks(spark, SF_MID), ["project"]))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_native_operators_have_no_python_nodes(spark):
    for name in ("stop_at_function", "task_detail_report", "classify_defect_answer", "diff_coverage",
                 "load_coverage_xml", "reduce_patch_verdict", "count_tokens"):
        p = plan(catalog.QUERIES[name](spark, SF_MID))
        assert "EvalPython" not in p and "PythonUDF" not in p, name


def test_range_filter_reaches_the_scan(spark):
    path = scratch_path(spark, "gens-pushdown")
    fx.v_samples(spark, SF_MID).select("task_idx", "sample_idx", "output").write.parquet(path)
    df = smp.filter_evaluate_range(spark.read.parquet(path), 2, 30).select("task_idx", "sample_idx")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(task_idx), GreaterThanOrEqual(task_idx,2), LessThanOrEqual(task_idx,30)]" in p
    assert "ReadSchema: struct<task_idx:int,sample_idx:int>" in p


def test_first_n_limits_before_shuffle(spark):
    p = plan(smp.first_n_samples(fx.v_samples(spark, SF_MID), 3))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_diff_coverage_combines_map_side(spark):
    p = plan(cov.diff_coverage(fx.v_cov(spark, SF_MID), fx.v_cov(spark, SF_MID).select("task_idx").distinct()))
    assert p.count("HashAggregate") >= 4


def test_run_keys_prune_merged_generations(spark):
    from pyspark.sql import functions as F
    from evalspark.sources import sinks
    path = scratch_path(spark, "merged-prune")
    p = fx.v_partials(spark, SF_MID).withColumn("task_id", F.col("task_id").cast("string"))
    m = smp.merge_partials(p, 5, keep_first=["gen_mode"])
    runs = m.withColumn("model_id", F.explode(F.array(F.lit("m0"), F.lit("m1")))).withColumn("bench_name", F.lit("b"))
    sinks.write_merged(runs, path)
    txt = plan(spark.read.parquet(path).filter(F.col("model_id") == "m0").select("task_id"))
    assert "PartitionFilters: [isnotnull(model_id" in txt and "(model_id" in txt


def test_requests_written_per_shard(spark):
    from pyspark.sql import functions as F
    from evalspark.plans.generation import build_requests
    from evalspark.sources import sinks
    path = scratch_path(spark, "requests")
    sinks.write_requests(build_requests(fx.v_tasks(spark, SF_MID), "complete", "chat", 4, n_shards=3, seed=1), path)
    shard = spark.read.parquet(path).filter(F.col("shard_id") == 1)
    assert "PartitionFilters: [isnotnull(shard_id" in plan(shard)
    assert shard.count() + spark.read.parquet(path).filter(F.col("shard_id") != 1).count() == 40 * 4


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A file of one row group, cut into more splits than there are cores: its rows still go to several tasks."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    rnd = np.random.default_rng(1)
    pq.write_table(pa.table({"k": pa.array(range(60_000)), "x": rnd.random(60_000), "y": rnd.random(60_000)}),
                   tmp_path / "one.parquet", row_group_size=100_000)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = spark.read.parquet(str(tmp_path / "one.parquet"))
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert sum(n > 0 for n in df.rdd.glom().map(len).collect()) == 1
        counts = fx.spread(df).rdd.glom().map(len).collect()
        assert len(counts) == spark.sparkContext.defaultParallelism and min(counts) > 10_000
        many = spark.range(80_000).repartition(8)
        many.write.parquet(str(tmp_path / "many.parquet"))
        back = spark.read.parquet(str(tmp_path / "many.parquet"))
        assert "Exchange" not in plan(fx.spread(back))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
