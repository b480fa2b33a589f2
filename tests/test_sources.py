import json

import pytest
from pyspark.sql import functions as F

from evalspark.session import scratch_path
from evalspark.sources import files, sinks


def _write_tasks(spark, idx):
    path = scratch_path(spark, "tasks-src")
    spark.createDataFrame([(i, f"t{i}") for i in idx], "task_idx int, task_id string").write.parquet(path)
    return path


def test_load_tasks_validates_index(spark):
    ok = files.load_tasks(spark, "repair", _write_tasks(spark, [0, 1, 2]))
    assert ok.count() == 3 and "prompt_chat" in ok.columns      # declared union schema, NULL where absent
    with pytest.raises(ValueError, match="unique and 0..N-1"):
        files.load_tasks(spark, "repair", _write_tasks(spark, [0, 2, 2]))
    with pytest.raises(KeyError):
        files.load_tasks(spark, "no-such-suite", _write_tasks(spark, [0]))


def test_write_results_long_table_and_document(spark):
    m = spark.createDataFrame([("m", "complete", "pass_all", "pass@k", 1.0, 3, 0.5),
                               ("m", "complete", "pass_all", "pass@k", 5.0, 1, 0.9)],
                              "model_id string, bench_name string, flag string, metric string, param double, "
                              "n_tasks long, value double")
    path = scratch_path(spark, "results")
    sinks.write_results(m, path, ["model_id", "bench_name"], timing={"time_cost": 1.5})
    back = spark.read.parquet(f"{path}/metrics")
    assert back.count() == 2 and set(back.columns) >= {"model_id", "bench_name", "time_cost"}
    doc = json.loads(spark.read.json(f"{path}/documents").first().document)
    assert doc["time_cost"] == 1.5 and [e["param"] for e in doc["metrics"]] == [1.0, 5.0]


def test_partials_log_appends(spark):
    path = scratch_path(spark, "log")
    recs = spark.createDataFrame([("t1", 0, ["a"]), ("t2", 1, ["b"])], "task_id string, ord long, outputs array<string>")
    sinks.write_partials(recs, path)
    sinks.write_partials(recs.filter(F.col("task_id") == "t1"), path)
    assert files.load_partials(spark, path).count() == 3


def _arrays(rnd, n):
    """Records whose strings hold quotes, escapes and brackets."""
    bits = ['"', "\\", "{", "}", "[", "]", "a", "é", "\n", ",", "\\\"", " "]
    return [{"task_idx": i, "task_id": f"t{i}", "outputs": ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))
                                                          for _ in range(rnd.randint(0, 3))], "temperature": 0.5} for i in range(n)]


def test_json_array_is_read_alike_at_any_split(spark, tmp_path):
    import random
    rnd = random.Random(6)
    for indent, n in ((None, 40), (4, 25), (None, 0)):
        records = _arrays(rnd, n)
        path = tmp_path / f"generations-{indent}-{n}.json"
        path.write_text(json.dumps(records, indent=indent, ensure_ascii=n % 2 == 0))
        for size in (37, 61, 500, 1 << 20):
            df = files.load_generations(spark, str(path), range_bytes=size)
            got = sorted((r.task_idx, r.task_id, r.outputs, r.temperature) for r in df.collect())
            assert got == [(r["task_idx"], r["task_id"], r["outputs"], 0.5) for r in records]
            if size == 500 and n:
                assert df.rdd.getNumPartitions() > 3


def test_json_array_finds_borders_in_every_byte(tmp_path):
    """The two passes without Spark, at every split size."""
    import random
    from evalspark.schemas import GENERATIONS
    from evalspark.sources import jsonarray as ja
    records = _arrays(random.Random(8), 6)
    path = tmp_path / "g.json"
    path.write_text(json.dumps(records))
    size = path.stat().st_size
    for step in range(1, 90):
        reader = ja._SummaryReader(str(path), step)
        ranges, state = [], (False, 0)
        for part in reader.partitions():
            _, start, flips, outside, inside = next(reader.read(part))
            ranges.append(ja.Range(str(path), start, min(start + step, size), *state))
            state = state[0] ^ flips, state[1] + (inside if state[0] else outside)
        assert state == (False, 0)
        second = ja._RecordReader(str(path), GENERATIONS, [])
        assert [json.loads(t) for part in ranges for t in second._records(part)] == records


def test_broken_json_arrays_fail(spark, tmp_path):
    for name, text in (("cut", '[{"task_idx": 1, "outputs": ["a"]}'), ("open", '[{"task_idx": 1, "outputs": ["a]}]'), ("object", '{"task_idx": 1}'),
                       ("type", '[{"task_idx": "x"}]'), ("nested", "[[1]]")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):
            files.load_generations(spark, str(tmp_path / name)).collect()


def test_written_arrays_are_read_back(spark):
    path = scratch_path(spark, "arrays")
    df = spark.createDataFrame([(i, [f'"{i}"\n', "{"]) for i in range(50)], "task_idx int, outputs array<string>").repartition(4)
    sinks.write_generations_array(df, path)
    back = files.load_generations(spark, path)
    assert sorted((r.task_idx, r.outputs) for r in back.collect()) == [(i, [f'"{i}"\n', "{"]) for i in range(50)]


def test_one_document_per_run(spark, tmp_path):
    from evalspark.sources.documents import write_documents
    heads = spark.createDataFrame([("log/m/s/evaluation-a.json", '{"total": 3}'), ("log/n/s/evaluation-b.json", "{}")], "document string, head string")
    entries = spark.createDataFrame([("log/m/s/evaluation-a.json", i, json.dumps({"i": i, "text": "x\n"})) for i in range(300)],
                                    "document string, idx int, entry string").repartition(5)
    for _ in range(2):                               # written again: replaced
        write_documents(heads, entries, str(tmp_path))
    doc = json.loads((tmp_path / "log/m/s/evaluation-a.json").read_text())
    assert doc["total"] == 3 and list(doc["detail"]) == [str(i) for i in range(300)] and doc["detail"]["7"] == {"i": 7, "text": "x\n"}
    assert json.loads((tmp_path / "log/n/s/evaluation-b.json").read_text()) == {"detail": {}}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["log"]


def test_arrays_are_bracketed_in_bounded_slices(monkeypatch):
    import pyarrow as pa
    from evalspark.sources import sinks
    monkeypatch.setattr(sinks, "SLICE_BYTES", 1 << 16)
    records = [json.dumps({"outputs": ["x" * (n % 9_000)], "ord": n}) for n in range(2_000)]
    records[7] = json.dumps({"outputs": ["y" * 200_000]})                  # longer than a slice
    batches = [pa.RecordBatch.from_arrays([pa.array(records[a:a + 900])], ["value"]) for a in range(0, 2_000, 900)]
    out = list(sinks._bracketed(iter([batches[0].slice(0, 0), *batches])))
    assert max(b.nbytes for b in out if b.num_rows > 1) < 3 << 16
    lines = [v for b in out for v in b.column(0).to_pylist()]
    assert json.loads("\n".join(lines)) == [json.loads(r) for r in records]
    assert list(sinks._bracketed(iter([]))) == []
