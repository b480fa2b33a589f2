import os
import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evalspark.functions.defect import STREAM_STOP_MARKERS
from evalspark.session import scratch_path
from evalspark.streaming import partials as spart
from evalspark.streaming import stop as sstop
import rules


START = datetime(2024, 1, 1)


def _first_stop(chunks, rule, prefix=""):
    acc = ""
    for seq, t in enumerate(chunks):
        acc += t
        if rule == "marker":
            hit = any(m in acc for m in STREAM_STOP_MARKERS)
        else:
            hit = rules.first_close(prefix + acc) is not None
        if hit:
            return seq, acc
    return None, acc


def _random_requests(rnd, n):
    pieces = ["{", "}", '"', "a", " ", "Yes, it has defects", "No, it doesn't have defects", "x y", "{ b }"]
    out = {}
    for rid in range(n):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12)))
        cuts = sorted(rnd.sample(range(1, len(text)), min(len(text) - 1, rnd.randint(0, 5)))) if len(text) > 1 else []
        bounds = [0] + cuts + [len(text)]
        out[rid] = [text[a:b] for a, b in zip(bounds, bounds[1:])]
    return out


SCHEMA = "request_id long, seq long, text string, special boolean, prefix string, ts timestamp"


def _write_log(spark, batches, path):
    """One file, one micro-batch, for each list of rows; then the closing row."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.schema(SCHEMA).parquet(path).schema
    sstop.closing_row(spark, schema, "ts").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(spark, reqs, rule, prefix=None, special=()):
    root = scratch_path(spark, "stream-src")
    rows = [(rid, seq, t, (rid, seq) in special, prefix, START + timedelta(seconds=seq)) for rid, ch in reqs.items() for seq, t in enumerate(ch)]
    random.Random(3).shuffle(rows)
    third = len(rows) // 3 + 1
    # Four micro-batches: chunks out of order across three of them, and the closing row.
    src = _write_log(spark, [rows[k:k + third] for k in range(0, len(rows), third)], os.path.join(root, "src"))
    out = os.path.join(root, "out")
    progress = sstop.run_available_now(sstop.stop_stream(src, rule, prefix="prefix" if prefix else None, event_time="ts"), out, out + "-ckpt")
    assert sum(p["numInputRows"] > 0 for p in progress) >= min(3, len(rows))
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) > 0 and progress[-1]["stateOperators"][0]["numRowsTotal"] == 0
    rows = spark.read.schema(sstop.OUTPUT_SCHEMA).parquet(out).collect()
    assert len(rows) == len(reqs)
    return {r.request_id: (r.stop_seq, r.output) for r in rows}


def test_stream_agrees_with_batch_rule_text_and_marker(spark):
    rnd = random.Random(11)
    reqs = _random_requests(rnd, 40)
    for rule in ("text", "marker"):
        got = _run(spark, reqs, rule)
        exp = {rid: _first_stop(ch, rule) for rid, ch in reqs.items()}
        assert got == exp, rule


def test_stream_signature_prefix(spark):
    reqs = {0: ["a }", " b"], 1: ["{ x", "}", "}"], 2: ["no close"]}
    got = _run(spark, reqs, "signature", prefix="void f() {\n")
    assert got[0] == (0, "a }")
    assert got[1] == (2, "{ x}}")
    assert got[2] == (None, "no close")


def _chat_check(gen, sig):
    if sig not in gen:
        return False
    return rules.first_close(gen.split(sig)[1]) is not None


def test_stream_chat_rule_agrees_with_per_chunk_check(spark):
    rnd = random.Random(5)
    sig = "int f(a)"
    pieces = ["int f(a)", "int f", "(a)", "{", "}", '"', " x ", "{ y }", "f(a)"]
    reqs = {}
    for rid in range(40):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 10)))
        cuts = sorted(rnd.sample(range(1, len(text)), min(len(text) - 1, rnd.randint(0, 6)))) if len(text) > 1 else []
        bounds = [0] + cuts + [len(text)]
        reqs[rid] = [text[a:b] for a, b in zip(bounds, bounds[1:])]
    got = _run(spark, reqs, "chat", prefix=sig)
    exp = {}
    for rid, ch in reqs.items():
        acc, hit = "", None
        for seq, t in enumerate(ch):
            acc += t
            if _chat_check(acc, sig):
                hit = seq
                break
        exp[rid] = (hit, acc if hit is not None else "".join(ch))
    assert got == exp


def test_special_tokens_count_but_are_skipped(spark):
    reqs = {0: ["{ a", "}", " b }", "c"], 1: ["{", "<s>{", "}"], 2: ["x", "</s>"]}
    got = _run(spark, reqs, "text", special={(0, 1), (1, 1), (2, 1)})
    assert got == {0: (2, "{ a b }"), 1: (2, "{}"), 2: (None, "x")}


def test_gaps_and_repeats(spark):
    """A chunk that never comes leaves the request open; a chunk that comes twice counts once."""
    src = scratch_path(spark, "gap-src")
    rows = [(1, 0, "a", False, None, START), (1, 2, "c {}", False, None, START), (2, 0, "{", False, None, START)]
    more = [(2, 0, "{", False, None, START), (2, 1, "}", False, None, START), (1, 4, "e", False, None, START), (2, 2, "late", False, None, START)]
    stream = _write_log(spark, [rows, more], src)
    out = scratch_path(spark, "gap-out")
    sstop.run_available_now(sstop.stop_stream(stream, "text", event_time="ts"), out, out + "-ckpt")
    assert {r.request_id: (r.stop_seq, r.output) for r in spark.read.parquet(out).collect()} == {1: (None, "ac {}e"), 2: (1, "{}")}


def test_stop_stream_for_suite_uses_task_signatures_and_prompts(spark):
    tasks = spark.createDataFrame([(0, "int f()", "  do f\n"), (1, "void g()", "do g")],
                                  "task_idx int, function_signature string, prompt_complete string")
    rows = [(0, 0, 0, "Sure: int f() { x"), (0, 1, 0, " } more"), (1, 0, 1, "void g() {"), (1, 1, 1, " }"),
            (2, 0, 1, "no signature { }")]
    schema = "request_id long, seq long, task_idx int, text string"
    root = scratch_path(spark, "suite-stop")
    timed = spark.createDataFrame(rows, schema).withColumn("ts", F.lit(START))
    timed.coalesce(1).write.parquet(os.path.join(root, "src"))
    sstop.closing_row(spark, timed.schema, "ts").coalesce(1).write.mode("append").parquet(os.path.join(root, "src"))
    want = {"chat": {0: (1, "Sure: int f() { x } more"), 1: (1, "void g() { }"), 2: (None, "no signature { }")},
            "complete": {0: (None, "do fSure: int f() { x } more"), 1: (None, "do gvoid g() { }"), 2: (None, "do gno signature { }")}}
    for mode, rows in want.items():
        src = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(root, "src"))
        out = os.path.join(root, f"out-{mode}")
        sstop.run_available_now(sstop.stop_stream_for_suite(src, tasks, "complete", mode, event_time="ts"), out, out + "-ckpt")
        assert {r.request_id: (r.stop_seq, r.output) for r in spark.read.parquet(out).collect()} == rows
    assert sstop.rule_for("repair", "chat") == "text" and sstop.rule_for("defectdetection", "complete") == "marker"
    assert sstop.rule_for("testgen", "complete") == "signature"


def test_idle_requests_leave_no_state_in_processing_time(spark):
    """A stream that runs on: stopped requests ignore late chunks, open ones are emitted, and the timers empty the state."""
    src = scratch_path(spark, "state-chunks")
    for n in range(3):                       # one file, one micro-batch
        rows = [(r, n, "{ x }" if n == 0 and r < 4 else "late") for r in range(5)]
        spark.createDataFrame(rows, "request_id long, seq long, text string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("request_id long, seq long, text string").option("maxFilesPerTrigger", 1).parquet(src)
    out = scratch_path(spark, "state-out")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sstop.ROCKSDB)
    q = (sstop.stop_stream(stream, "text", idle_ms=8_000).writeStream.format("parquet").outputMode("append")
         .option("path", out).option("checkpointLocation", scratch_path(spark, "state-ckpt"))
         .trigger(processingTime="500 milliseconds").start())
    try:
        end, rows = time.time() + 90, []
        while time.time() < end and not (max(rows, default=0) > 0 and rows[-1] == 0):
            time.sleep(0.5)
            assert q.exception() is None
            rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        assert max(rows) > 0 and rows[-1] == 0
    finally:
        q.stop()
    got = {r.request_id: (r.stop_seq, r.output) for r in spark.read.parquet(out).collect()}
    assert got == {r: (0, "{ x }") for r in range(4)} | {4: (None, "latelatelate")}


def test_incremental_merge_equals_one_batch_merge(spark):
    rnd = random.Random(9)
    rows = [(f"t{rnd.randint(0, 5)}", k, f"o{k}", "m") for k in range(80)]
    rows += rnd.sample(rows, 30)                                     # repeats, in later batches too
    rnd.shuffle(rows)
    schema = "task_id string, ord long, output string, gen_mode string"
    src, log = scratch_path(spark, "merge-src"), scratch_path(spark, "merge-log")
    for k in range(0, len(rows), 28):
        spark.createDataFrame(rows[k:k + 28], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    merge = spart.IncrementalMerge(scratch_path(spark, "merge-state"), 4, ["task_id"], "ord")
    last = merge.run(stream, scratch_path(spark, "merge-ckpt"))
    assert last == 3
    got = sorted(tuple(r) for r in merge.merged(spark, last, keep_first=["gen_mode"]).collect())
    spark.createDataFrame(rows, schema).write.parquet(log)
    batch = spart.merge_collected(spark, log, 4, ["task_id"], "ord", keep_first=["gen_mode"])
    assert got == sorted(tuple(r) for r in batch.collect())
    first = {}
    for t, k, o, _ in sorted(set(rows)):
        first.setdefault(t, []).append(o)
    assert {r[0]: r[2] for r in got} == {t: o[:4] for t, o in first.items()}
    plan = batch._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1                       # text is shuffled once


def test_early_chunks_share_state_entries_and_count_once(spark):
    """Chunks that come before their turn are kept in blocks, over block borders; one that comes again is not repeated."""
    n = 3 * sstop.EARLY_BLOCK
    late = [(1, s, f"{s},", False, None, START) for s in range(n) if s % 2]
    rest = [(1, s, f"{s},", False, None, START) for s in range(0, n, 2)] + [(2, 1, "b", False, None, START)]
    again = [(1, 5, "5,", False, None, START), (2, 0, "a", False, None, START), (2, 1, "b", False, None, START), (2, 3, "d", False, None, START)]
    stream = _write_log(spark, [late, rest, again], scratch_path(spark, "early-src"))
    out = scratch_path(spark, "early-out")
    progress = sstop.run_available_now(sstop.stop_stream(stream, "text", event_time="ts"), out, out + "-ckpt")
    assert {r.request_id: (r.stop_seq, r.output) for r in spark.read.parquet(out).collect()} == {
        1: (None, "".join(f"{s}," for s in range(n))), 2: (None, "abd")}
    # The scan, its timer in two tables, and the blocks: far fewer than the early chunks.
    assert progress[0]["stateOperators"][0]["numRowsTotal"] < 12
