"""Exact token counts by pieces against the tokenizer itself; coverage bits against distinct lines."""

import json

import pytest
from pyspark.sql import functions as F

from evalspark.operators import coverage as cov
from evalspark.operators import metrics as met
from evalspark.operators import pieces
from evalspark.plans import catalog
from evalspark.session import scratch_path
from paths import SF_SMALL

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


TEXTS = [
    None, "", " ", "\n", "a", "aa", "aaa", "a" * 41, "a" * 64 + "b", "ab" * 33, "=" * 100, "!!!!!?????", "hello world", "Hello  World  \n\n x ",
    "it's we'll I'd you're THEY'VE don't", "tabs\tand\r\nlines\x0b\x0c\x85end", "no break   em　wide", "naïve café — “quotes” …",
    "日本語のテキスト", "한국어 문장 123 ４５", "🙂🙂🙃 emoji👩‍👩‍👧", "x1y22z333 4444 55555", "public static void main(String[] args) { int i=0; }",
    "internationalization misunderstanding", "aaaabaaaab aabaab baaab", "QWxhZGRpbjpvcGVuIHNlc2FtZQ==" * 20, "  leading", "trailing   ", "  ​",
    "<|endoftext|> as text", "½ ² Ⅷ ٣", "é combining", "\x00\x01control", "mississippi sassafras banana", "lll llll lllll llllll",
]


def test_counts_equal_the_tokenizer(spark, encode):
    df = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(TEXTS)], "k int, text string, piece string")
    got = {r["k"]: r["n_tokens"] for r in pieces.counter(PATH)(df, ["k"], "text").collect()}
    assert {i: (TEXTS[i], n) for i, n in got.items()} == {i: (x, encode(x)) for i, x in enumerate(TEXTS)}


def test_every_document_and_key_sums(spark, encode):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["n_tokens"] for r in catalog.q_count_tokens_pieces(spark, SF_SMALL).collect()}
    assert got == {d["doc_id"]: encode(d["text"]) for d in docs}


def test_hot_pieces_repeated_rows_and_null_keys(spark, encode, monkeypatch):
    monkeypatch.setattr(pieces, "HOT_SHARE", 5)
    monkeypatch.setattr(pieces, "SALTS", 3)
    rows = [(i % 40 if i % 40 else None, f" the cat number{i % 7}") for i in range(200)]
    got = {r["k"]: r["n_tokens"] for r in pieces.counter(PATH)(spark.createDataFrame(rows, "k int, text string"), ["k"], "text").collect()}
    want = {}
    for k, text in rows:
        want[k] = want.get(k, 0) + encode(text)
    assert got == want
    empty = spark.createDataFrame([], "k int, text string")
    assert pieces.counter(PATH)(empty, ["k"], "text").count() == 0


def test_cost_by_exact_counts(spark, encode):
    samples = spark.createDataFrame([(1, "int i = 0;"), (1, None), (2, "internationalization")], "task_idx int, raw_output string")
    prompts = spark.createDataFrame([(1, "write it"), (2, "")], "task_idx int, prompt string")
    got = {r["task_idx"]: r.asDict() for r in met.token_cost(samples, prompts, counter=pieces.counter(PATH)).collect()}
    assert got[1]["output_tokens"] == encode("int i = 0;") and got[1]["input_tokens"] == 2 * encode("write it")
    assert got[2]["output_tokens"] == encode("internationalization") and got[2]["input_tokens"] == 0
    assert got[1]["total_tokens"] == encode("write it") + encode("int i = 0;")


def test_cost_and_pass_at_t_queries(spark, encode):
    """Both queries over their whole tables, against the tokenizer and the estimator's product."""
    from evalspark import fixtures as fx
    from evalspark.operators import verdicts as ver
    from evalspark.schemas import VERDICT_FLAGS
    from evalspark.suites import T_GRID

    prompts = {r["task_idx"]: encode((r["prompt_complete"] or "").strip()) for r in fx.v_tasks(spark, SF_SMALL).collect()}
    total, n = {}, {}
    for r in fx.v_samples(spark, SF_SMALL).select("task_idx", "output").collect():
        t = r["task_idx"]
        n[t] = n.get(t, 0) + 1
        total[t] = total.get(t, 0) + 0.5 * prompts[t] + encode(r["output"])
    got = {r["task_idx"]: (r["n_samples"], r["total_tokens"]) for r in catalog.q_token_cost_pieces(spark, SF_SMALL).collect()}
    assert got == {t: (n[t], total[t]) for t in n}

    counts = {r["task_idx"]: r for r in ver.task_verdict_counts(fx.scored_samples(spark, SF_SMALL), VERDICT_FLAGS).collect()}
    want = {}
    for task, row in counts.items():
        for flag in VERDICT_FLAGS:
            for t in T_GRID:
                if total[task] >= t:
                    size, c, missed = row["total"], row[ver.count_col(flag)], 1.0
                    k = t / (total[task] / size)
                    for i in range(size - c + 1, size + 1):
                        missed *= 1 - k / i
                    want[task, flag, float(t)] = 1.0 if size - c < k else 1 - missed
    rows = {(r["task_idx"], r["flag"], r["param"]): r["value"] for r in catalog.q_pass_at_t_pieces(spark, SF_SMALL).collect()}
    assert rows and rows == pytest.approx(want, abs=1e-8)


def test_other_tokenizers_are_refused(tmp_path):
    spec = {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": {"type": "BPE", "merges": [["a", "b"], "ab c"]}}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    assert pieces.read_merges(str(path)) == {(b"a", b"b"): 0, (b"ab", b"c"): 1}
    path.write_text(json.dumps(spec | {"normalizer": {"type": "Lowercase"}}))
    with pytest.raises(ValueError, match="byte-level"):
        pieces.read_merges(str(path))


LINES = [(t, c, str(n) if n % 9 else f"0{n}", h) for t in (1, 2) for c in ("A", "B") for n in (0, 1, 9, 63, 64, 65, 200, 2**40, -1, -64) for h in (True, False, None)
         if (n + t) % 3 or h] + [(1, "A", None, True), (1, "A", "x", False), (1, "A", "x", False), (3, "A", "5", None)]


def test_incremental_coverage_equals_full(spark):
    lines = spark.createDataFrame(LINES, "task_idx int, class string, number string, hit boolean").withColumn("file", F.lit("f"))
    tasks = spark.createDataFrame([(i,) for i in range(1, 5)], "task_idx int")
    kept = {x for x in LINES if x[3] is not None}
    want = {t: (sum(x[3] for x in kept if x[0] == t) / len(own) if (own := [x for x in kept if x[0] == t]) else 0.0) for t in range(1, 5)}
    assert {r[0]: r[1] for r in cov.diff_coverage(lines.filter("hit is not null"), tasks).collect()} == pytest.approx(want)
    store = cov.CoverageStore(spark, scratch_path(spark, "coverage"), ["task_idx"])
    store.add("0", lines.filter("class = 'A'"))
    first = {r[0]: r[1] for r in store.diff_coverage(tasks).collect()}
    assert first != pytest.approx(want)
    store.add("1", lines)                 # overlaps the first batch
    store.add("1", lines)                 # and is written again
    assert {r[0]: r[1] for r in store.diff_coverage(tasks).collect()} == pytest.approx(want)


def test_short_pieces_are_not_shuffled_and_long_ones_are_counted(spark, encode, monkeypatch):
    monkeypatch.setattr(pieces, "HOT_SHARE", 5)
    monkeypatch.setattr(pieces, "MEMO_PIECES", 3)
    long = ["x" * 33, " " + "abc" * 40, "=" * 50]
    rows = [(i % 7 or None, f"{long[i % 3]} short words{i % 5} {long[0]}" if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "known int, text string")
    split = df.select("known", pieces.pieces(F.col("text")).alias("pieces")).withColumnRenamed("known", "k")
    found = pieces.short_pieces_summed(split, ["k"], pieces.read_merges(PATH))
    assert {r["piece"].strip() for r in found.filter("piece is not null").collect()} == {x.strip() for x in long}
    assert found.filter("piece is null").count() == len(rows)
    want = {}
    for k, text in rows:
        want[k] = want.get(k, 0) + encode(text)
    assert {r["known"]: r["n_tokens"] for r in pieces.counter(PATH)(df, ["known"], "text").collect()} == want
