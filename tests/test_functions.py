import random

import pytest
from pyspark.sql import functions as F

from evalspark.functions import braces, defect, logs, text, tokens
from evalspark.functions.estimators import pass_at_k
import rules


def one(spark, values, fn, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col(df.columns[0]))).collect()]


BRACE_CASES = [("}{x", 2), ("ab}c{d}e", 5), ("no braces", 9), ('a "{" {b} c', 9), ("x{'}'}y", 4), ("", 0)]


def test_brace_rule_table(spark):
    got = one(spark, [c for c, _ in BRACE_CASES], braces.stop_at_function)
    assert [len(g) for g in got] == [n for _, n in BRACE_CASES]


def test_brace_scan_matches_rule_on_random_text(spark):
    rnd = random.Random(7)
    alphabet = 'ab {}"\n\'x/*\\\\'
    cases = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    got = one(spark, cases, braces.stop_at_function)
    assert got == [rules.stop_at_function(c) for c in cases]
    ok = one(spark, cases, braces.syntax_screen)
    assert ok == [rules.screen(c) for c in cases]


@pytest.mark.parametrize("code,ok", [
    ("{ }", True), ("{", False), ("} {", False), ("", True),
    ('{ s = "}{"; }', True), ('{ s = "\\\\"}"; }', False), ('{ s = "\\"}"; }', True), ('{ "open }', False),
    ("{ c = '}'; d = '\\''; }", True), ("{ c = '\"'; }", True), ("{ ' }", False),
    ("{ // } {{ \" '\n }", True), ("{ } // it's \"fine\"", True), ("{ a / b; }", True), ("{ a //", False),
    ("{ /* } \" ' */ }", True), ("{ /* } **/ }", True), ("{ /*/ } */ }", True), ("{ } /* open", False), ("{ } /*/", False), ("{ /", False),
    ('/""*{}', True), ("{ \"//\" }", True), ("{ \"/*\" }", True)])
def test_screen_in_each_state_of_the_lexer(spark, code, ok):
    assert one(spark, [code], braces.syntax_screen) == [ok] == [rules.screen(code)]


def test_lexer_table_is_total():
    table = braces.lexer_table()
    assert len(table) == 9 and all(len(row) == len(braces.SIGNS) + 1 and set(row) <= set(range(9)) for row in table)


def test_screen_of_a_long_text(spark):
    import time
    code = "{ s = \"a}\"; /* } */ x(); }\n" * 60_000
    began = time.time()
    assert one(spark, [code, code + "}"], braces.syntax_screen) == [True, False]
    assert time.time() - began < 20


def test_long_text_without_braces_is_linear(spark):
    big = "word " * 40000
    got = one(spark, [big], braces.stop_at_function)
    assert got == [big]


@pytest.mark.parametrize("n,c,k,expected", [(25, 3, 5, 0.504347826), (25, 0, 5, 0.0), (25, 25, 5, 1.0)])
def test_pass_at_k_table(spark, n, c, k, expected):
    df = spark.createDataFrame([(n, c, float(k))], "n int, c int, k double")
    v = df.select(pass_at_k(F.col("n"), F.col("c"), F.col("k"))).first()[0]
    assert v == pytest.approx(expected, abs=1e-9)


def test_pass_at_k_of_many_samples(spark):
    """The closed form against the sum of logs, for whole and real k."""
    import math
    cases = [(n, c, k) for n in (65, 200, 5_000, 1_000_000) for c in (1, 64, 65, 66, 199, 4_000, 999_000) for k in (0.25, 1.0, 7.5, 100.0, 900.5) if c <= n]
    df = spark.createDataFrame(cases, "n long, c long, k double")
    for r in df.select("n", "c", "k", pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("v")).collect():
        want = 1.0 if r.n - r.c < r.k else 1.0 - math.exp(math.fsum(math.log1p(-r.k / i) for i in range(r.n - r.c + 1, r.n + 1)))
        assert r.v == pytest.approx(want, abs=1e-9)


def test_pass_at_k_properties(spark):
    grid = [(n, c, k) for n in range(1, 13) for c in range(0, n + 1) for k in range(1, n + 1)]
    df = spark.createDataFrame(grid, "n int, c int, k int")
    got = {(r.n, r.c, r.k): r.v for r in
           df.select("n", "c", "k", pass_at_k(F.col("n"), F.col("c"), F.col("k").cast("double")).alias("v")).collect()}
    for (n, c, k), v in got.items():
        assert 0.0 <= v <= 1.0
        assert v == pytest.approx(rules.pass_at_k_binomial(n, c, k), abs=1e-12)
        if k == 1:
            assert v == pytest.approx(c / n, abs=1e-12)
        if k < n:
            assert got[(n, c, k + 1)] >= v - 1e-12
        if c < n:
            assert got[(n, c + 1, k)] >= v - 1e-12


def test_strip_matches_python(spark):
    vals = ["  a b \n", "　x ", "\t\x0b\x0cy\x1c", "", "   ", " z\u0085"]
    assert one(spark, vals, text.py_strip) == [v.strip() for v in vals]


# Signature, then by hand: annotation line and what is left up to the parameters.
SIGNATURES = [
    ("public int f(int a)", "", "public int f"),
    ("@Override\npublic void g(String s)", "@Override\n", "public void g"),
    ("int h( // first\n int b)", "", "int h"),
    ("@Test public void t()", "@Test\n", "public void t"),
    ("static T k3 (T x) // end", "", "static T k3 "),
    ("@Deprecated", "@Deprecate\n", "d"),
    ("@", "\n", "@"),
    ("", "", ""),
    ("a//b\nc(d)", "", "ac"),
]


def test_clean_signature_shapes(spark):
    df = spark.createDataFrame([(s,) for s, _, _ in SIGNATURES], "s string")
    got = [(r.pre, r.sub) for r in df.select(text.clean_signature(F.col("s")).alias("c")).select("c.*").collect()]
    assert got == [(pre, sub) for _, pre, sub in SIGNATURES]


def test_extract_chat_function(spark):
    rows = [("Sure: public int f(int a) { return 1; } more", "public int f(int a)"),
            ("nothing here", "public int f(int a)"),
            ("public int f(int a) {x} public int f(int a) {y}", "public int f(int a)")]
    df = spark.createDataFrame(rows, "a string, s string")
    got = [r[0] for r in df.select(text.extract_chat_function(F.col("a"), F.col("s"), True)).collect()]
    assert got[0] == "public int f(int a) { return 1; }"
    assert got[1] == "Can not find target function in answer!\n\nnothing here"
    assert got[2] == "public int f(int a) {x}"


def test_splice_identity_and_bounds(spark):
    src = "l0\nl1\nl2\nl3"
    rows = [(src, "l1\nl2", 1, 2), (src, "X", 0, 0), (src, "X", 3, 9), (src, "", 1, 1)]
    df = spark.createDataFrame(rows, "s string, p string, a int, b int")
    got = [r[0] for r in df.select(text.splice_patch(F.col("s"), F.col("p"), F.col("a"), F.col("b"))).collect()]

    def ref(s, p, a, b):
        lines = s.split("\n")
        return "\n".join(lines[:a] + p.split("\n") + lines[b + 1:])

    assert got == [ref(*r) for r in rows]
    assert got[0] == src


def test_stop_token_and_raw_output(spark):
    df = spark.createDataFrame([("abc public x /** y", "bc"), ("none", ""), ("xyz", "q")], "t string, p string")
    cut = [r[0] for r in df.select(text.stop_at_stop_token(F.col("t"), ["/**", "public"])).collect()]
    assert cut == ["abc ", "none", "xyz"]
    raw = [r[0] for r in df.select(text.reconstruct_raw_output(F.col("t"), F.col("p"))).collect()]
    assert raw == ["abc", "", "xyz"]


def test_chat_cleanup(spark):
    df = spark.createDataFrame([("Assistant: <s>hi ###x</s>",), ("###<s>keep ###</s>",)], "t string")
    got = [r[0] for r in df.select(text.clean_chat_output(F.col("t"), "###", ["<s>", "</s>"], True)).collect()]
    assert got == ["hi", "###keep ###"]


DEFECT_CASES = [
    ("Yes, it has defects", "defect"), ("No, it doesn't have defects", "nodefect"),
    ("Note: there is a potential defect", "nodefect"), ("this doesn't has defect", "defect"),
    ("here is a potential issue", "defect"), ("there are no real defects", "nodefect"),
    ("I cannot determine", "error"), ("There are quite a few issues", "defect"),
    ("this function is not flawed", "nodefect"), ("", "error"), ("ERROR", "error"),
]


def test_defect_cascade(spark):
    got = one(spark, [c for c, _ in DEFECT_CASES],
              lambda c: defect.classify_defect_answer(defect.truncate_defect_answer(c)))
    assert got == [lab for _, lab in DEFECT_CASES]


def test_log_parsers(spark):
    df = spark.createDataFrame([(["a", "Failing tests: 0"],), (["Failing tests: 0", "x"],), ([],)], "l array<string>")
    assert [r[0] for r in df.select(logs.tests_ok(F.col("l"))).collect()] == [True, False, False]
    cov = spark.createDataFrame([("x\nLine coverage: 12.5%\nCondition coverage: 40.0%",), ("",),
                                 ("Condition coverage: 7.0%",), ("Line coverage: 1%\n",)], "t string")
    got = [tuple(r) for r in cov.select(logs.parse_coverage_summary(text.log_lines(F.col("t"))).alias("c"))
           .select("c.*").collect()]
    assert got == [(0.125, 0.4), (0.0, 0.0), (0.0, 0.07), (0.0, 0.0)]
    err = spark.createDataFrame([("note\nA.java:3: error: bad\nB.java:9: error: x",), ("x: error:\nnext",), ("fine",)],
                                "t string")
    assert [r[0] for r in err.select(logs.first_compiler_error(F.col("t"))).collect()] == \
        ["A.java:3: error: bad", "x: error:", None]


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, wörld 42!",), ("",)], "t string")
    assert [r[0] for r in df.select(tokens.count_tokens(F.col("t"))).collect()] == [5, 0]
    toks = df.select(tokens.tokens(F.col("t")).alias("k"))
    kept = [r[0] for r in toks.select(tokens.truncate_prompt_tokens(F.col("k"), 2, "complete")).collect()]
    assert kept == [["42", "!"], []]
    kept = [r[0] for r in toks.select(tokens.truncate_prompt_tokens(F.col("k"), 2, "chat")).collect()]
    assert kept == [["Hello", ","], []]


def test_truncation_keeps_a_piece_of_the_prompt(spark):
    rnd = random.Random(2)
    cases = ["".join(rnd.choice(["a", "B9", " ", "  ", "\n", ",", "é", "日本", "🙂", "\x85", "_"]) for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", tokens.tokens(F.col("t")).alias("k"), tokens.gaps(F.col("t")).alias("g"))
    got = df.select("t", "k", *[tokens.truncate_prompt(F.col("t"), F.col("k"), F.col("g"), 4, m).alias(m) for m in ("complete", "chat")]).collect()
    for r in got:
        assert r.t.endswith(r.complete) and r.t.startswith(r.chat)
        spans = []
        at = 0
        for k in r.k:
            at = r.t.index(k, at)
            spans.append((at, at + len(k)))
            at += len(k)
        if len(spans) <= 4:
            assert r.complete == r.chat == r.t
        else:
            assert r.complete == r.t[spans[-4][0]:] and r.chat == r.t[:spans[3][1]]


def test_tests_ok_raw_text(spark):
    vals = ["a\nFailing tests: 0\n", "Failing tests: 0\n", "a\nFailing tests: 0", "Failing tests: 0\n\n", "", "xFailing tests: 0\n"]
    assert one(spark, vals, logs.tests_ok_text) == [True, True, False, False, False, False]
