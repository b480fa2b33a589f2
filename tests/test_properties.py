"""Property tests: Spark Column functions against the plain-Python rules.

Each Hypothesis example is a whole batch of inputs evaluated in one
DataFrame, so Spark runs once per example.
"""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.functions import braces, text
import rules

CODEISH = st.text(alphabet='ab {}"\n\'(@/ ', max_size=30)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(CODEISH, min_size=1, max_size=60))
def test_stop_at_function_and_screen_match_rule(spark, batch):
    df = spark.createDataFrame([(s,) for s in batch], "s string")
    got = df.select(braces.stop_at_function(F.col("s")).alias("a"), braces.syntax_screen(F.col("s")).alias("b")).collect()
    assert [r.a for r in got] == [rules.stop_at_function(s) for s in batch]
    assert [r.b for r in got] == [rules.screen(s) for s in batch]


@SETTINGS
@given(st.lists(CODEISH, min_size=1, max_size=60))
def test_clean_signature_properties(spark, batch):
    df = spark.createDataFrame([(s,) for s in batch], "s string")
    rows = df.select("s", text.strip_line_comments(F.col("s")).alias("bare"), text.clean_signature(F.col("s")).alias("c")).collect()
    for r in rows:
        pre, sub = r.c.pre, r.c.sub
        assert "(" not in sub
        if r.bare.startswith("@"):
            assert pre.endswith("\n") and r.bare.startswith(pre[:-1]) and sub == sub.strip() and sub in r.bare
        else:
            assert pre == "" and r.bare.startswith(sub) and r.bare[len(sub):len(sub) + 1] in ("", "(")


@SETTINGS
@given(st.lists(st.tuples(st.text(alphabet="ab\n", max_size=12), st.text(alphabet="xy\n", max_size=6),
                          st.integers(-6, 6), st.integers(-6, 6)), min_size=1, max_size=60))
def test_splice_matches_rule(spark, batch):
    df = spark.createDataFrame(batch, "s string, p string, a int, b int")
    got = [r[0] for r in df.select(text.splice_patch(F.col("s"), F.col("p"), F.col("a"), F.col("b"))).collect()]

    def ref(s, p, a, b):
        lines = s.split("\n")
        return "\n".join(lines[:a] + p.split("\n") + lines[b + 1:])

    assert got == [ref(*r) for r in batch]
