import duckdb
import pytest

import __spark_entry__ as entry_mod
from paths import SF_SMALL
from evalspark.plans import catalog

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["flag", "metric", "param", "n_tasks", "value"]


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) <= set(entry_mod.queries())
    assert set(catalog.QUERIES) - catalog.WITHOUT_SQL <= set(entry_mod.oracle_sql())


def _norm(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - catalog.WITHOUT_SQL))
def test_query_matches_oracle_small(spark, duck, name):
    df = entry_mod.queries()[name](spark, SF_SMALL)
    cols = df.columns
    got = sorted("|".join(_norm(r[c]) for c in sorted(cols)) for r in df.collect())
    cur = duck.execute(entry_mod.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    idx = sorted(range(len(ocols)), key=lambda i: ocols[i])
    exp = sorted("|".join(_norm(r[i]) for i in idx) for r in cur.fetchall())
    assert got == exp
