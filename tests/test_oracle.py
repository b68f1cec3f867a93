"""Every query with an SQL counterpart gives the same rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    want = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=repr_key), sorted(want, key=repr_key)):
        assert g == pytest.approx(w, abs=2e-4) if all(isinstance(x, float) for x in g) else same(g, w), (g, w)


def repr_key(row):
    return tuple((x is None, 0 if x is None else round(x, 3) if isinstance(x, float) else x) for x in row)


def same(g, w):
    return all(
        math.isclose(a, b, abs_tol=2e-4) if isinstance(a, float) and isinstance(b, float) else a == b for a, b in zip(g, w)
    )


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.schema == entry.entry(spark).schema


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
