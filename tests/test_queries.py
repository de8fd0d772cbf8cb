"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from leakloom import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_sql(spark, con, name):
    df = core.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(_norm(r[c]) for c in columns)) for r in df.collect())
    result = con.execute(core.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(_norm(r[names.index(c)]) for c in columns)) for r in result.fetchall())
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, name):
    df = core.queries()[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
