"""Every named query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(D):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{D}/{t}'")
    return c


def norm(rows):
    return sorted(tuple("nan" if isinstance(v, float) and v != v else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, D)
    columns = sorted(df.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert norm(df.select(*columns).collect()) == norm(want)


def test_names_and_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
