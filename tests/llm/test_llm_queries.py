"""The registered queries of the training-data operators on the smallest tables: against their SQL where there is some."""

import os

import duckdb
import pytest

pytest.importorskip("lodestrata.llm")
from lodestrata.llm import queries  # noqa: E402

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


def norm(rows):
    return sorted(tuple("nan" if isinstance(v, float) and v != v else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(D):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{D}/{t}'")
    df = queries.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    want = c.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert norm(df.select(*columns).collect()) == norm(want)


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if not n.startswith("op6")))
def test_one_row_for_each_input_row(spark, name):
    """Every query but packing returns a row for each document, page or conversation of its whole table."""
    table = {"op8_html_extract": ("pages", "page_id"), "op4_chat_format": ("conversations", "conv_id")}.get(name, ("documents", "doc_id"))
    want = [r[0] for r in spark.read.parquet(f"{D}/{table[0]}.parquet").select(table[1]).collect()]
    got = [r[0] for r in queries.QUERIES[name](spark, D).select(table[1]).collect()]
    assert sorted(got) == sorted(set(want) if table[1] == "conv_id" else want)
