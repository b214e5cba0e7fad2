"""Every registered query against its DuckDB oracle at sf0.001 (row count,
column names and an order-insensitive value hash), plus the smoke entry."""

import re

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.oracle_check import digest
from webweft.sources.tables import DRIVER_TABLES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == E.entry(spark).columns


def library_queries(names) -> list[str]:
    """Without the training-data queries, whose tests are in tests/llm."""
    return sorted(n for n in names if n != "pipeline" and not re.match(r"op\d+_", n))


@pytest.mark.parametrize("name", library_queries(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(rel.columns, orows)[0]


def test_every_query_has_oracle_or_is_rows_only(spark):
    rows_only = set(library_queries(E.queries())) - set(E.oracle_sql())
    assert rows_only <= {"page_clean", "scrape_flow"}
