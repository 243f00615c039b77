"""Every query of the core against its SQL, over whole tables."""

from __future__ import annotations

import os

import pytest

from oracle import rows_of, rows_of_sql
from sylva.plans import fact_queries, file_queries, general, text_queries

FOLDER = "/root/testdata/sf0.001"
MODULES = (general, text_queries, fact_queries, file_queries)
ALL = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, name):
    assert rows_of(ALL[name](spark, FOLDER)) == rows_of_sql(SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    df = ALL[name](spark, FOLDER)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_sql_names_are_queries():
    assert set(SQL) <= set(ALL)
