from __future__ import annotations

import os

import pytest

from oracle import rows_of, rows_of_sql
from sylva.llm import queries as q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
KEYS = {"p1_found": ["account_id", "field", "sent_no"], "p6_found": ["entry_id"], "p7_surprise": ["term_a", "term_b"], "p9_mix": ["doc_id"], "p9_shares": ["source"], "p9_order": ["doc_id", "use_no"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_rows_equal_sql(spark, name):
    assert rows_of(q.QUERIES[name](spark, FOLDER)) == rows_of_sql(q.SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(KEYS))
def test_one_row_per_key(spark, name):
    df = q.QUERIES[name](spark, FOLDER).cache()
    assert df.count() > 0
    assert df.select(*KEYS[name]).distinct().count() == df.count()
    df.unpersist()
