from __future__ import annotations

import pytest

from flowlens.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], connect(sf_dir)) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
