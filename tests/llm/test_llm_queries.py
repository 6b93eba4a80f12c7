"""The operators' queries against their SQL; the rest must run over their whole tables."""

import pytest
from compare import check, connect

from tidemark.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    check(spark, sf_dir, QUERIES[name], SQL[name], connect(sf_dir))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    n = QUERIES[name](spark, sf_dir).count()
    assert n > 0
