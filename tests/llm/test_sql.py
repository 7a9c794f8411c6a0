"""Registered queries of the text operators against their SQL, on whole tables."""

import oracle
import pytest

from placefold.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_matches_sql(spark, sf_dir, name):
    plan, sql = QUERIES[name]
    assert oracle.difference(oracle.connect(sf_dir), plan(spark, sf_dir), sql) is None
