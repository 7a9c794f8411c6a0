"""Every registered query against its SQL, on whole tables."""

import pytest
from oracle import connect, difference

import __spark_entry__ as contract
from placefold.plans import registered

NAMES = sorted(registered())


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, con, name):
    frame = contract.queries()[name](spark, sf_dir)
    assert difference(con, frame, contract.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(NAMES) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_gives_rows(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["job_id", "leads", "leads_with_website", "leads_with_phone"]
    assert frame.count() == 5
