"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

import check
from __spark_entry__ import entry, oracle_sql
from ticketmill.checks.registry import ORDERED, QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql())


def test_a_wrong_order_is_seen(spark, con):
    """The position is that in which rows come out, so ascending and descending reports differ."""
    assert set(ORDERED) <= set(QUERIES)
    up, down = (QUERIES[n](spark, SF_DIR).collect() for n in ("resolution_by_source", "resolution_by_source_desc"))
    assert {(r.source, r.position) for r in up} != {(r.source, r.position) for r in down}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert check.compare(spark, con, SF_DIR, name) is None


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0
