"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

from pitgauge.plans import load_all
from tests.parity import compare, connect

FOLDER = os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")
REG = load_all()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(REG.ORACLES))
def test_query_matches_sql(spark, con, name):
    ok, message = compare(spark, con, REG.QUERIES[name], REG.ORACLES[name], FOLDER)
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(REG.QUERIES) - set(REG.ORACLES)))
def test_query_without_sql_twin_returns_rows(spark, name):
    assert REG.QUERIES[name](spark, FOLDER).count() > 0
