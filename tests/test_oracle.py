"""Every registered query against its SQL, on the smallest test tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from oracle import difference, duck
from passageworks.catalog.queries import QUERIES as OWN

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), ORACLES[name], con) == ""


def test_every_query_of_the_library_has_sql():
    assert set(OWN) <= set(ORACLES)


def test_recall_with_few_probes(spark):
    rows = QUERIES["ann_recall"](spark, FOLDER).collect()
    shares = [r.recall for r in rows]
    assert rows and all(0 <= s <= 1 for s in shares)
    assert sum(shares) / len(shares) >= 0.9


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
