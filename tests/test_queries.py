"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import compare
from __spark_entry__ import entry
from oracles import ORACLES
from queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    report = compare.compare(spark, con, FOLDER, QUERIES[name], ORACLES[name])
    assert report in (None, "no rows")


def test_entry(spark):
    assert entry(spark).count() > 0
