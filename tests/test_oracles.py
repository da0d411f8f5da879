"""Every registered query against its DuckDB text at the smallest scale."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points
from evidloom.plans import registry
from tools import check

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, message = check.compare(spark, con, name, SF_DIR)
    assert ok, message


def test_only_the_approximate_query_has_no_oracle():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"r9_approximate_neighbours"}
    assert set(registry.QUERIES) <= set(entry_points.queries())


def test_entry_returns_rows(spark):
    rows = entry_points.entry(spark)
    assert rows.columns == ["query_id", "chunk_id", "score", "rank"]
    assert rows.count() > 0
