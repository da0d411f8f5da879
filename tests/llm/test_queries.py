"""Every training-data query at the smallest scale, against its DuckDB text where it has one."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points
from evidloom.llm import queries as training
from tools import check

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(training.QUERIES))
def test_query_runs_and_matches_its_oracle(spark, con, name):
    ok, message = check.compare(spark, con, name, SF_DIR)
    assert ok, message


def test_all_thirteen_and_the_pipeline_are_registered():
    assert {int(name[2:].split("_")[0]) for name in training.QUERIES} == set(range(1, 14))
    assert {*training.QUERIES, "pipeline"} <= set(entry_points.queries())
    assert {"op4_preference_format", "op8_line_dedup", "op12_importance_resample", "op13_conversation_repair"} <= set(training.ORACLES)
