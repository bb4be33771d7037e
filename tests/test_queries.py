"""Every registered query against its SQL twin."""

from __future__ import annotations

import os

import pytest

from loglake.plans import all_queries
from tests.oracle import DATA, compare, connect

SF_DIR = os.path.join(DATA, "sf" + os.environ.get("TEST_SF", "0.001"))
RUNS, ORACLES = all_queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(RUNS))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, RUNS[name], ORACLES.get(name), SF_DIR)
    assert ok, note


def test_every_query_has_an_oracle():
    assert set(RUNS) == set(ORACLES)


# Nodes that would pair rows without a key, or leave the JVM.
FORBIDDEN_NODES = ["CartesianProduct", "NestedLoop", "EvalPython"]


@pytest.mark.parametrize("name", [n for n in RUNS if n[0] in "afcghjlouvw" and n != "g7_scan_estimate"])
def test_plan_has_no_keyless_join_or_python(spark, name):
    plan = RUNS[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not [n for n in FORBIDDEN_NODES if n in plan], plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = RUNS["a1_error_rate_per_minute"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan
    assert "props" not in plan.split("ReadSchema")[1]
