"""Every registered query against its SQL twin, and the shape of every plan."""

import re

import pytest

import __spark_entry__ as entry
from checks.compare import difference, duck
from checks.oracles import ORACLES
from checks.queries import QUERIES

from .conftest import SMALL


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    assert difference(spark, connection, SMALL, name, QUERIES[name], ORACLES[name]) is None


FORBIDDEN = r"CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas|InArrow|\bWindow \[.*\], \[\]$"


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan(spark, name):
    """No cross join, no Python, no window without a partition."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(FORBIDDEN, plan, re.MULTILINE)
