"""Every query of the core against its SQL on the smallest tables; those without SQL must run and keep their columns."""

from __future__ import annotations

import os

import pytest

from tests.oracle import compare, connect

import strataflow.plans.assays  # noqa: F401
import strataflow.plans.catalogue  # noqa: F401
import strataflow.plans.comparisons  # noqa: F401
import strataflow.plans.designs  # noqa: F401
import strataflow.plans.further  # noqa: F401
import strataflow.plans.populations  # noqa: F401
from strataflow.plans.queries import ORACLE, QUERIES

FOLDER = os.environ.get("STRATAFLOW_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() >= 0


def test_names_agree():
    assert set(ORACLE) <= set(QUERIES)
