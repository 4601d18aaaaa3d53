from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from checks.compare import connect, differences
from checks.oracle import ORACLE
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def connection(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


def test_entry_points_hold_every_query():
    assert QUERIES.keys() <= entry_points.queries().keys()
    assert entry_points.oracle_sql().keys() <= entry_points.queries().keys()


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, sf, connection, name):
    assert differences(QUERIES[name](spark, sf), ORACLE[name], connection) is None


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wide_rows_are_not_joined_with_themselves(spark, sf):
    """The digest belongs to the row it is of; numbers don't move with the window's rows."""
    plan = plan_of(QUERIES["wide_clean"](spark, sf))
    assert not [line for line in plan.splitlines() if "Join" in line and "row_order" in line]
    below_window = plan[plan.index("Window ["):]
    assert "_numbers" not in below_window


def test_multiline_rows_are_numbered_without_one_window(spark, sf):
    plan = plan_of(QUERIES["delimited_scan_multiline"](spark, sf))
    assert "windowspecdefinition(_ordinal" not in plan
