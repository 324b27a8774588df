"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import database, difference

FOLDER = "/root/testdata/sf0.001"
# those that fit models or build all features take long; checks.compare runs them at sf0.01
SLOW = {
    "scaled_features", "training_sequences", "tree_rows_close", "features", "null_report", "technical_report",
    "indicators", "related_sequences", "gbt_validation", "feature_importance", "gbt_forecast", "dual_forecast",
    "tree_rows_return", "forecast_fixed", "uncovered",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query(spark, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = database(FOLDER).execute(entry.oracle_sql()[name]).df()
    assert difference(got, want) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 5
