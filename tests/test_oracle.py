"""Every registered query with SQL against DuckDB, value by value."""

import re

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference

OPTIONAL = re.compile(r"op\d+_|pipeline$")  # checked in tests of their own
UNCHECKED = sorted(
    name
    for name in set(entry.queries()) - set(entry.oracle_sql())
    if not OPTIONAL.match(name)
)


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, small, con, name):
    assert difference(entry.queries()[name](spark, small), con, entry.oracle_sql()[name]) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_sql():
    assert UNCHECKED == []


def test_entry_returns_the_feature_table(spark):
    from fleetcohort.settings import FEATURE_COLUMNS

    df = entry.entry(spark)
    assert df.columns == FEATURE_COLUMNS
    assert df.count() == 150


def test_scored_table_covers_every_branch(spark, small):
    """The value checks are only worth something if all branches occur."""
    from catalog.campaign_queries import _messages
    from catalog.scored import scored_drivers
    from fleetcohort.settings import PERSONAS

    scored = scored_drivers(spark, small)
    assert {r[0] for r in scored.select("persona").distinct().collect()} == set(PERSONAS)
    variants = {r[0] for r in _messages(spark, small).select("variant").distinct().collect()}
    assert variants == {"LOW_EARNINGS", "HIGH_CANCEL", "GOAL_GRADIENT"}


def test_fitted_invariants_check_the_report_of_the_fit(con):
    """Scores, labels and importances are not all of a fit: its report on both sides counts too."""
    sql = entry.oracle_sql()["fitted_invariants"]
    found = {r[0]: r[1] for r in con.execute(sql).fetchall()}
    drivers = found["drivers scored"]
    assert found["rows of the test side"] + found["rows of the train side"] == drivers > 0
    assert (found["report lines"], found["auc outside its range"], found["rate outside its range"]) == (10, 0, 0)
