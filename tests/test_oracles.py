"""Every registered query against its SQL, over the smallest tables."""

import pytest

import __spark_entry__ as entry_points
import check


@pytest.fixture(scope="module")
def con(folder):
    return check.connect(folder)


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, con, folder, name):
    result, rows = check.compare(spark, con, folder, name)
    assert result in ("ok", "rows-only"), result
    assert rows > 0


def test_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
