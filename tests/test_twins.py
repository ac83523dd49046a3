"""Every registered query with a SQL twin gives the twin's rows; the others give rows."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from terrafold.plans import catalog

# Training-data operators are tested in their own folder.
QUERIES = catalog.queries()
TWINS = catalog.oracle_sql()
OTHERS = set(QUERIES) - set(TWINS)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, TWINS[name]) is None


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
