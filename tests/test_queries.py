"""Every query of the core against its SQL, or, without one, that it runs and has rows."""

import pytest

from tests.oracle import DATA, compare, connect
from tidemill.plans import forecasting, problems, traces

QUERIES = problems.QUERIES | forecasting.query.queries | traces.query.queries
SQL = problems.ORACLES | forecasting.query.sql | traces.query.sql
#: Tables of this scale hold no cases for these.
MAY_BE_EMPTY = {"d16_pacf"}


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        compare(spark, con, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, str(DATA)).count() > 0 or name in MAY_BE_EMPTY


def test_entry_has_all(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
