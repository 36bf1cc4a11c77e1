"""Rolling totals: days without rows, nulls, repeats, empty tables, clashing columns."""

import datetime as dt

import pytest

from tidemill.operators import rolling

SCHEMA = "source bigint, ts timestamp, load bigint, n bigint, day_no string, __active string"


def at(day, hour=0):
    return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=day, hours=hour)


def dense(spark, data, active="n"):
    return rolling.daily_dense(spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA), "source", "ts", ["load", "n"], active)


def test_totals_over_gaps(spark, rows):
    out = rolling.trailing(dense(spark, [(1, at(0), 10, 1), (1, at(0, 5), 5, 1), (1, at(9), 7, 1)]), "source", ["load"], [7])
    got = {r["day_no"]: (r["load_sum_7"], r["load_avg_7"]) for r in out.collect()}
    assert got[0] == (15, pytest.approx(15 / 7)) and got[6][0] == 15 and got[7][0] == 0 and got[9][0] == 7 and len(got) == 10


def test_silent_days(spark, rows):
    found = rolling.silent_periods(dense(spark, [(1, at(0), 1, 1), (1, at(40), 1, 1)]), "source", "n")
    assert rows(found) == [(1, d, 7) for d in range(7, 30)] + sorted([(1, d, p) for d in range(30, 40) for p in (7, 30)])


def test_nulls_repeats_and_ends(spark, rows):
    data = [(None, at(1), None, 2), (None, at(1), None, 2), (None, None, 5, 5), (2, at(3), 4, 0), (2, at(4), 4, None)]
    assert rows(dense(spark, data)) == [(None, 1, 0, 4)]
    assert rows(dense(spark, data, None)) == [(2, 3, 4, 0), (2, 4, 4, 0), (None, 1, 0, 4)]


def test_empty(spark, rows):
    assert rows(rolling.silent_periods(dense(spark, []), "source", "n")) == []
