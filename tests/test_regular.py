"""Regular grid: brute force over microseconds, gaps, nulls, ties."""

import datetime as dt
import random

import pytest

from tidemill.operators import regular

SCHEMA = "source string, ts timestamp, value bigint, cell string, n string"


def moment(seconds):
    return None if seconds is None else dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def frame(spark, data):
    return spark.createDataFrame([(s, moment(t), v, "x", "y") for s, t, v in data], SCHEMA)


def test_against_steps(spark):
    rng = random.Random(5)
    data = [(s, t, rng.randrange(0, 50)) for s in "ab" for t in rng.sample(range(0, 30_000), 40)]
    grid = {(r["source"], r["window_start"]): r for r in regular.regular_grid(frame(spark, data), "source", "ts", "value", hold_seconds=1800).collect()}
    for s in "ab":
        own = sorted((t, v) for x, t, v in data if x == s)
        for c in range(own[0][0] // 300, own[-1][0] // 300 + 1):
            valid = []
            for second in range(c * 300, c * 300 + 300):
                before = [(t, v) for t, v in own if t <= second]
                if before:
                    t, v = before[-1]
                    following = next((x for x, _ in own if x > t), None)
                    same_cell = following is not None and following // 300 == t // 300
                    if (same_cell or second < t + 1800) and not (following is None and second >= (t // 300 + 1) * 300):
                        valid.append(v)
            r = grid[s, c * 300]
            assert r["coverage"] == pytest.approx(len(valid) / 300)
            assert r["time_weighted"] == (pytest.approx(sum(valid) / len(valid)) if valid else None)
            assert r["total"] == sum(v for t, v in own if t // 300 == c) and r["n_readings"] == sum(t // 300 == c for t, _ in own)
            assert r["status"] == ("observed" if r["n_readings"] else "held" if valid else "missing")


def test_gap_bounds(spark, rows):
    data = [("a", 0, 1), ("a", 300 * 13, 1), ("a", 300 * (13 + 12), 1), ("a", 300 * (25 + 2017), 1), ("a", 300 * (2042 + 2018), 1)]
    found = regular.gaps(regular.cut(regular.holds(regular.cells(frame(spark, data), "source", "ts", "value"))))
    # The first reading of a cell is held for an hour: 300 s in its own cell, 3,300 s of the run.
    assert rows(found.drop("coverage")) == [("a", 300, 12), ("a", 300 * 26, 2016)]
    assert {r["n_windows"]: r["coverage"] for r in found.collect()} == pytest.approx({12: 3300 / 3600, 2016: 3300 / (300 * 2016)})


def test_nulls_and_ties(spark, rows):
    data = [(None, 10, 5), (None, 10, 9), (None, 10, None), (None, None, 3), ("a", 20, None), ("a", 80, 4)]
    out = {r["source"]: r for r in regular.regular_grid(frame(spark, data), "source", "ts", "value").collect()}
    assert out[None]["n_readings"] == 3 and out[None]["total"] == 14 and out[None]["time_weighted"] == 9.0
    assert out["a"]["n_readings"] == 2 and out["a"]["coverage"] == pytest.approx(220 / 300) and out["a"]["time_weighted"] == 4.0


def test_empty(spark, rows):
    assert rows(regular.regular_grid(frame(spark, []), "source", "ts", "value")) == []
