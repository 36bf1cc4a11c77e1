"""Medians, runs across blocks and contextual flags against brute force."""

import datetime as dt
import random
import statistics

import pytest

from tidemill.operators import spikes
from tidemill.plans import problems


def test_medians(spark):
    rng = random.Random(1)
    data = [(k, i, rng.choice([0, 1, -7, rng.randrange(10**6), rng.randrange(100)])) for k in ("a", "b", None) for i in range(rng.randrange(1, 60))] + [("c", 1, None), ("d", 1, 5), ("d", 2, 8)]
    df = spark.createDataFrame([(*r, "x") for r in data], "k string, id bigint, v bigint, bucket string")
    got = {r["k"]: r["median"] for r in spikes.source_medians(df.drop("bucket"), ["k"], "v", ["id"]).collect()}
    want = {k: statistics.median(v for x, _, v in data if x == k and v is not None) for k in ("a", "b", None, "d")}
    assert got == pytest.approx(want)


def brute_stuck(data, least):
    out = set()
    for s in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        run = []
        for r in [*own, None]:
            if r is None or not run or r[3] is None or r[3] != run[-1][3]:
                if len(run) >= least and run[0][3]:
                    out |= {(x[0], x[2], "v") for x in run}
                run = []
            if r is not None:
                run.append(r)
    return out


@pytest.mark.parametrize("block", [60, 1000, 86_400])
def test_stuck(spark, block):
    rng = random.Random(3)
    data, i = [], 0
    for s in ("a", "b", None):
        t = 0
        for _ in range(60):
            v = rng.choice([0, None, 5, 6])
            for _ in range(rng.choice([1, 3, 11, 12, 13, 40])):
                t += rng.choice([0, 1, 30, 400])
                i += 1
                data.append((s, t, i, v))
    ts = lambda t: dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=t)
    df = spark.createDataFrame([(s, ts(t), i, v, "x", "y") for s, t, i, v in data], "src string, ts timestamp, id bigint, v bigint, block string, source string")
    got = {tuple(r) for r in spikes.stuck_rows(df, "src", "ts", "id", ["v"], 12, block).collect()}
    assert got == brute_stuck(data, 12) and got


def test_zero_block_parts_runs(spark, rows):
    ts = lambda d, k: dt.datetime(1970, 1, 1 + d, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=k)
    data = [("a", ts(0, k), k, 5) for k in range(6)] + [("a", ts(1, 0), 6, 0)] + [("a", ts(2, k), 7 + k, 5) for k in range(6)]
    df = spark.createDataFrame(data, "src string, ts timestamp, id bigint, v bigint")
    assert rows(spikes.stuck_rows(df, "src", "ts", "id", ["v"])) == []
    assert len(rows(spikes.stuck_rows(df.where("v > 0"), "src", "ts", "id", ["v"]))) == 12


def test_context(spark):
    ts = lambda k: dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=k)
    data = [("a", ts(k), k, 100 + k % 7) for k in range(24 * 9)] + [("a", ts(24 * 9), 999, 100_000), ("a", None, 1000, 5), (None, ts(3), 1001, None)]
    out = spikes.contextual_flags(spark.createDataFrame(data, "s string, t timestamp, id bigint, v bigint"), "s", "t", "id", "v").collect()
    assert [(r["row_id"], r["outside"], r["jumped"]) for r in out] == [(999, True, True)]


def test_empty(spark, rows):
    df = spark.createDataFrame([], "s string, t timestamp, id bigint, v bigint")
    assert rows(spikes.stuck_rows(df, "s", "t", "id", ["v"])) == rows(spikes.contextual_flags(df, "s", "t", "id", "v")) == rows(spikes.source_medians(df, ["s"], "v", ["id"])) == rows(spikes.spikes(df, ["s"], "v", "t", ["id"], 20)) == []


def test_jumps_in_both_directions_and_beside_zero(spark):
    ts = lambda k: dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=k)
    values = [100, 5001, 100, 1, 51, 0, 50, 0, 51, -51, -1, 0, -60, 49, 1]
    df = spark.createDataFrame([("a", ts(k), k, v) for k, v in enumerate(values)], "s string, t timestamp, id bigint, v bigint")
    got = {r["row_id"] for r in spikes.contextual_flags(df, "s", "t", "id", "v").collect() if r["jumped"]}
    assert got == {1, 2, 3, 4, 5, 8, 9, 10, 12, 13}


def test_context_of_all_fields(spark):
    from tests.oracle import DATA

    got = {(r["tbl"], r["field"]) for r in problems.p4_context(spark, str(DATA)).select("tbl", "field").distinct().collect()}
    assert got == {("requests", "total_tokens"), ("requests", "response_tokens"), ("series_5min", "token_load")}


def test_spikes_are_all_proposed(spark):
    rng = random.Random(9)
    ts = lambda k: dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=k)
    data = []
    for s, level in (("a", 40), ("b", 0), (None, 1000), ("heavy", 3)):
        # Some hours are far above the median as a rule: their own fences alone would let spikes pass.
        data += [(s, len(data) + k, ts(k) if k % 11 else None, max(0, int(rng.lognormvariate(1, 2 if s == "heavy" else 0.3) * level * (25 if k % 24 < 6 else 1)))) for k in range(400)]
    data += [("a", 9001, ts(5), None), ("one", 9002, ts(1), 7)]
    df = spark.createDataFrame([(*r, "x") for r in data], "s string, id bigint, t timestamp, v bigint, high string")
    got = {r["id"] for r in spikes.spikes(df.drop("high"), ["s"], "v", "t", ["id"], 20).collect()}
    want = {i for s, i, _, v in data if v is not None and v > 20 * statistics.median(x for k, _, _, x in data if k == s and x is not None)}
    assert got == want and len(want) > 50


def test_readings_are_passed_twice_for_spikes(spark):
    passed = spark.sparkContext.accumulator(0)

    def through(frames):
        for pdf in frames:
            passed.add(len(pdf))
            yield pdf

    ts = lambda k: dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=k)
    data = [("a", k, ts(k), 100 + k % 7) for k in range(200)] + [("a", 900, ts(3), 9000)]
    df = spark.createDataFrame(data, "s string, id bigint, t timestamp, v bigint")
    assert [r["id"] for r in spikes.spikes(df.mapInPandas(through, df.schema), ["s"], "v", "t", ["id"], 20).collect()] == [900]
    assert passed.value == 2 * len(data)


def test_only_runs_and_ends_leave_their_block(spark, monkeypatch):
    written, materialize = [], spikes.materialize
    monkeypatch.setattr(spikes, "materialize", lambda df: written.append(materialize(df)) or written[-1])
    ts = lambda k: dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=k)
    data = [("a", ts(k), k, 7 if 500 <= k < 512 else 0 if 600 <= k < 700 else 9 if 800 <= k < 811 else 1000 + k) for k in range(1000)]
    df = spark.createDataFrame(data, "src string, ts timestamp, id bigint, v bigint")
    assert {r["row_id"] for r in spikes.stuck_rows(df, "src", "ts", "id", ["v"]).collect()} == set(range(500, 512))
    assert [w.count() for w in written] == [12 + 2]


def test_spikes_and_runs_of_many_keys(spark, monkeypatch):
    from tests.oracle import DATA, compare, connect

    # Beyond the broadcast, the profiles of the sources meet their readings by a salted key.
    monkeypatch.setattr("tidemill.plans.physical.BROADCAST_BYTES", 0)
    compare(spark, connect(), problems.p4_found, problems.ORACLES["p4_found"], DATA)
