"""Exact percentiles against numpy, and the stated error of merged sketches."""

import datetime as dt
import random

import numpy as np
import pytest

from tidemill.llm import percentiles, queries
from tidemill.operators import spikes


def test_percentiles(spark):
    rng = random.Random(2)
    data = [(k, float(rng.choice([rng.gauss(0, 100), 7, rng.randrange(20)]))) for k, n in (("a", 700), ("b", 3), (None, 40), ("one", 1)) for _ in range(n)] + [("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame([(*r, 1) for r in data], "k string, x double, n int").repartition(5)
    got = {(r["k"], r["share"]): r["percentile"] for r in percentiles.percentiles(df, ["k"], "x", [0.0, 0.5, 0.94, 1.0]).collect()}
    for k in ("a", "b", None, "one"):
        values = [v for x, v in data if x == k and v is not None and v == v]
        for s in (0.0, 0.5, 0.94, 1.0):
            assert got[k, s] == pytest.approx(np.quantile(values, s))
    assert len(got) == 16


def test_equal_values_and_empty(spark, rows):
    df = spark.createDataFrame([("a", 5)] * 50, "k string, x bigint")
    assert rows(percentiles.percentiles(df, ["k"], "x", [0.5])) == [("a", 0.5, 5.0, 50)]
    assert rows(percentiles.percentiles(df.where("false"), ["k"], "x", [0.5])) == []


def test_merged_sketch_error(spark):
    rng = random.Random(4)
    day = lambda k: dt.datetime(1970, 1, 1 + k % 20, tzinfo=dt.timezone.utc)
    data = [("a", day(k), int(rng.lognormvariate(6, 2)) + 1) for k in range(3000)]
    sketches = percentiles.daily_sketches(spark.createDataFrame(data, "k string, t timestamp, x bigint"), ["k"], "t", "x", 0.01)
    values = sorted(v for *_, v in data)
    for r in percentiles.sketch_percentiles(percentiles.merge_sketches(sketches, ["k"]), ["k"], [0.5, 0.95, 0.99], 0.01).collect():
        exact = values[int(np.ceil(r["share"] * len(values))) - 1]
        assert abs(r["percentile"] - exact) <= 0.01 * exact


def test_mergeable_over_all_rows(spark, tmp_path):
    rng = random.Random(5)
    day = lambda k: dt.datetime(1970, 1, 1 + k % 20, tzinfo=dt.timezone.utc)
    data = [(e, day(k), rng.choice([0, None, -rng.randrange(1, 500), rng.randrange(1, 10**5)])) for e, n in (("a", 700), (None, 90), ("b", 3)) for k in range(n)]
    data += [("zero", day(k), 0) for k in range(5)] + [("none", day(1), None)]
    spark.createDataFrame(data, "endpoint_id string, timestamp timestamp, token_load bigint").write.parquet(str(tmp_path / "series_5min.parquet"))
    got = {(r["endpoint_id"], r["share"]): r for r in queries.p5_mergeable(spark, str(tmp_path)).collect()}
    assert len(got) == 12
    for (e, s), r in got.items():
        values = sorted(v for k, _, v in data if k == e and v is not None)
        exact = values[int(np.ceil(s * len(values))) - 1]
        assert (r["exact"], r["n"]) == (exact, len(values))
        assert abs(r["percentile"] - exact) <= queries.ERROR * abs(exact) + 0.001 and r["error"] <= queries.ERROR


def test_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "PIVOTS", 3)
    rng = random.Random(6)
    data = [(k, float(rng.choice([rng.gauss(0, 1), 0.25, rng.randrange(4)]))) for k, n in (("a", 4000), ("b", 50)) for _ in range(n)] + [("inf", float("inf")), ("inf", 1.0), ("inf", float("-inf"))]
    got = {(r["k"], r["share"]): r["percentile"] for r in percentiles.percentiles(spark.createDataFrame(data, "k string, v double").repartition(6), ["k"], "v", [0.1, 0.5, 0.999], at_rank=True).collect()}
    for (k, s), x in got.items():
        values = sorted(v for g, v in data if g == k)
        assert x == values[max(int(np.ceil(s * len(values))) - 1, 0)]
    assert len(got) == 9


def test_sketch_of_small_numbers_and_first_rank(spark):
    values = [0.001, 0.002, 0.5, -0.25, -3.0, 1e-12, 0.0, 1.0, 1e250]
    sketch = spikes.quantile_sketch(spark.createDataFrame([("a", v) for v in values], "k string, x double"), ["k"], "x", 0.01)
    ordered = sorted(values)
    shares = [0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0]
    got = {r["share"]: r["percentile"] for r in percentiles.sketch_percentiles(sketch, ["k"], shares, 0.01).collect()}
    assert set(got) == set(shares)
    for s, x in got.items():
        exact = ordered[max(int(np.ceil(s * len(ordered))) - 1, 0)]
        assert abs(x - exact) <= 0.01 * abs(exact)
