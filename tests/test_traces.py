"""Cleaning, grid, features, baselines and metrics on small hand-made cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import scalars
from tidemill.operators import baselines, bootstrap, cleaning, eda, features, grid, metrics, models, recurrent, segments
from tidemill.plans.physical import drop_written, materialize, salted_join, sized_join, skew_semi_join
from tidemill.sources import traces
from tidemill.streaming import grid as stream


def moment(seconds):
    return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


REQUEST = "e bigint, timestamp timestamp, model string, log_type string, source_batch string, request_tokens bigint, response_tokens bigint, total_tokens bigint"


def requests(spark, data):
    return spark.createDataFrame([(e, None if s is None else moment(s), "GPT-4", "API log", b, t, 0, t) for e, s, t, b in data], REQUEST)


RAW = "o bigint, timestamp string, model string, request_tokens string, response_tokens string, total_tokens string, log_type string"


def raw(spark, *data):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], RAW)


def test_ledger_counts_the_first_rule(spark):
    good = ("1", "GPT-4", "1", "2", "3", "API log")
    df = raw(spark, good, good, ("x", "", "-1", "2", "3", "a"), ("1", "a", "n/a", "2", "3", "b"), ("1", "a", "-1", "2", "1", "b"), ("1", "a", "-1", "2", "1", "b"), ("1", "a", "1", "2", "-3", "b"), ("1", " ", "1", "2", "3", "b"), ("1", None, "1", "2", "3", "b"), ("1", "a", "1.9", "2", "9", "b"), ("inf", "a", "1", "2", "3", "b"))
    got = {r["reason"]: r["n"] for r in cleaning.ledger(df, cleaning.RAW, "o").collect()}
    assert got == {"unparseable_timestamp": 2, "non_numeric_tokens": 1, "negative_tokens": 3, "critical_missing": 2, "duplicate": 1, "kept": 2}
    clean = cleaning.clean(df, cleaning.RAW, "o", F.lit("1")).orderBy("reported_total_tokens").collect()
    assert [(r["request_tokens"], r["total_tokens"], r["reported_total_tokens"]) for r in clean] == [(1, 3, 3), (1, 3, 9)]
    assert cleaning.total_mismatches(cleaning.clean(df, cleaning.RAW, "o", F.lit("1"))).first()["mismatches"] == 1
    shaped = cleaning.ledger(df.withColumn("shape", F.when(F.col("o") < 2, F.lit("quoting"))), cleaning.RAW, "o", "shape")
    assert {r["reason"]: r["n"] for r in shaped.collect()} == got | {"quoting": 2, "column_count": 0, "duplicate": 0, "kept": 1}
    empty = cleaning.ledger(df.where("false"), cleaning.RAW, "o").agg(F.sum("n")).first()[0]
    assert empty == 0


def test_null_places_are_not_duplicates(spark):
    df = spark.createDataFrame([("a", None, 1), (None, "a", 2), (None, "a", 3)], "x string, y string, o int")
    assert sorted(r["copies"] for r in cleaning.distinct_rows(df, ["x", "y"], "o").collect()) == [1, 2]


def test_order_gaps_over_blocks(spark):
    rng = random.Random(1)
    data = [("f", i, rng.choice([None, float(rng.randrange(20_000))])) for i in range(300)] + [("g", 1, 5.0)]
    df = spark.createDataFrame(data, "file string, o bigint, s double")
    times = [s for f, _, s in data if f == "f" and s is not None]
    steps = [b - a for a, b in zip(times, times[1:])]
    for block in (7, 500_000):
        got = {r["file"]: tuple(r)[1:] for r in cleaning.order_gaps(df, "file", "o", F.col("s"), 3600.0, block).collect()}
        assert got == {"f": (max(steps), sum(x > 3600 for x in steps), sum(x < 0 for x in steps)), "g": (0.0, 0, 0)}


def test_grid_is_left_closed_and_complete(spark):
    series = grid.build_series(requests(spark, [(1, 299.999, 5, "1"), (1, 300, 7, "1"), (1, 1200, 1, "2"), (1, None, 9, "1"), (None, 0, 3, "1")]), "e").orderBy("e", "bin").collect()
    assert [(r["e"], r["bin"], r["token_load"], r["source_batch"]) for r in series] == [(None, 0, 3, "1"), (1, 0, 5, "1"), (1, 1, 7, "1"), (1, 2, 0, "none"), (1, 3, 0, "none"), (1, 4, 1, "2")]
    assert series[3]["mean_request_tokens"] is None and series[3]["is_zero_window"] and series[0]["actual_burst"] is None
    assert grid.build_series(requests(spark, []), "e").count() == 0


def test_threshold_and_splits(spark):
    df = spark.createDataFrame([(1, i, 20, i + 1) for i in range(20)], "e int, bin_idx bigint, n_bins bigint, token_load bigint")
    cut = grid.split_by_position(df)
    assert [cut.where(F.col("split") == s).count() for s in ("train", "valid", "test")] == [14, 3, 3]
    train = cut.where("bin_idx < 10").withColumn("split", F.lit("train"))
    assert grid.thresholds(train, "e").first()["threshold"] == pytest.approx(9.55)
    many = spark.createDataFrame([(34_848, k) for k in (0, 24_392, 24_393, 29_619, 29_620)], "n_bins bigint, bin_idx bigint")
    assert [r["split"] for r in grid.split_by_position(many).orderBy("bin_idx").collect()] == ["train", "train", "valid", "valid", "test"]


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    data = [(e, 300 * k + rng.randrange(300), rng.randrange(1000), rng.choice("12")) for e in (1, 2) for k in range(700) for _ in range(rng.choice([0, 0, 1, 3]))]
    return materialize(grid.build_series(requests(spark, data), "e"))


def test_features_know_only_the_past(spark, series):
    later = series.withColumn("token_load", F.when(F.col("bin_idx") >= 400, F.lit(10**6)).otherwise(F.col("token_load"))).withColumn("request_count", F.when(F.col("bin_idx") >= 400, F.lit(77)).otherwise(F.col("request_count")))
    at = lambda df: sorted(map(tuple, features.feature_matrix(df, "e").where("bin_idx <= 400").select("e", "bin_idx", *features.FEATURES).collect()))
    assert str(at(series)) == str(at(later))
    assert len(features.FEATURES) == 36 and [len(v) for v in features.feature_sets().values()] == [36, 30, 12]


def test_halo_blocks_equal_whole_windows(series):
    columns = ["e", "bin_idx", *[f for f in features.FEATURES if "std" not in f]]
    whole = sorted(map(str, features.feature_matrix(series, "e").select(*columns).collect()))
    for block in (50, 2016):
        assert sorted(map(str, features.feature_matrix(series, "e", True, block).select(*columns).collect())) == whole


def test_horizon_and_baselines(series):
    loads = {(r["e"], r["timestamp"]): r for r in series.collect()}
    ahead = dt.timedelta(minutes=5)
    for r in features.horizon_dataset(features.feature_matrix(series, "e"), "e", 15).where("e = 1").collect()[::40]:
        target = loads[1, r["feature_time"] + 3 * ahead]
        assert r["target"] == target["token_load"] and r["split"] == target["split"] and r["lag_1"] == loads[1, r["feature_time"] - ahead]["token_load"]
    for r in baselines.wide(series, "e", [15]).where("e = 1 and pred_seasonal_15 is not null").collect()[::40]:
        assert r["pred_persistence_15"] == loads[1, r["timestamp"] - 4 * ahead]["token_load"] and r["pred_seasonal_15"] == loads[1, r["timestamp"] - 288 * ahead]["token_load"]
    with pytest.raises(ValueError):
        baselines.wide(series, "e", [1440])
    with pytest.raises(ValueError):
        features.steps_of(7)


def test_metrics_where_undefined(spark):
    df = spark.createDataFrame([(0.0, 0.0, 9.0, False), (0.0, 5.0, 9.0, False)], "y_true double, y_pred double, threshold double, actual_burst boolean")
    r = metrics.evaluate(df, []).first()
    assert r["smape_percent"] == pytest.approx(100.0) and (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)
    p = metrics.average_precision(df, []).first()
    assert (p["average_precision"], p["defined"]) == (0.0, False)


def test_average_precision_over_ties_and_ranges(spark):
    rng = random.Random(9)
    data = [("m", rng.choice([-5.0, 0.0, 0.3, 2.0, 2.0, 1e6, rng.random() * 50]), rng.random() < 0.3) for _ in range(300)]
    got = metrics.average_precision(spark.createDataFrame(data, "m string, y_pred double, actual_burst boolean"), ["m"]).first()["average_precision"]
    total, seen, hits, want = sum(b for *_, b in data), 0, 0, 0.0
    for s in sorted({x for _, x, _ in data}, reverse=True):
        group = [b for _, x, b in data if x == s]
        seen, hits = seen + len(group), hits + sum(group)
        want += sum(group) / total * hits / seen
    assert got == pytest.approx(want)


def test_bootstrap_equals_resampling(spark):
    rng = random.Random(3)
    data = [(1, moment(86_400 * d + 300 * k), rng.random() * 10, rng.random() * 10, 5.0) for d in range(6) for k in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(data, "m int, timestamp timestamp, y_true double, y_pred double, threshold double")
    blocks = bootstrap.day_blocks(df, ["m"])
    drawn = bootstrap.draws(blocks.groupBy("m").agg(F.max("blocks").alias("blocks")), ["m"], 20, 42)
    times = {}
    for r in drawn.collect():
        times.setdefault(r["replicate"], {})[r["pos"]] = r["times"]
    assert all(sum(t.values()) == 6 for t in times.values()) and len({str(sorted(t.items())) for t in times.values()}) > 10
    for r in bootstrap.replicate_metrics(blocks, drawn, ["m"]).collect():
        rows = [x for x in data for _ in range(times[r["replicate"]].get(x[1].day - 1, 0))]
        assert r["mae"] == pytest.approx(sum(abs(a - b) for _, _, a, b, _ in rows) / len(rows))


def test_bootstrap_precision_equals_resampling(spark, monkeypatch):
    rng = random.Random(5)
    score = lambda: rng.choice([0.0, -2.0, 3.0, 3.0, float(rng.randrange(1, 400)), rng.random() * 9])
    data = [(m, moment(86_400 * d + 300 * k), score(), rng.random() < 0.2) for m, days in (("a", 9), (None, 4)) for d in range(days) for k in range(rng.randrange(1, 30))]
    data += [("a", moment(86_400), None, True), ("b", moment(0), 1.0, False)]
    df = spark.createDataFrame(data, "m string, timestamp timestamp, y_pred double, actual_burst boolean")
    replicates, n_days = 30, {"a": 9, None: 4, "b": 1}
    sizes = spark.createDataFrame(list(n_days.items()), "m string, blocks bigint")
    times = {(r["m"], r["replicate"], r["pos"]): r["times"] for r in bootstrap.draws(sizes, ["m"], replicates, 42).collect()}
    assert {(p, r): n for (m, r, p), n in times.items() if m == "a"} == {(p, r): bootstrap.drawn_times(9, replicates, 42)[p, r] for p, r in zip(*np.nonzero(bootstrap.drawn_times(9, replicates, 42)), strict=True)}
    want = {}
    for m in n_days:
        for r in range(replicates):
            rows = [(x, b) for k, t, x, b in data if k == m for _ in range(times.get((m, r, t.day - 1), 0))]
            total, seen, hits, ap = sum(b for _, b in rows), 0, 0, 0.0
            for x in sorted({x for x, _ in rows if x is not None}, reverse=True):
                group = [b for y, b in rows if y == x]
                seen, hits = seen + len(group), hits + sum(group)
                ap += sum(group) / max(total, 1) * hits / seen
            want[m, r] = ap
    for slice_rows, cells in ((10, 60), (50_000, 1_000_000)):
        monkeypatch.setattr(bootstrap, "SLICE_ROWS", slice_rows)
        monkeypatch.setattr(bootstrap, "CELLS", cells)
        got = {(r["m"], r["replicate"]): r["average_precision"] for r in bootstrap.replicate_precision(df, ["m"], replicates, 42).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()}
    ends = {r["m"]: (r["low"], r["high"]) for r in bootstrap.bootstrap_precision(df, ["m"], replicates, 42).collect()}
    assert ends == {m: tuple(pytest.approx(float(x)) for x in np.percentile([want[m, r] for r in range(replicates)], [2.5, 97.5])) for m in n_days}


def test_segments_and_phases(spark):
    got = spark.createDataFrame([(moment(6 * 3600),), (moment(6 * 3600 - 1),), (moment(7 * 86_400 + 5),)], "t timestamp").select(segments.day_part(F.col("t")), segments.week_phase(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("06–12h", "Relative phase 1"), ("00–06h", "Relative phase 1"), ("00–06h", "Relative phase 1")]
    levels = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (0, 0, 0.5)], "a bigint, n bigint, m double").select(segments.share_level(F.col("a"), F.col("n"), F.col("m"))).collect()
    assert [r[0] for r in levels] == ["Low", "High", None]


def test_nearest_day_takes_the_earlier(spark):
    days = spark.createDataFrame([(1, d, v) for d, v in ((5, 10), (2, 30), (9, 20), (1, 20))], "e int, day_no bigint, tokens bigint")
    assert tuple(eda.nearest_to_median(days, ["e"], "day_no", "tokens").first()) == (1, 1, 20)
    assert [round(x, 6) for x in eda.levinson_durbin([1.0, 0.5, 0.25])] == [1.0, 0.5, 0.0]


def test_scalars(spark):
    df = spark.createDataFrame([("1",), (" True ",), ("no",), (None,)], "x string")
    assert [r[0] for r in df.select(scalars.parse_bool_lenient(F.col("x"))).collect()] == [True, True, False, False]
    with pytest.raises(Exception, match="not a boolean"):
        df.select(scalars.parse_bool_strict(F.col("x"))).collect()
    texts = ["1", " 2.5 ", "1e3", ".5", "5.", "1d", "0x1", "inf", "NaN", "", None, "١"]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select(scalars.coerce_numeric(F.col("x"))).collect()
    assert [r[0] for r in got] == [1.0, 2.5, 1000.0, 0.5, 5.0, None, None, None, None, None, None, None]
    assert scalars.sig3(1234.5) == "1.23e+03" and scalars.sig3(None) == ""
    buckets = spark.createDataFrame([(0.0,), (9.99,), (10.0,)], "x double").select(scalars.clamped_bucket(F.col("x"), 0, 10, 5)).collect()
    assert [r[0] for r in buckets] == [1, 5, 5]


def test_upsert_and_one_to_one(spark, rows):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    b = spark.createDataFrame([(2, "x"), (None, "y"), (3, "z")], "k int, v string")
    assert rows(metrics.upsert(a, b, ["k"])) == [(1, "a"), (2, "x"), (3, "z"), (None, "y")]
    with pytest.raises(Exception, match="repeated join key"):
        metrics.one_to_one(a.unionByName(a), b.withColumnRenamed("v", "w"), ["k"]).collect()


def test_sources_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "Id int, `Log Type` string")
    traces.write_csv(df, str(tmp_path / "c"))
    assert rows(traces.scan_csv(spark, str(tmp_path / "c"), ["log_type"])) == [("1", 'a "b", c'), ("2", None)]
    with pytest.raises(ValueError, match="missing columns: nope"):
        traces.scan_csv(spark, str(tmp_path / "c"), ["nope"])
    (tmp_path / "m.csv").write_text('Id,Log Type\n1,"a\nb"\n2\n3,d,extra\n4,"x,""y"""\n')
    assert rows(traces.scan_csv(spark, str(tmp_path / "m.csv"))) == [("1", "a\nb"), ("4", 'x,"y"')]
    assert [r["record"] for r in traces.rejected_csv(spark, str(tmp_path / "m.csv")).collect()] == ["2", "3,d,extra"]
    assert traces.scan_csv(spark, str(tmp_path / "m.csv")).count() == 2
    traces.write_parquet(df, str(tmp_path / "p"), ["Id"])
    assert traces.scan_parquet(spark, str(tmp_path / "p"), ["Id"]).count() == 2
    traces.report_csv(spark.createDataFrame([(1, 1234.5, None)], "a int, b double, c double"), str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text() == "a,b,c\n1,1.23e+03,\n"


def test_stream_equals_batch(spark, tmp_path, rows):
    rng = random.Random(2)
    data = requests(spark, [(e, rng.randrange(100_000), rng.randrange(50), "1") for e in (1, 2) for _ in range(300)])
    late = requests(spark, [(9, 400_000, 1, "1")])
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = stream.read_requests(spark, str(tmp_path / "in"), data.schema, 1)
    stream.run_once(stream.stream_windows(source, "e", "3 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = rows(spark.read.parquet(str(tmp_path / "out")).where("e < 9"))
    assert got == rows(stream.stream_windows(data, "e"))


def test_joins_that_spread(spark, rows):
    big = spark.createDataFrame([(k, i) for i in range(200) for k in ([None, 1][i % 2], i)], "k int, id int")
    small = spark.createDataFrame([(None, "n"), (1, "one"), (7, "seven")], "k int, v string")
    want = rows(big.alias("a").join(small.withColumnRenamed("k", "j"), F.col("k").eqNullSafe(F.col("j"))).select("k", "id", "v"))
    assert rows(salted_join(big, small, ["k"], ["id"])) == want == rows(sized_join(big, materialize(small), ["k"], ["id"])) == rows(sized_join(big, small, ["k"], ["id"], rows=10**9))
    assert salted_join(big, small, ["k"], ["id"], "left").count() == big.count()
    counted = materialize(big.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k in (1, 7)"))
    for parts in (2, 10_000):
        assert rows(skew_semi_join(big, counted, ["k"], "n", parts)) == rows(big.where("k in (1, 7)"))
    materialize(small)
    assert drop_written(spark) > 0


def test_model_candidates_are_set():
    assert models.candidates(4, 1) == models.candidates(4, 1) and len({str(c) for c in models.candidates(12)}) == 12


def test_trees_find_a_step_and_survive_a_dump():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 5))
    y = np.where(x[:, 1] > 0.3, 5.0, -1.0) + 2 * x[:, 3]
    model = models.Trees.fit(x, y, 3, 60, 0.2, 5)
    assert np.mean((model.predict(x) - y) ** 2) < 0.05 * np.var(y) and set(model.gain.argsort()[-2:]) == {1, 3}
    assert np.allclose(models.Trees.parse(model.dump()).predict(x), model.predict(x))
    assert models.Trees.fit(x[:0], y[:0], 3, 5, 0.1, 1).predict(x[:2]).tolist() == [0, 0]
    assert len(set(models.Trees.fit(x[:1], y[:1], 3, 5, 0.1, 1).predict(x).tolist())) == 1


def test_recurrent_gradients_and_learning():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(6, 4, 3)), rng.normal(size=6)
    net = recurrent.Lstm.start(3, 4, 1)
    guess, held = net.forward(x)
    for w, g in zip(net.w, net.gradients(x, held, guess - y), strict=True):
        at = tuple(0 for _ in w.shape)
        loss = []
        for e in (1e-6, -2e-6):
            w[at] += e
            loss.append(0.5 * np.mean((net.predict(x) - y) ** 2))
        w[at] += 1e-6
        assert (loss[0] - loss[1]) / 2e-6 == pytest.approx(g[at], abs=1e-6)
    x = rng.normal(size=(1500, 8, 2))
    y = 0.8 * x[:, -1, 0] - 0.5 * x[:, -3, 1]
    model, history = recurrent.train(x[:1200], y[:1200], x[1200:], y[1200:], 8, 0.0)
    assert min(h[2] for h in history) < 0.4 * np.var(y) and np.mean((model.predict(x[1200:]) - y[1200:]) ** 2) == pytest.approx(min(h[2] for h in history))
    stopped = recurrent.train(x[:100], rng.normal(size=100), x[100:200], rng.normal(size=100), 8, 0.0, epochs=30, patience=2)[1]
    assert len(stopped) < 30
