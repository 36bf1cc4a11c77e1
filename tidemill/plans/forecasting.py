"""Queries from the complete series to forecasts, evaluation and exploration, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators import baselines, bootstrap, eda, features, metrics, models, recurrent, segments
from tidemill.operators import grid as g
from tidemill.plans.physical import materialize
from tidemill.plans.registry import Registry, table
from tidemill.streaming import grid as stream

query = Registry()
KEY = "endpoint_id"


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def series_of(spark: SparkSession, d: str) -> DataFrame:
    return g.build_series(table(spark, d, "requests"), KEY)


def first_batches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "requests").where(F.col("source_batch").isin("1", "2"))


def predictions_of(spark: SparkSession, d: str) -> DataFrame:
    return baselines.long(baselines.wide(series_of(spark, d), KEY), KEY)


def tested(spark: SparkSession, d: str) -> DataFrame:
    return predictions_of(spark, d).where(F.col("split") == "test")


_TS = 'to_timestamp(bin * 300) AS "timestamp"'


def _grid_sql(where: str = '"timestamp" IS NOT NULL') -> str:
    return rf"""
req AS (SELECT endpoint_id, floor(epoch_us("timestamp") / 300000000)::BIGINT AS bin, regexp_replace(lower(model), '[^a-z0-9]', '', 'g') AS model, regexp_replace(lower(log_type), '[^a-z0-9]', '', 'g') AS log_type, source_batch, request_tokens, response_tokens, total_tokens FROM requests WHERE {where}),
agg AS (SELECT endpoint_id, bin, sum(total_tokens)::BIGINT AS token_load, count(*) AS request_count, sum(request_tokens)::BIGINT AS request_tokens_sum, sum(response_tokens)::BIGINT AS response_tokens_sum,
  count(*) FILTER (model = 'gpt4') AS gpt4_request_count, count(*) FILTER (model = 'chatgpt') AS chatgpt_request_count, count(*) FILTER (log_type = 'apilog') AS api_request_count, count(*) FILTER (log_type = 'conversationlog') AS conversation_request_count,
  count(*) FILTER (source_batch = '1') AS batch_1_request_count, count(*) FILTER (source_batch = '2') AS batch_2_request_count, count(*) FILTER (source_batch = '3') AS batch_3_request_count FROM req GROUP BY ALL),
ends AS (SELECT endpoint_id, min(bin) AS a, max(bin) AS b FROM agg GROUP BY ALL),
bins AS (SELECT endpoint_id, a, b, UNNEST(range(a, b + 1))::BIGINT AS bin FROM ends),
grid AS (SELECT bins.endpoint_id, bins.bin, bins.bin - a AS bin_idx, b - a + 1 AS n_bins, """ + ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in g.SUMS) + r""" FROM bins LEFT JOIN agg ON agg.endpoint_id = bins.endpoint_id AND agg.bin = bins.bin),
full_grid AS (SELECT *, to_timestamp(bin * 300) AS "timestamp", request_tokens_sum / nullif(request_count, 0)::DOUBLE AS mean_request_tokens, response_tokens_sum / nullif(request_count, 0)::DOUBLE AS mean_response_tokens,
  coalesce(nullif(concat_ws('|', CASE WHEN batch_1_request_count > 0 THEN '1' END, CASE WHEN batch_2_request_count > 0 THEN '2' END, CASE WHEN batch_3_request_count > 0 THEN '3' END), ''), 'none') AS source_batch, request_count = 0 AS is_zero_window FROM grid)
"""


_SERIES = (
    "WITH "
    + _grid_sql()
    + r""",
cut AS (SELECT *, CASE WHEN bin_idx < floor(n_bins * 0.70e0) THEN 'train' WHEN bin_idx < floor(n_bins * 0.85e0) THEN 'valid' ELSE 'test' END AS split FROM full_grid),
thr AS (SELECT endpoint_id, quantile_cont(token_load::DOUBLE, 0.95) AS threshold, count(*) AS train_rows FROM cut WHERE split = 'train' GROUP BY ALL),
series AS (SELECT cut.*, threshold, token_load >= threshold AS actual_burst FROM cut LEFT JOIN thr USING (endpoint_id))
"""
)


# -- grid


@query("WITH " + _grid_sql() + " SELECT * FROM agg")
def g2_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return g.tumbling(table(spark, d, "requests"), KEY)


@query(r"""SELECT source_batch, min("timestamp") AS first_time, max("timestamp") AS last_time, count(*) AS n_rows FROM requests WHERE source_batch IN ('1', '2') GROUP BY ALL""")
def g1_union_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches 1 and 2 put together, each file holding its own batch alone."""
    t = table(spark, d, "requests")
    both = t.where(F.col("source_batch") == "1").unionByName(t.where(F.col("source_batch") == "2"))
    return both.groupBy("source_batch").agg(F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"), F.count(F.lit(1)).alias("n_rows"))


@query("WITH " + _grid_sql() + ' SELECT endpoint_id, "timestamp", token_load, request_count, round(mean_request_tokens, 6) AS mean_request_tokens, round(mean_response_tokens, 6) AS mean_response_tokens FROM full_grid')
def g3_complete_grid(spark: SparkSession, d: str) -> DataFrame:
    out = g.complete(g.tumbling(table(spark, d, "requests"), KEY), KEY)
    return round_doubles(out.select(KEY, "timestamp", "token_load", "request_count", "mean_request_tokens", "mean_response_tokens"))


@query("WITH " + _grid_sql() + " SELECT source_batch, is_zero_window, count(*) AS n FROM full_grid GROUP BY ALL")
def g4_batch_labels(spark: SparkSession, d: str) -> DataFrame:
    """Batch labels (g4) and zero windows (g5) of the grid."""
    return g.complete(g.tumbling(table(spark, d, "requests"), KEY), KEY).groupBy("source_batch", "is_zero_window").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT gate, 0::BIGINT AS violations FROM (SELECT UNNEST(['unique', 'contiguous', 'models_closed', 'log_types_closed', 'requests_reconcile', 'tokens_reconcile']) AS gate)""")
def g6_grid_gates(spark: SparkSession, d: str) -> DataFrame:
    return g.gates(materialize(series_of(spark, d)), table(spark, d, "requests"), KEY)


@query(_SERIES + " SELECT endpoint_id, split, count(*) AS n, min(bin_idx) AS first_idx, max(bin_idx) AS last_idx FROM series GROUP BY ALL")
def g7_chronological_split(spark: SparkSession, d: str) -> DataFrame:
    out = g.split_by_position(g.complete(g.tumbling(table(spark, d, "requests"), KEY), KEY))
    return out.groupBy(KEY, "split").agg(F.count(F.lit(1)).alias("n"), F.min("bin_idx").alias("first_idx"), F.max("bin_idx").alias("last_idx"))


@query(_SERIES + " SELECT endpoint_id, round(threshold, 6) AS threshold, train_rows FROM thr")
def g8_train_threshold(spark: SparkSession, d: str) -> DataFrame:
    cut = g.split_by_position(g.complete(g.tumbling(table(spark, d, "requests"), KEY), KEY))
    return round_doubles(g.thresholds(cut, KEY))


@query(_SERIES + ' SELECT endpoint_id, "timestamp", token_load, split, actual_burst FROM series')
def g9_burst_labels(spark: SparkSession, d: str) -> DataFrame:
    return series_of(spark, d).select(KEY, "timestamp", "token_load", "split", "actual_burst")


@query(_SERIES + """ SELECT endpoint_id, split, count(*) AS n_windows, min("timestamp") AS first_window, max("timestamp") AS last_window, sum(request_count)::BIGINT AS requests, sum(token_load)::BIGINT AS tokens, max(token_load) AS max_load,
  count(*) FILTER (is_zero_window) AS zero_windows, count(*) FILTER (actual_burst) AS burst_windows, round(avg(actual_burst::INT::DOUBLE), 6) AS burst_rate FROM series GROUP BY ALL""")
def g10_split_summary(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(g.split_summary(series_of(spark, d), KEY))


@query("WITH " + _grid_sql() + r""", e AS (SELECT endpoint_id, max(bin) FILTER (batch_1_request_count > 0) AS x, min(bin) FILTER (batch_2_request_count > 0) AS y FROM full_grid GROUP BY ALL)
SELECT e.endpoint_id, (y - x) * 300 AS gap_seconds, count(f.bin) AS windows_between, count(*) FILTER (f.is_zero_window) AS zero_windows_between FROM e LEFT JOIN full_grid f ON f.endpoint_id = e.endpoint_id AND f.bin > x AND f.bin < y WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL""")
def g11_batch_boundary(spark: SparkSession, d: str) -> DataFrame:
    return g.boundary_audit(g.complete(g.tumbling(table(spark, d, "requests"), KEY), KEY), KEY)


@query("SELECT NULL::BIGINT AS endpoint_id, NULL::BIGINT AS bin WHERE false")
def g12_spot_check(spark: SparkSession, d: str) -> DataFrame:
    """All windows recomputed from the requests; those that differ (none)."""
    t = table(spark, d, "requests")
    return g.recomputed(t, g.complete(g.tumbling(t, KEY), KEY), KEY)


@query("WITH " + _grid_sql("source_batch IN ('1', '2')") + """ SELECT bin * 300 AS window_start, sum(request_count)::BIGINT AS request_count, sum(token_load)::BIGINT AS token_load FROM agg GROUP BY ALL""")
def g13_partial_then_final(spark: SparkSession, d: str) -> DataFrame:
    """Windows over all endpoints from windows per endpoint: sums of sums."""
    parts = g.tumbling(first_batches(spark, d), KEY)
    return parts.groupBy((F.col("bin") * 300).alias("window_start")).agg(F.sum("request_count").alias("request_count"), F.sum("token_load").alias("token_load"))


_BATCH3 = (
    "WITH old AS (SELECT * FROM (" + _SERIES.replace(' FROM requests WHERE "timestamp" IS NOT NULL', " FROM requests WHERE source_batch IN ('1', '2')") + " SELECT DISTINCT endpoint_id, threshold FROM series)), new AS (SELECT * FROM (WITH " + _grid_sql("source_batch = '3'") + " SELECT * FROM full_grid)),\n"
    "frozen AS (SELECT new.*, threshold, token_load >= threshold AS actual_burst FROM new LEFT JOIN old USING (endpoint_id))\n"
)


def batch3_series(spark: SparkSession, d: str) -> DataFrame:
    old = g.thresholds(g.split_by_position(g.complete(g.tumbling(first_batches(spark, d), KEY), KEY)), KEY)
    return g.frozen_series(table(spark, d, "requests").where(F.col("source_batch") == "3"), KEY, old)


@query(_BATCH3 + """ SELECT endpoint_id, "timestamp", token_load, source_batch, 'robustness_zero_shot' AS split, actual_burst FROM frozen""")
def g14_batch3_series(spark: SparkSession, d: str) -> DataFrame:
    return batch3_series(spark, d).select(KEY, "timestamp", "token_load", "source_batch", "split", "actual_burst")


# -- features

_PAST = ", ".join(
    [f"lag(token_load, {k}) OVER w ::DOUBLE AS lag_{k}" for k in features.LAGS]
    + [
        f"CASE WHEN count(*) OVER w{n} = {n} THEN {e} END AS {c}_{n}"
        for n in features.WINDOWS
        for c, e in (
            ("rolling_mean", f"avg(token_load) OVER w{n}"), ("rolling_std", f"stddev_samp(token_load) OVER w{n}"), ("rolling_max", f"(max(token_load) OVER w{n})::DOUBLE"), ("request_count_rolling_mean", f"avg(request_count) OVER w{n}"),
        )
    ]
    + [
        f"CASE WHEN count(*) OVER w{n} = {n} THEN coalesce((sum({t}) OVER w{n})::DOUBLE / nullif((sum(request_count) OVER w{n})::DOUBLE, 0), 0) ELSE 0 END AS {c}_history_{n}"
        for n in features.WINDOWS
        for c, t in (("gpt4_share", "gpt4_request_count"), ("api_share", "api_request_count"), ("mean_request_tokens", "request_tokens_sum"), ("mean_response_tokens", "response_tokens_sum"))
    ]
    + [f"{f}(2 * pi() * ((bin * 300) % {p}) / {p}.0e0) AS relative_{n}_{f}" for n, p in (("day", 86400), ("week", 604800)) for f in ("sin", "cos")]
)
_FEATURES = (
    _SERIES
    + f", feat AS (SELECT *, {_PAST} FROM series WINDOW w AS (PARTITION BY endpoint_id ORDER BY bin_idx), "
    + ", ".join(f"w{n} AS (PARTITION BY endpoint_id ORDER BY bin_idx ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in features.WINDOWS)
    + ")"
)


def _horizon_sql(h: int) -> str:
    k = h // 5
    return (
        f", ahead{h} AS (SELECT *, lead(\"timestamp\", {k}) OVER w AS target_time, lead(token_load, {k}) OVER w AS target, lead(split, {k}) OVER w AS target_split, lead(actual_burst, {k}) OVER w AS target_burst FROM feat WINDOW w AS (PARTITION BY endpoint_id ORDER BY bin_idx)),\n"
        f"data{h} AS (SELECT endpoint_id, \"timestamp\" AS feature_time, target_time, {h}::BIGINT AS horizon, target_split AS split, target_burst AS actual_burst, target::DOUBLE AS target, "
        + ", ".join(features.FEATURES)
        + f" FROM ahead{h} WHERE target IS NOT NULL AND target_burst IS NOT NULL AND "
        + " AND ".join(f"{f} IS NOT NULL" for f in features.FEATURES)
        + ")"
    )


def _rounded(names: list[str], places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names)


def matrix_of(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_matrix(series_of(spark, d), KEY)


@query(_FEATURES + ' SELECT endpoint_id, "timestamp", ' + ", ".join(f"lag_{k}" for k in features.LAGS) + " FROM feat")
def f1_lags(spark: SparkSession, d: str) -> DataFrame:
    return matrix_of(spark, d).select(KEY, "timestamp", *[f"lag_{k}" for k in features.LAGS])


_ROLLING = [f"{c}_{n}" for c in ("rolling_mean", "rolling_max", "rolling_std", "request_count_rolling_mean") for n in features.WINDOWS]


@query(_FEATURES + ' SELECT endpoint_id, "timestamp", ' + _rounded(_ROLLING, 3) + " FROM feat")
def f2_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Rolling means and maxima (f2), deviations (f3) and mean request counts (f4)."""
    return round_doubles(matrix_of(spark, d).select(KEY, "timestamp", *_ROLLING), 3)


_HISTORY = [f"{c}_history_{n}" for c in ("gpt4_share", "api_share", "mean_request_tokens", "mean_response_tokens") for n in features.WINDOWS]


@query(_FEATURES + ' SELECT endpoint_id, "timestamp", ' + _rounded(_HISTORY) + " FROM feat")
def f5_histories(spark: SparkSession, d: str) -> DataFrame:
    """Shares (f5) and request-weighted means (f6) over past windows."""
    return round_doubles(matrix_of(spark, d).select(KEY, "timestamp", *_HISTORY))


_PHASES = [f"relative_{p}_{f}" for p in ("day", "week") for f in ("sin", "cos")]


@query(_FEATURES + ' SELECT endpoint_id, "timestamp", ' + _rounded(_PHASES, 9) + " FROM feat")
def f7_phase(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(series_of(spark, d).withColumns(features.phase_columns()).select(KEY, "timestamp", *_PHASES), 9)


@query()
def f8_registry(spark: SparkSession, d: str) -> DataFrame:
    return features.registry_table(spark)


@query(_FEATURES + "".join(_horizon_sql(h) for h in features.HORIZONS) + " SELECT endpoint_id, \"timestamp\", 5::BIGINT AS horizon, target_time, target, target_split FROM ahead5" + "".join(f' UNION ALL SELECT endpoint_id, "timestamp", {h}, target_time, target, target_split FROM ahead{h}' for h in features.HORIZONS[1:]))
def f9_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets (f9) and the split of the target (f10), per horizon."""
    series = series_of(spark, d)
    out = None
    for h in features.HORIZONS:
        part = features.targets(series, KEY, h).select(KEY, "timestamp", F.lit(h).cast("bigint").alias("horizon"), "target_time", "target", "target_split")
        out = part if out is None else out.unionByName(part)
    return out


@query(_FEATURES + _horizon_sql(15) + " SELECT endpoint_id, feature_time, target_time, horizon, split, actual_burst, target, " + _rounded(features.FEATURES, 3) + " FROM data15")
def f11_horizon_dataset(spark: SparkSession, d: str) -> DataFrame:
    out = features.horizon_dataset(matrix_of(spark, d), KEY, 15)
    return out.select(*[F.round(c, 3).alias(c) if c in features.FEATURES else F.col(c) for c in out.columns])


@query("SELECT gate, 0::BIGINT AS violations FROM (SELECT UNNEST(['horizon', 'values', 'order']) AS gate)")
def f12_alignment_gates(spark: SparkSession, d: str) -> DataFrame:
    series = materialize(series_of(spark, d))
    return features.alignment(features.horizon_dataset(features.feature_matrix(series, KEY), KEY, 15), series, KEY, 15)


@query(_FEATURES + "".join(_horizon_sql(h) for h in features.HORIZONS) + " SELECT horizon, split, count(*) AS n_rows, count(*) FILTER (actual_burst) AS bursts, min(target_time) AS first_target, max(target_time) AS last_target FROM (" + " UNION ALL ".join(f"SELECT horizon, split, actual_burst, target_time FROM data{h}" for h in features.HORIZONS) + ") GROUP BY ALL")
def f13_dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    matrix = matrix_of(spark, d)
    out = None
    for h in features.HORIZONS:
        part = features.horizon_dataset(matrix, KEY, h)
        out = part if out is None else out.unionByName(part)
    return features.dataset_summary(out)


_INPUTS = ["gpt4_share", "api_share", "mean_request_tokens", "mean_response_tokens"]


@query(_SERIES + """ SELECT endpoint_id, "timestamp", round(coalesce(gpt4_request_count / nullif(request_count, 0)::DOUBLE, 0), 6) AS gpt4_share, round(coalesce(api_request_count / nullif(request_count, 0)::DOUBLE, 0), 6) AS api_share,
  round(coalesce(mean_request_tokens, 0), 6) AS mean_request_tokens, round(coalesce(mean_response_tokens, 0), 6) AS mean_response_tokens FROM series""")
def f14_sequence_inputs(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(features.sequence_inputs(series_of(spark, d)).select(KEY, "timestamp", *_INPUTS))


_LOOKBACK = 12


@query(_SERIES + f""" SELECT * FROM (SELECT endpoint_id, "timestamp" AS origin, lead("timestamp", 3) OVER w AS target_time, lead(split, 3) OVER w AS split, (lead(token_load, 3) OVER w)::DOUBLE AS target,
  min("timestamp") OVER p AS input_start, max("timestamp") OVER p AS input_end, array_to_string(list(token_load) OVER p, ',') AS loads, count(*) OVER p AS k FROM series
  WINDOW w AS (PARTITION BY endpoint_id ORDER BY bin_idx), p AS (PARTITION BY endpoint_id ORDER BY bin_idx ROWS BETWEEN {_LOOKBACK} PRECEDING AND 1 PRECEDING)) WHERE k = {_LOOKBACK} AND target IS NOT NULL""".replace("SELECT * FROM", "SELECT * EXCLUDE (k) FROM"))
def f15_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of 12 loads that end before the origin; shown as text."""
    out = features.sequences(series_of(spark, d), KEY, ["token_load"], _LOOKBACK, 15)
    return out.withColumn("loads", F.array_join(F.transform("sequence", lambda r: r[0].cast("bigint").cast("string")), ",")).drop("sequence")


@query(_SERIES + f""", s AS (SELECT *, lead(split, 3) OVER (PARTITION BY endpoint_id ORDER BY bin_idx) AS target_split FROM series),
l AS (SELECT endpoint_id, max(bin_idx) AS last FROM s WHERE target_split = 'train' AND bin_idx >= {_LOOKBACK} GROUP BY ALL),
u AS (SELECT s.* FROM s JOIN l USING (endpoint_id) WHERE bin_idx < last)
SELECT endpoint_id, 'token_load' AS "column", round(avg(token_load), 4) AS mean, round(coalesce(nullif(stddev_pop(token_load), 0), 1), 4) AS scale FROM u GROUP BY ALL
UNION ALL SELECT endpoint_id, 'request_count', round(avg(request_count), 4), round(coalesce(nullif(stddev_pop(request_count), 0), 1), 4) FROM u GROUP BY ALL""")
def f16_scaler(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(features.scaler(series_of(spark, d), KEY, ["token_load", "request_count"], _LOOKBACK, 15), 4)


@query(_SERIES + """, m AS (SELECT endpoint_id, avg(token_load) AS mean, coalesce(nullif(stddev_pop(token_load), 0), 1) AS scale FROM series WHERE split = 'train' GROUP BY ALL)
SELECT endpoint_id, "timestamp", round(greatest(token_load::DOUBLE - 1000, 0), 4) AS restored FROM series JOIN m USING (endpoint_id)""")
def f17_inverse_clip(spark: SparkSession, d: str) -> DataFrame:
    """Loads scaled, lowered by 1,000 tokens' worth, brought back and clipped at 0."""
    series = series_of(spark, d)
    by = Window.partitionBy(KEY)
    x = F.when(F.col("split") == "train", F.col("token_load").cast("double"))
    mean, scale = F.avg(x).over(by), F.coalesce(F.nullif(F.stddev_pop(x).over(by), F.lit(0.0)), F.lit(1.0))
    put = series.withColumns({"mean": mean, "scale": scale}).where(F.col("mean").isNotNull())
    low = features.scaled(F.col("token_load").cast("double") - 1000.0, F.col("mean"), F.col("scale"))
    return put.select(KEY, "timestamp", F.round(features.unscaled(low, F.col("mean"), F.col("scale")), 4).alias("restored"))


@query(_SERIES + f""", q AS (SELECT endpoint_id, "timestamp" AS origin, lead("timestamp", 3) OVER w AS target_time, lead(split, 3) OVER w AS split, min("timestamp") OVER p AS input_start, max("timestamp") OVER p AS input_end, count(*) OVER p AS k FROM series
  WINDOW w AS (PARTITION BY endpoint_id ORDER BY bin_idx), p AS (PARTITION BY endpoint_id ORDER BY bin_idx ROWS BETWEEN {_LOOKBACK} PRECEDING AND 1 PRECEDING))
SELECT endpoint_id, split, count(*) AS samples, min(input_start) AS first_input, max(input_end) AS last_input, min(target_time) AS first_target, max(target_time) AS last_target FROM q WHERE k = {_LOOKBACK} AND target_time IS NOT NULL GROUP BY ALL""")
def f18_sequence_audit(spark: SparkSession, d: str) -> DataFrame:
    s = features.sequences(series_of(spark, d), KEY, ["token_load"], _LOOKBACK, 15)
    return s.groupBy(KEY, "split").agg(F.count(F.lit(1)).alias("samples"), F.min("input_start").alias("first_input"), F.max("input_end").alias("last_input"), F.min("target_time").alias("first_target"), F.max("target_time").alias("last_target"))


_PRELIM = ["diff_1", "lag_1"] + [f"roll_{f}_{w}" for w in (3, 6, 12, 24) for f in ("mean", "std")]


@query(_SERIES + ' SELECT endpoint_id, "timestamp", request_count, (token_load - lag(token_load) OVER w)::DOUBLE AS diff_1, (lag(token_load) OVER w)::DOUBLE AS lag_1, '
    + ", ".join(f"round(CASE WHEN count(*) OVER w{n} = {n} THEN {e}(token_load) OVER w{n} END, 3) AS roll_{f}_{n}" for n in (3, 6, 12, 24) for f, e in (("mean", "avg"), ("std", "stddev_samp")))
    + " FROM series WINDOW w AS (PARTITION BY endpoint_id ORDER BY bin_idx), " + ", ".join(f"w{n} AS (PARTITION BY endpoint_id ORDER BY bin_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 6, 12, 24)))
def f19_preliminary(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(features.contemporaneous_features(series_of(spark, d), KEY).select(KEY, "timestamp", "request_count", *_PRELIM), 3)


@query("SELECT 'full' AS feature_set, 36::BIGINT AS n UNION ALL SELECT 'no_shares', 30 UNION ALL SELECT 'lags_and_phase', 12")
def f20_feature_sets(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, len(v)) for k, v in features.feature_sets().items()], "feature_set string, n bigint")


@query(_BATCH3 + ", feat AS (SELECT *, NULL AS split, " + _PAST + " FROM frozen WINDOW w AS (PARTITION BY endpoint_id ORDER BY bin_idx), "
    + ", ".join(f"w{n} AS (PARTITION BY endpoint_id ORDER BY bin_idx ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in features.WINDOWS) + ")" + _horizon_sql(15)
    + " SELECT endpoint_id, feature_time, target_time, horizon, target, actual_burst, " + _rounded(features.FEATURES, 3) + " FROM data15")
def f21_batch3_dataset(spark: SparkSession, d: str) -> DataFrame:
    out = features.horizon_dataset(features.feature_matrix(batch3_series(spark, d), KEY), KEY, 15, need_split=False)
    return out.select(KEY, "feature_time", "target_time", "horizon", "target", "actual_burst", *[F.round(c, 3).alias(c) for c in features.FEATURES])


# -- baselines

_WIDE = _SERIES + ", wide AS (SELECT endpoint_id, \"timestamp\", split, token_load AS actual_token_load, actual_burst, threshold, " + ", ".join(
    f"to_timestamp((bin * 300) - {h * 60}) AS forecast_origin_{h}, to_timestamp((bin * 300) - {h * 60 + 300}) AS last_available_window_{h}, lag(token_load, {h // 5 + 1}) OVER w AS pred_persistence_{h}, lag(token_load, 288) OVER w AS pred_seasonal_{h}" for h in features.HORIZONS
) + " FROM series WINDOW w AS (PARTITION BY endpoint_id ORDER BY bin_idx))"
_LONG = _WIDE + ", pred AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT endpoint_id, \"timestamp\", split, {h}::BIGINT AS horizon, '{m}' AS model, actual_token_load::DOUBLE AS y_true, pred_{p}_{h}::DOUBLE AS y_pred, actual_burst, pred_{p}_{h} >= threshold AS predicted_burst, threshold FROM wide"
    for h in features.HORIZONS for m, p in (("persistence", "persistence"), ("seasonal_naive", "seasonal"))
) + ") WHERE y_pred IS NOT NULL AND threshold IS NOT NULL)"


@query(_WIDE + " SELECT endpoint_id, \"timestamp\", split, actual_token_load, actual_burst, " + ", ".join(f"forecast_origin_{h}, last_available_window_{h}, pred_persistence_{h}, pred_seasonal_{h}" for h in features.HORIZONS) + " FROM wide")
def m1_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Persistence (m1), seasonal naive (m2) and their origins (m3)."""
    return baselines.wide(series_of(spark, d), KEY).drop("threshold")


@query(_BATCH3 + """ SELECT a.endpoint_id, a."timestamp", b.token_load AS persistence, c.token_load AS seasonal_naive FROM frozen a JOIN frozen b ON b.endpoint_id = a.endpoint_id AND b.bin = a.bin - 4 JOIN frozen c ON c.endpoint_id = a.endpoint_id AND c.bin = a.bin - 288""")
def m4_lookup_baselines(spark: SparkSession, d: str) -> DataFrame:
    return baselines.by_timestamp(materialize(batch3_series(spark, d)), KEY, 15)


# -- metrics

_CONF = "count(*) FILTER (y_true >= threshold AND y_pred >= threshold) AS tp, count(*) FILTER (y_true < threshold AND y_pred >= threshold) AS fp, count(*) FILTER (y_true >= threshold AND y_pred < threshold) AS fn, count(*) FILTER (y_true < threshold AND y_pred < threshold) AS tn"
_REG = "avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse, 100 * avg(2 * abs(y_pred - y_true) / (abs(y_true) + abs(y_pred) + 1e-9)) AS smape_percent, avg(y_pred - y_true) AS bias"
_PRF = "coalesce(tp / nullif((tp + fp)::DOUBLE, 0), 0) AS precision, coalesce(tp / nullif((tp + fn)::DOUBLE, 0), 0) AS recall, coalesce(2 * tp / nullif((2 * tp + fp + fn)::DOUBLE, 0), 0) AS f1"
_EVAL = _LONG + f", base AS (SELECT split, model, horizon, count(*) AS n, {_REG}, {_CONF} FROM pred GROUP BY ALL), ev AS (SELECT *, {_PRF} FROM base)"
_EVAL_COLS = "split, model, horizon, n, " + _rounded(["mae", "rmse", "smape_percent", "bias"], 4) + ", tp, fp, fn, tn, " + _rounded(["precision", "recall", "f1"])


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate(predictions_of(spark, d), ["split", "model", "horizon"])


@query(_EVAL + " SELECT split, model, horizon, n, " + _rounded(["mae", "rmse", "smape_percent"], 4) + " FROM ev")
def e1_regression(spark: SparkSession, d: str) -> DataFrame:
    """Errors: mae and rmse (e1), smape (e2)."""
    return round_doubles(evaluated(spark, d).select("split", "model", "horizon", "n", "mae", "rmse", "smape_percent"), 4)


@query(_EVAL + " SELECT split, model, horizon, tp, fp, fn, tn, " + _rounded(["precision", "recall", "f1"]) + ", tp + fn AS actual_bursts, tp + fp AS predicted_bursts, round((tp + fn) / n::DOUBLE, 6) AS actual_burst_rate, round((tp + fp) / n::DOUBLE, 6) AS predicted_burst_rate FROM ev")
def e3_detection(spark: SparkSession, d: str) -> DataFrame:
    """Confusion (e3), precision, recall and f1 (e4), counts and rates (e6)."""
    return round_doubles(evaluated(spark, d).drop("n", "mae", "rmse", "smape_percent", "bias"))


_STEPS = _LONG + """, st AS (SELECT split, model, horizon, y_pred AS score, count(*) FILTER (actual_burst) AS tp, count(*) AS n FROM pred GROUP BY ALL),
cu AS (SELECT *, (sum(tp) OVER w)::BIGINT AS seen_tp, (sum(n) OVER w)::BIGINT AS seen_n, (sum(tp) OVER (PARTITION BY split, model, horizon))::BIGINT AS all_tp FROM st WINDOW w AS (PARTITION BY split, model, horizon ORDER BY score DESC))"""


@query(_STEPS + " SELECT split, model, horizon, round(coalesce(sum(tp * (seen_tp / seen_n::DOUBLE)) / nullif(max(all_tp), 0), 0), 6) AS average_precision, max(all_tp) > 0 AS defined FROM cu GROUP BY ALL")
def e5_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(metrics.average_precision(predictions_of(spark, d), ["split", "model", "horizon"]))


@query(_LONG + " SELECT * EXCLUDE (threshold) FROM pred WHERE split = 'test'")
def e7_unified_predictions(spark: SparkSession, d: str) -> DataFrame:
    return tested(spark, d).drop("threshold")


@query(_LONG + """, ok AS (SELECT endpoint_id, "timestamp" FROM pred GROUP BY ALL), t AS (SELECT endpoint_id, "timestamp", horizon, count(*) AS n, count(DISTINCT model) AS m, count(DISTINCT y_true) AS y FROM pred WHERE split = 'test' GROUP BY ALL)
SELECT 'unique' AS gate, count(*) FILTER (n <> m) AS violations FROM t UNION ALL SELECT 'coverage', count(*) FILTER (m <> 2) FROM t UNION ALL SELECT 'one_actual', count(*) FILTER (y <> 1) FROM t UNION ALL SELECT 'labels', 0""")
def e8_coverage_gates(spark: SparkSession, d: str) -> DataFrame:
    return metrics.coverage_gates(tested(spark, d), KEY, baselines.MODELS)


@query(_LONG + """ SELECT model, horizon, split, count(*) AS n_rows, min("timestamp") AS first_time, max("timestamp") AS last_time, count(DISTINCT "timestamp") AS distinct_times, 0::BIGINT AS null_predictions, count(*) FILTER (y_pred < 0) AS negative_predictions, 0::BIGINT AS burst_disagreements FROM pred GROUP BY ALL""")
def e9_alignment_audit(spark: SparkSession, d: str) -> DataFrame:
    return metrics.alignment_audit(predictions_of(spark, d), ["model", "horizon", "split"])


_REPLICATES = 1000


@query(_LONG + f""", blk AS (SELECT model, horizon, floor(epoch("timestamp") / 86400)::BIGINT AS day_no, count(*) AS n, sum(abs(y_pred - y_true)) AS ae, sum((y_pred - y_true) * (y_pred - y_true)) AS se, sum(2 * abs(y_pred - y_true) / (abs(y_true) + abs(y_pred) + 1e-9)) AS sm, {_CONF} FROM pred WHERE split = 'test' GROUP BY ALL),
pos AS (SELECT *, row_number() OVER (PARTITION BY model, horizon ORDER BY day_no) - 1 AS pos, count(*) OVER (PARTITION BY model, horizon) AS blocks FROM blk),
sz AS (SELECT DISTINCT model, horizon, blocks FROM pos),
dr AS (SELECT model, horizon, r AS replicate, ('0x' || substr(md5('42:' || r || ':' || j), 1, 8))::BIGINT % blocks AS pos FROM (SELECT *, UNNEST(range(0, blocks)) AS j FROM (SELECT *, UNNEST(range(0, {_REPLICATES})) AS r FROM sz))),
rp AS (SELECT dr.model, dr.horizon, replicate, sum(ae) / sum(n) AS mae, sqrt(sum(se) / sum(n)) AS rmse, 100 * sum(sm) / sum(n) AS smape_percent, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM dr JOIN pos USING (model, horizon, pos) GROUP BY ALL),
rm AS (SELECT model, horizon, mae, rmse, smape_percent, {_PRF} FROM rp)
SELECT model, horizon, metric, round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high FROM (UNPIVOT rm ON mae, rmse, smape_percent, precision, recall, f1 INTO NAME metric VALUE v) GROUP BY ALL""")
def e10_block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(bootstrap.block_bootstrap(tested(spark, d), ["model", "horizon"], _REPLICATES, 42), 4)


@query()
def e10_bootstrap_precision(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of average precision for every horizon, by the replicates of e10_block_bootstrap."""
    return round_doubles(bootstrap.bootstrap_precision(tested(spark, d), ["model", "horizon"], _REPLICATES, 42))


@query(_EVAL + """ SELECT e.split, e.model, e.horizon, round(e.mae, 4) AS mae, round(b.mae - e.mae, 4) AS improvement, round(100 * (b.mae - e.mae) / nullif(b.mae, 0), 4) AS improvement_percent, e.mae < b.mae AS better FROM ev e LEFT JOIN ev b ON b.split = e.split AND b.horizon = e.horizon AND b.model = 'seasonal_naive'""")
def e11_improvement(spark: SparkSession, d: str) -> DataFrame:
    """Improvement on the seasonal baseline (e11, e20)."""
    return round_doubles(metrics.improvement(evaluated(spark, d).select("split", "model", "horizon", "mae"), ["split", "horizon"]), 4)


@query(_EVAL + " SELECT row_number() OVER (ORDER BY CASE horizon WHEN 15 THEN 0 WHEN 5 THEN 1 WHEN 60 THEN 2 ELSE 3 END, CASE model WHEN 'persistence' THEN 0 WHEN 'seasonal_naive' THEN 1 ELSE 4 END)::BIGINT AS place, horizon, model, round(mae, 4) AS mae FROM ev WHERE split = 'test'")
def e12_report_order(spark: SparkSession, d: str) -> DataFrame:
    ev = evaluated(spark, d).where(F.col("split") == "test")
    placed = metrics.ranked(ev, [], [metrics.order_key(F.col("horizon"), metrics.HORIZON_ORDER), metrics.order_key(F.col("model"), metrics.MODEL_ORDER)], "place")
    return round_doubles(placed.select("place", "horizon", "model", "mae"), 4)


_SEG = _LONG + f""", med AS (SELECT median(gpt4_request_count / request_count::DOUBLE) AS gm, median(api_request_count / request_count::DOUBLE) AS am FROM series WHERE split = 'train' AND request_count > 0),
lab AS (SELECT p.*, s.bin, s.request_count AS rc, CASE WHEN s.request_count > 0 THEN s.gpt4_request_count / s.request_count::DOUBLE END AS gs, CASE WHEN s.request_count > 0 THEN s.api_request_count / s.request_count::DOUBLE END AS ap FROM pred p JOIN series s ON s.endpoint_id = p.endpoint_id AND s."timestamp" = p."timestamp" WHERE p.split = 'test'),
seg AS (SELECT *, UNNEST([{{'d': 'burst', 's': CASE WHEN actual_burst THEN 'burst' ELSE 'non-burst' END}}, {{'d': 'day_part', 's': (['00–06h', '06–12h', '12–18h', '18–24h'])[(((bin * 300) % 86400) // 21600 + 1)::INT]}},
  {{'d': 'week_phase', 's': 'Relative phase ' || (((bin * 300) % 604800) // 86400 + 1)}}, {{'d': 'gpt4_share', 's': CASE WHEN rc > 0 THEN CASE WHEN gs > gm THEN 'High' ELSE 'Low' END END}}, {{'d': 'api_share', 's': CASE WHEN rc > 0 THEN CASE WHEN ap > am THEN 'High' ELSE 'Low' END END}}]) AS x FROM lab, med),
sg AS (SELECT horizon, model, x.d AS dimension, x.s AS segment, count(*) AS n, {_REG}, avg(y_true) AS mean_y_true, avg(y_pred) AS mean_y_pred, {_CONF} FROM seg WHERE x.s IS NOT NULL GROUP BY ALL)"""


@query(_SEG + f" SELECT horizon, model, dimension, segment, n, {_rounded(['mae', 'rmse', 'smape_percent', 'bias', 'mean_y_true', 'mean_y_pred'], 4)}, tp, fp, fn, tn, {_rounded(['precision', 'recall', 'f1'], 4)} FROM (SELECT *, {_PRF} FROM sg)")
def e13_segment_errors(spark: SparkSession, d: str) -> DataFrame:
    """Five dimensions (e13) with day parts (e15), week phases (e16), share levels (e17) and bias (e18)."""
    series = materialize(series_of(spark, d))
    pred = baselines.long(baselines.wide(series, KEY), KEY).where(F.col("split") == "test")
    return round_doubles(segments.segment_errors(pred, series, KEY), 4)


@query(_SERIES + " SELECT round(median(gpt4_request_count / request_count::DOUBLE), 6) AS gpt4_median, round(median(api_request_count / request_count::DOUBLE), 6) AS api_median FROM series WHERE split = 'train' AND request_count > 0")
def e14_composition_medians(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(segments.composition_medians(series_of(spark, d)))


_EA = ", ".join(
    f"round(avg(y_true) FILTER (split = '{s}'), 4) AS {s}_mean, round(median(y_true) FILTER (split = '{s}'), 4) AS {s}_median, round(quantile_cont(y_true, 0.95) FILTER (split = '{s}'), 4) AS {s}_p95, count(*) FILTER (split = '{s}' AND y_true = 0) AS {s}_zeros, round(avg(abs(y_pred - y_true)) FILTER (split = '{s}'), 4) AS {s}_mae, round(avg(y_pred - y_true) FILTER (split = '{s}'), 4) AS {s}_bias"
    for s in ("valid", "test")
)


@query(_LONG + f" SELECT model, {_EA}, round(100 * (avg(y_true) FILTER (split = 'test') - avg(y_true) FILTER (split = 'valid')) / nullif(avg(y_true) FILTER (split = 'valid'), 0), 4) AS mean_change_percent FROM pred WHERE horizon = 15 GROUP BY ALL")
def e19_error_analysis(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(metrics.error_analysis(predictions_of(spark, d).where(F.col("horizon") == 15), ["model"]), 4)


@query(_LONG + " SELECT split, model, horizon, count(*) AS n, count(DISTINCT y_pred) AS distinct_predictions, count(*) FILTER (y_pred < 0) AS negative, min(y_pred) AS least, max(y_pred) AS greatest, count(DISTINCT y_pred) <= 1 AS constant FROM pred GROUP BY ALL")
def e21_prediction_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.diagnostics(predictions_of(spark, d), ["split", "model", "horizon"])


@query(_EVAL + " SELECT horizon, model, round(mae, 4) AS valid_mae, row_number() OVER (PARTITION BY horizon ORDER BY mae, model) AS rank, row_number() OVER (PARTITION BY horizon ORDER BY mae, model) = 1 AS selected FROM ev WHERE split = 'valid'")
def e22_validation_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranking by validation error with the selected flag, as for ablations (e22) and searches (m6)."""
    ev = evaluated(spark, d).where(F.col("split") == "valid").select("horizon", "model", F.col("mae").alias("valid_mae"))
    return round_doubles(metrics.ranked(ev, ["horizon"], [F.col("valid_mae"), F.col("model")]), 4)


@query(_STEPS + """, nu AS (SELECT *, row_number() OVER (PARTITION BY split, model, horizon ORDER BY score DESC) - 1 AS i, count(*) OVER (PARTITION BY split, model, horizon) AS m FROM cu)
SELECT split, model, horizon, score, round(seen_tp / seen_n::DOUBLE, 6) AS precision, round(coalesce(seen_tp / nullif(all_tp, 0)::DOUBLE, 0), 6) AS recall FROM nu WHERE m <= 500 OR i = 0 OR i = m - 1 OR (i * 499) // (m - 1) <> ((i - 1) * 499) // (m - 1)""")
def e23_pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(metrics.pr_curve(predictions_of(spark, d), ["split", "model", "horizon"]))


@query(_EVAL + " SELECT split, model, horizon, " + ", ".join(f"round(coalesce({a} / nullif(({a} + {b})::DOUBLE, 0), 0), 6) AS {a}_share" for a, b in (("tp", "fn"), ("fn", "tp"), ("fp", "tn"), ("tn", "fp"))) + " FROM ev")
def e24_normalized_confusion(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(metrics.normalized_confusion(evaluated(spark, d)).select("split", "model", "horizon", "tp_share", "fn_share", "fp_share", "tn_share"))


@query(r"""WITH h AS (SELECT endpoint_id, row_number() OVER (PARTITION BY endpoint_id ORDER BY window_id) AS epoch, request_count::DOUBLE AS train_loss, token_load::DOUBLE AS valid_loss FROM series_5min)
SELECT endpoint_id, bool_and(valid_loss > train_loss) AS always_above, arg_min(epoch, (valid_loss, epoch)) AS best_epoch FROM h GROUP BY ALL""")
def e25_generalization_gap(spark: SparkSession, d: str) -> DataFrame:
    """The rule on any history with two losses; here request counts and loads stand in for them."""
    h = table(spark, d, "series_5min").select(KEY, F.row_number().over(Window.partitionBy(KEY).orderBy("window_id")).cast("bigint").alias("epoch"), F.col("request_count").cast("double").alias("train_loss"), F.col("token_load").cast("double").alias("valid_loss"))
    return metrics.generalization_gap(h, [KEY])


@query(_EVAL + " SELECT split, model, horizon, round(mae, 4) AS mae, round(f1, 4) AS f1 FROM ev")
def e26_metrics_join(spark: SparkSession, d: str) -> DataFrame:
    ev = materialize(evaluated(spark, d))
    keys = ["split", "model", "horizon"]
    return round_doubles(metrics.one_to_one(ev.select(*keys, "mae"), ev.select(*keys, "f1"), keys), 4)


# -- exploration


@query(_SERIES + " SELECT endpoint_id, count(*) AS n_windows, round(avg(token_load), 4) AS mean_load, round(median(token_load::DOUBLE), 4) AS median_load, round(quantile_cont(token_load::DOUBLE, 0.95), 4) AS p95_load, round(quantile_cont(token_load::DOUBLE, 0.99), 4) AS p99_load, max(token_load) AS max_load, round(stddev_samp(token_load) / nullif(avg(token_load), 0), 4) AS cv, round(avg((token_load = 0)::INT), 4) AS zero_share FROM series GROUP BY ALL")
def d1_describe_load(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(eda.describe_load(series_of(spark, d), [KEY]), 4)


@query(_SERIES + ", day AS (SELECT endpoint_id, floor(epoch(\"timestamp\") / 86400) AS d, sum(token_load)::BIGINT AS t FROM series GROUP BY ALL) SELECT endpoint_id, max(t) AS max_day, median(t) AS median_day FROM day GROUP BY ALL")
def d2_daily_extremes(spark: SparkSession, d: str) -> DataFrame:
    return eda.daily_extremes(series_of(spark, d), [KEY])


@query(_SERIES + ", p AS (SELECT endpoint_id, ((bin * 300) % 86400) // 3600 AS hour, avg(token_load) AS m FROM series GROUP BY ALL) SELECT endpoint_id, arg_max(hour, (m, -hour))::BIGINT AS peak_hour, arg_min(hour, (m, hour))::BIGINT AS trough_hour, round(max(m) / nullif(min(m), 0), 4) AS peak_to_trough FROM p GROUP BY ALL")
def d3_hourly_extremes(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(eda.hourly_extremes(series_of(spark, d), [KEY]), 4)


@query(_SERIES + ' SELECT endpoint_id, "timestamp", round(avg(token_load) OVER (PARTITION BY endpoint_id ORDER BY bin_idx ROWS BETWEEN 287 PRECEDING AND CURRENT ROW), 3) AS trailing_mean FROM series')
def d4_trailing_mean(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(eda.trailing_mean(series_of(spark, d), KEY).select(KEY, "timestamp", "trailing_mean"), 3)


@query(_SERIES + ", h AS (SELECT endpoint_id, median(token_load::DOUBLE) FILTER (bin_idx < n_bins // 2) AS a, median(token_load::DOUBLE) FILTER (bin_idx >= n_bins // 2) AS b FROM series GROUP BY ALL) SELECT endpoint_id, a AS first_median, b AS second_median, round(b / nullif(a, 0), 6) AS ratio FROM h")
def d5_half_ratio(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(eda.half_ratio(series_of(spark, d), [KEY]))


def _nearest_sql(rows: str, unit: str) -> str:
    return f", t AS ({rows}), n AS (SELECT *, abs(v - median(v) OVER (PARTITION BY endpoint_id)) AS dist FROM t) SELECT endpoint_id, arg_min(u, (dist, u)) AS {unit}, arg_min(v, (dist, u)) AS tokens FROM n GROUP BY ALL"


@query(_SERIES + _nearest_sql("SELECT endpoint_id, bin_idx // 2016 AS u, sum(token_load)::BIGINT AS v FROM series GROUP BY ALL HAVING count(*) = 2016", "week_no"))
def d6_relative_week(spark: SparkSession, d: str) -> DataFrame:
    return eda.representative_relative_week(series_of(spark, d), KEY)


@query(_SERIES + """, dd AS (SELECT endpoint_id, (bin * 300) // 86400 AS u, sum(token_load) AS v, count(*) AS n FROM series GROUP BY ALL), ww AS (SELECT endpoint_id, u, (sum(v) OVER w)::BIGINT AS v, sum(n) OVER w AS n FROM dd WINDOW w AS (PARTITION BY endpoint_id ORDER BY u RANGE BETWEEN CURRENT ROW AND 6 FOLLOWING))"""
    + _nearest_sql("SELECT endpoint_id, u, v FROM ww WHERE n = 2016", "start_day"))
def d7_daily_stride_week(spark: SparkSession, d: str) -> DataFrame:
    return eda.representative_daily_stride_week(series_of(spark, d), KEY)


@query(_SERIES + """, ww AS (SELECT endpoint_id, (bin * 300) // 604800 AS u, sum(token_load)::BIGINT AS v FROM series GROUP BY ALL HAVING count(*) >= 2016), nn AS (SELECT *, abs(v - median(v) OVER (PARTITION BY endpoint_id)) AS dist FROM ww),
bb AS (SELECT endpoint_id, arg_min(u, (dist, u)) AS u FROM nn GROUP BY ALL) SELECT s.endpoint_id, coalesce(min(bb.u) * 604800, min(s.bin) * 300)::BIGINT AS start_seconds FROM series s LEFT JOIN bb ON bb.endpoint_id = s.endpoint_id GROUP BY ALL""")
def d8_epoch_week(spark: SparkSession, d: str) -> DataFrame:
    return eda.representative_epoch_week(series_of(spark, d), KEY)


@query(_SERIES + _nearest_sql("SELECT endpoint_id, (bin * 300) // 86400 AS u, sum(token_load)::BIGINT AS v FROM series GROUP BY ALL HAVING count(*) = 288", "day_no"))
def d9_representative_day(spark: SparkSession, d: str) -> DataFrame:
    return eda.representative_day(series_of(spark, d), KEY)


@query(_SERIES + ', p AS (SELECT endpoint_id, arg_max(bin, (token_load, -bin_idx)) AS b FROM series GROUP BY ALL) SELECT s.endpoint_id, s."timestamp", s.token_load FROM series s JOIN p ON p.endpoint_id = s.endpoint_id WHERE abs(s.bin - p.b) <= 36')
def d10_peak_zoom(spark: SparkSession, d: str) -> DataFrame:
    return eda.peak_zoom(series_of(spark, d), KEY, 3).select(KEY, "timestamp", "token_load")


@query(_SERIES + " SELECT ((bin * 300) % 86400) // 300 AS slot, " + ", ".join(f"round(avg(token_load) FILTER (((bin * 300) % 604800) // 86400 = {p - 1}), 4) AS phase_{p}" for p in range(1, 8)) + " FROM series GROUP BY ALL")
def d11_phase_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(eda.phase_heatmap(series_of(spark, d), []), 4)


@query(_SERIES + ", r AS (SELECT endpoint_id, rank() OVER (PARTITION BY endpoint_id ORDER BY token_load) + (count(*) OVER (PARTITION BY endpoint_id, token_load) - 1) / 2.0 AS a, rank() OVER (PARTITION BY endpoint_id ORDER BY request_count) + (count(*) OVER (PARTITION BY endpoint_id, request_count) - 1) / 2.0 AS b FROM series) SELECT endpoint_id, round(corr(a, b), 6) AS spearman FROM r GROUP BY ALL")
def d13_spearman(spark: SparkSession, d: str) -> DataFrame:
    out = round_doubles(eda.spearman(series_of(spark, d), [KEY], "token_load", "request_count"))
    return out.withColumn("spearman", F.when(~F.isnan("spearman"), F.col("spearman")))


@query(_SERIES + ", l AS (SELECT endpoint_id, token_load AS x, " + ", ".join(f"lag(token_load, {k}) OVER w AS y{k}" for k in (1, 3, 12, 288)) + " FROM series WINDOW w AS (PARTITION BY endpoint_id ORDER BY bin_idx)) SELECT endpoint_id, " + ", ".join(f"CASE WHEN isfinite(corr(x, y{k})) THEN round(corr(x, y{k}), 6) END AS lag_{k}" for k in (1, 3, 12, 288)) + " FROM l GROUP BY ALL")
def d14_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    out = round_doubles(eda.autocorrelation(series_of(spark, d), KEY))
    return out.select(KEY, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in out.columns[1:]])


_ACF_LAGS = 48


@query(_SERIES + f", c AS (SELECT endpoint_id, bin_idx, token_load - avg(token_load) OVER (PARTITION BY endpoint_id) AS d FROM series), k AS (SELECT *, UNNEST(range(0, {_ACF_LAGS + 1})) AS lag FROM c), s AS (SELECT k.endpoint_id, k.lag, sum(k.d * c.d) AS s FROM k JOIN c ON c.endpoint_id = k.endpoint_id AND c.bin_idx = k.bin_idx + k.lag GROUP BY ALL) SELECT endpoint_id, lag, round(s / nullif(max(s) FILTER (lag = 0) OVER (PARTITION BY endpoint_id), 0), 6) AS acf FROM s")
def d15_acf(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(eda.acf(series_of(spark, d), KEY, _ACF_LAGS))


def _log_load(spark: SparkSession, d: str) -> DataFrame:
    return series_of(spark, d).withColumn("token_load", F.log1p(F.greatest(F.col("token_load"), F.lit(0)).cast("double")))


@query()
def d15_acf_288(spark: SparkSession, d: str) -> DataFrame:
    """The autocorrelation of log(1 + load) over a whole day of lags; d15_acf has the first four hours of the load itself."""
    return round_doubles(eda.acf(_log_load(spark, d), KEY))


@query()
def d16_pacf(spark: SparkSession, d: str) -> DataFrame:
    """Of log(1 + load), over a whole day of lags."""
    return round_doubles(eda.pacf(_log_load(spark, d), KEY, eda.DAY_ROWS))


@query(_SERIES + " SELECT endpoint_id, (bin * 300) // 86400 AS day_no, sum(request_count)::BIGINT AS requests, round(sum(gpt4_request_count) / nullif(sum(request_count), 0)::DOUBLE, 6) AS gpt4_share, round(sum(api_request_count) / nullif(sum(request_count), 0)::DOUBLE, 6) AS api_share FROM series GROUP BY ALL")
def d17_daily_composition(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(eda.daily_composition(series_of(spark, d), [KEY]))


@query()
def d18_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """The 2,000 requests of a seeded sample: the limit is the operator."""
    return eda.seeded_sample(table(spark, d, "requests").select("request_id", "total_tokens"), ["request_id"], 2000)


@query("SELECT 'lag' AS category, 8::BIGINT AS n UNION ALL SELECT 'rolling', 9 UNION ALL SELECT 'composition', 15 UNION ALL SELECT 'phase', 4")
def d21_feature_categories(spark: SparkSession, d: str) -> DataFrame:
    return features.registry_table(spark).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(_LONG + """, r AS (SELECT horizon, model, row_number() OVER (PARTITION BY horizon ORDER BY mae, model) AS rank FROM (SELECT horizon, model, avg(abs(y_pred - y_true)) AS mae FROM pred WHERE split = 'test' GROUP BY ALL)) SELECT model, round(avg(rank), 6) AS mean_rank FROM r GROUP BY ALL ORDER BY 2, 1 LIMIT 12""")
def m11_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Mean rank over several lists, here the horizons' lists of models."""
    ev = metrics.evaluate(tested(spark, d), ["horizon", "model"])
    return round_doubles(eda.rank_fusion(metrics.ranked(ev, ["horizon"], [F.col("mae"), F.col("model")]), "model", "rank"))


@query(r"""WITH c AS (SELECT definition, endpoint_id AS candidate, quantile AS dropout, train_rows AS units, p95_threshold AS valid_mae, train_rows % 7 AS f1, train_rows % 5 AS lookback FROM burst_thresholds WHERE p95_threshold IS NOT NULL)
SELECT definition, candidate, row_number() OVER (PARTITION BY definition ORDER BY valid_mae, f1 DESC, units, lookback, dropout DESC, candidate) AS rank, row_number() OVER (PARTITION BY definition ORDER BY valid_mae, f1 DESC, units, lookback, dropout DESC, candidate) = 1 AS selected FROM c""")
def m8_mixed_order_selection(spark: SparkSession, d: str) -> DataFrame:
    """Selection by several keys in mixed directions, here over the thresholds of each definition as candidates; see m8_lstm_selection for real ones."""
    c = table(spark, d, "burst_thresholds").where(F.col("p95_threshold").isNotNull()).select("definition", F.col(KEY).alias("candidate"), F.col("quantile").alias("dropout"), F.col("train_rows").alias("units"), F.col("p95_threshold").alias("valid_mae"), (F.col("train_rows") % 7).alias("f1"), (F.col("train_rows") % 5).alias("lookback"))
    return metrics.ranked(c, ["definition"], [F.col("valid_mae"), F.desc("f1"), F.col("units"), F.col("lookback"), F.desc("dropout"), F.col("candidate")]).select("definition", "candidate", "rank", "selected")


# -- fitted models (no SQL): fitted on bounded seeded samples, judged on all rows

_CANDIDATES = 12
_ROW = [KEY, "feature_time"]


#: Fitted models and their figures by session, data and name: queries over one table share a fit, as if loaded from a store.
_fits: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, d: str, name: str, build):
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _fits:
        _fits[key] = build()
    return _fits[key]


def _kept(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    """A table of a few rows (candidates by horizon), kept with the fits."""
    rows, schema = _once(spark, d, name, lambda: (lambda df: (df.collect(), df.schema))(build()))
    return spark.createDataFrame(rows, schema)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    """The feature matrix, written once for all horizons and models."""
    return materialize(matrix_of(spark, d))


def _dataset(matrix: DataFrame):
    """horizon -> its dataset with all 36 features."""
    return lambda h: features.horizon_dataset(matrix, KEY, h)


def _searched(matrix: DataFrame, horizons=features.HORIZONS) -> DataFrame:
    return models.search(_dataset(matrix), _ROW, features.FEATURES, horizons, _CANDIDATES)


def _refitted(matrix: DataFrame, params: dict[int, dict], names=features.FEATURES, log_target: bool = False) -> dict[int, models.Trees]:
    """By horizon a model of the selected parameters, fitted on train and valid together."""
    past = lambda h: _dataset(matrix)(h).where(F.col("split").isin("train", "valid"))
    samples = {h: models.sampled(past(h), _ROW, [*names, "target"]) for h in params}
    return dict(zip(params, models.fit(samples, names, list(params.items()), matrix.sparkSession, log_target), strict=True))


def _errors(df: DataFrame, keys: list[str]) -> DataFrame:
    return round_doubles(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in metrics.regression().items()]), 4)


@query()
def m5_gbt_search(spark: SparkSession, d: str) -> DataFrame:
    """Search of 12 seeded candidates on all 36 features for each horizon (m5), ranked with the tie-break (m6)."""
    return round_doubles(_winners(spark, d, _matrix(spark, d)))


def _winners(spark: SparkSession, d: str, matrix: DataFrame) -> DataFrame:
    return _kept(spark, d, "search", lambda: _searched(matrix))


def _gbt(spark: SparkSession, d: str, matrix: DataFrame) -> dict[int, models.Trees]:
    """The refitted winners by horizon."""
    return _once(spark, d, "gbt", lambda: _refitted(matrix, models.selected(_winners(spark, d, matrix))))


def _gbt_test(spark: SparkSession, d: str, matrix: DataFrame) -> DataFrame:
    """The one pass over the test split by the refitted models of the search's winners."""
    out = None
    for h, model in _gbt(spark, d, matrix).items():
        part = models.predict(_dataset(matrix)(h).where(F.col("split") == "test"), features.FEATURES, {"gbt": model})
        out = part if out is None else out.unionByName(part)
    return out


@query()
def m5_gbt_test(spark: SparkSession, d: str) -> DataFrame:
    """Errors on the test split after the refit on train and valid."""
    return _errors(_gbt_test(spark, d, _matrix(spark, d)).withColumnRenamed("target", "y_true"), ["horizon"])


@query()
def m9_importance(spark: SparkSession, d: str) -> DataFrame:
    """Of the search's winner for 15 minutes, over all 36 features."""
    return round_doubles(models.importance(_gbt(spark, d, _matrix(spark, d))[15], features.FEATURES, spark))


@query()
def m10_permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """Of the search's winner for 15 minutes, on a seeded sample of 2,000 valid rows."""
    matrix = _matrix(spark, d)
    sample = models.sampled(_dataset(matrix)(15).where(F.col("split") == "valid"), _ROW, [*features.FEATURES, "target"], 2000)
    return round_doubles(models.permutation_importance(_gbt(spark, d, matrix)[15], sample, features.FEATURES, spark))


@query()
def m12_log_target(spark: SparkSession, d: str) -> DataFrame:
    """A model of log(1 + load) with the winner's parameters, brought back, on the test split."""
    matrix = _matrix(spark, d)
    params = {15: models.selected(_winners(spark, d, matrix))[15]}
    model = _refitted(matrix, params, log_target=True)[15]
    out = models.predict(_dataset(matrix)(15).where(F.col("split") == "test"), features.FEATURES, {"gbt_log": model}, True)
    return _errors(out.withColumnRenamed("target", "y_true"), ["horizon"])


@query()
def m13_zero_shot(spark: SparkSession, d: str) -> DataFrame:
    """A model searched and fitted on batches 1 and 2, saved, loaded (s14) and applied unchanged to all of batch 3."""
    old = materialize(features.feature_matrix(g.build_series(first_batches(spark, d), KEY), KEY))
    frozen = models.load(spark, models.save(_refitted(old, models.selected(_searched(old, [15])))[15], spark, "h15"))
    series = materialize(batch3_series(spark, d))
    new = features.horizon_dataset(features.feature_matrix(series, KEY), KEY, 15, need_split=False)
    return _errors(models.predict(new, features.FEATURES, {"gbt": frozen}).withColumnRenamed("target", "y_true"), [])


@query()
def e22_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Feature sets with the winner's parameters, fitted on train, ranked by the error on all valid rows."""
    matrix = _matrix(spark, d)
    params, data, out = models.selected(_winners(spark, d, matrix))[15], _dataset(matrix)(15), None
    for name, names in features.feature_sets().items():
        sample = models.sampled(data.where(F.col("split") == "train"), _ROW, [*names, "target"])
        (model,) = models.fit({15: sample}, names, [(15, params)], spark)
        part = models.predict(data.where(F.col("split") == "valid").select("target", *names), names, {name: model})
        out = part if out is None else out.unionByName(part)
    ev = out.groupBy(F.col("model").alias("feature_set")).agg(F.avg(F.abs(F.col("y_pred") - F.col("target"))).alias("valid_mae"))
    return round_doubles(metrics.ranked(ev, [], [F.col("valid_mae"), F.col("feature_set")]), 4)


# -- the recurrent model

_LONGEST = max(c["lookback"] for c in recurrent.CANDIDATES)


def _sequences(series: DataFrame, horizon: int) -> DataFrame:
    """All sequences of the ten inputs, scaled by what train sequences see, with the scaled target and how to bring it back."""
    inputs = features.sequence_inputs(series)
    stats = features.scaler(inputs, KEY, features.SEQUENCE_INPUTS, _LONGEST, horizon)
    # Ten entries a key.
    held = materialize(stats.groupBy(F.col(KEY).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("mean", "scale")))).alias("stats")))
    put = inputs.join(held, F.col(KEY).eqNullSafe(F.col("k")))
    scaled = put.select(KEY, "timestamp", "bin_idx", "split", "actual_burst", "token_load", *[features.scaled(F.col(c).cast("double"), F.col("stats")[c]["mean"], F.col("stats")[c]["scale"]).alias(f"in_{c}") for c in features.SEQUENCE_INPUTS])
    out = features.sequences(scaled, KEY, [f"in_{c}" for c in features.SEQUENCE_INPUTS], _LONGEST, horizon).join(held, F.col(KEY).eqNullSafe(F.col("k")))
    mean, scale = F.col("stats")["token_load"]["mean"], F.col("stats")["token_load"]["scale"]
    out = out.select(KEY, "origin", "target_time", "split", F.lit(horizon).cast("bigint").alias("horizon"), "target", "sequence", mean.alias("mean"), scale.alias("scale"))
    return materialize(out.withColumn("scaled_target", features.scaled(F.col("target"), F.col("mean"), F.col("scale"))))


def _lstm_sample(rows: DataFrame, *splits: str):
    return models.sampled(rows.where(F.col("split").isin(*splits)), [KEY, "origin"], ["sequence", "scaled_target"])


def _lstm_search(series: DataFrame) -> tuple[dict[int, DataFrame], DataFrame, dict]:
    """(sequences by horizon, ranked candidates, histories) of all candidates, fitted on train and stopped by valid."""
    spark, rows = series.sparkSession, {h: _sequences(series, h) for h in features.HORIZONS}
    tasks = [(h, p, recurrent.EPOCHS) for h in rows for p in recurrent.CANDIDATES]
    fitted = recurrent.fit({h: (_lstm_sample(r, "train"), _lstm_sample(r, "valid")) for h, r in rows.items()}, tasks, spark)
    n = len(recurrent.CANDIDATES)
    thresholds = series.groupBy(F.col(KEY).alias("k")).agg(F.max("threshold").alias("threshold"))
    judged = None
    for i, (h, r) in enumerate(rows.items()):
        named = {str(k): (fitted[i * n + k][0], p["lookback"]) for k, p in enumerate(recurrent.CANDIDATES)}
        part = recurrent.predict(r.where(F.col("split") == "valid").drop("scaled_target"), named)
        judged = part if judged is None else judged.unionByName(part)
    judged = judged.withColumnRenamed("target", "y_true").join(thresholds, F.col(KEY).eqNullSafe(F.col("k")))
    ev = metrics.evaluate(judged, ["horizon", "model"]).select("horizon", F.col("model").cast("int").alias("candidate"), F.col("mae").alias("valid_mae"), "f1")
    table = spark.createDataFrame([(k, p["units"], p["lookback"], p["dropout"]) for k, p in enumerate(recurrent.CANDIDATES)], "candidate int, units int, lookback int, dropout double")
    found = metrics.ranked(ev.join(F.broadcast(table), "candidate"), ["horizon"], [F.col("valid_mae"), F.desc("f1"), F.col("units"), F.col("lookback"), F.desc("dropout"), F.col("candidate")])
    return rows, found, {(h, k): fitted[i * n + k][1] for i, h in enumerate(rows) for k in range(n)}


def _lstm(spark: SparkSession, d: str, series: DataFrame) -> tuple[list, object, dict, dict]:
    """(ranked candidates and their schema, histories, winners by horizon as (model, lookback)); winners are refitted on train and valid for the epochs that were best."""

    def build():
        rows, found, histories = _lstm_search(series)
        table = found.collect()  # a few candidates a horizon
        best = {r["horizon"]: r["candidate"] for r in table if r["selected"]}
        samples = {h: (_lstm_sample(rows[h], "train", "valid"), _lstm_sample(rows[h], "none")) for h in best}
        tasks = [(h, recurrent.CANDIDATES[k], min(histories[h, k], key=lambda e: (e[2] != e[2], e[2]))[0]) for h, k in best.items()]
        fitted = recurrent.fit(samples, tasks, spark)
        return table, found.schema, histories, {h: (model, p["lookback"]) for (h, p, _), (model, _) in zip(tasks, fitted, strict=True)}

    return _once(spark, d, "lstm", build)


def _lstm_test(spark: SparkSession, d: str, series: DataFrame) -> DataFrame:
    """The one pass over the test split by the winners."""
    out = None
    for h, winner in _lstm(spark, d, series)[3].items():
        part = recurrent.predict(_sequences(series, h).where(F.col("split") == "test").drop("scaled_target"), {"lstm": winner})
        out = part if out is None else out.unionByName(part)
    return out


@query()
def m7_lstm_test(spark: SparkSession, d: str) -> DataFrame:
    """The recurrent model: fit with early stopping, selection (m8), refit, one pass over test."""
    return _errors(_lstm_test(spark, d, materialize(series_of(spark, d))).withColumnRenamed("target", "y_true"), ["horizon"])


@query()
def m8_lstm_selection(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each horizon by error, f1 downward, units, lookback, dropout downward."""
    rows, schema, *_ = _lstm(spark, d, materialize(series_of(spark, d)))
    return round_doubles(spark.createDataFrame(rows, schema))


@query()
def e25_lstm_gap(spark: SparkSession, d: str) -> DataFrame:
    """The generalization gap of every training history of the recurrent model."""
    return metrics.generalization_gap(recurrent.history_table(_lstm(spark, d, materialize(series_of(spark, d)))[2], spark), ["horizon", "candidate"])


def four_models(spark: SparkSession, d: str) -> DataFrame:
    """Test predictions of both baselines, the trees and the recurrent model in one long table, over the windows that all four forecast."""
    series = materialize(series_of(spark, d))
    long = baselines.long(baselines.wide(series, KEY), KEY).where(F.col("split") == "test")
    thresholds = series.groupBy(F.col(KEY).alias("k")).agg(F.max("threshold").alias("threshold"))
    fitted = _gbt_test(spark, d, materialize(features.feature_matrix(series, KEY))).select(KEY, "target_time", "split", "horizon", "model", "target", "y_pred")
    fitted = fitted.unionByName(_lstm_test(spark, d, series).select(KEY, "target_time", "split", "horizon", "model", "target", "y_pred")).join(thresholds, F.col(KEY).eqNullSafe(F.col("k"))).drop("k")
    fitted = fitted.select(KEY, F.col("target_time").alias("timestamp"), "split", "horizon", "model", F.col("target").alias("y_true"), "y_pred", (F.col("target") >= F.col("threshold")).alias("actual_burst"), (F.col("y_pred") >= F.col("threshold")).alias("predicted_burst"), "threshold")
    every = materialize(long.unionByName(fitted))
    whole = every.groupBy(F.col(KEY).alias("k"), F.col("timestamp").alias("t"), F.col("horizon").alias("h")).agg(F.count_distinct("model").alias("m")).where(F.col("m") == 4)
    return every.join(whole, F.col(KEY).eqNullSafe(F.col("k")) & (F.col("timestamp") == F.col("t")) & (F.col("horizon") == F.col("h")), "left_semi")


@query()
def e7_four_models(spark: SparkSession, d: str) -> DataFrame:
    """All four models by horizon on the same test windows: errors, detection, average precision, improvement and intervals of the error."""
    pred, keys = materialize(four_models(spark, d)), ["model", "horizon"]
    ev = metrics.improvement(metrics.evaluate(pred, keys), ["horizon"])
    ap = metrics.average_precision(pred, keys).drop("defined")
    low = bootstrap.block_bootstrap(pred, keys, _REPLICATES, 42).where(F.col("metric") == "mae").select(*keys, F.col("low").alias("mae_low"), F.col("high").alias("mae_high"))
    return round_doubles(ev.join(ap, keys).join(low, keys).select(*keys, "n", "mae", "mae_low", "mae_high", "rmse", "smape_percent", "bias", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "average_precision", "improvement_percent"), 4)


@query()
def e8_four_models(spark: SparkSession, d: str) -> DataFrame:
    """The coverage gates over all four models."""
    return metrics.coverage_gates(four_models(spark, d), KEY, [*baselines.MODELS, "gbt", "lstm"])


# -- windows in blocks, and the streaming extension


@query(_FEATURES + ' SELECT endpoint_id, "timestamp", lag_1, lag_288, round(rolling_std_12, 3) AS rolling_std_12 FROM feat')
def w1_halo_features(spark: SparkSession, d: str) -> DataFrame:
    """Features over halo blocks, for series too long for one task."""
    out = features.feature_matrix(series_of(spark, d), KEY, halo=True)
    return round_doubles(out.select(KEY, "timestamp", "lag_1", "lag_288", "rolling_std_12"), 3)


@query("WITH " + _grid_sql() + ' SELECT endpoint_id, to_timestamp(bin * 300) AS "timestamp", token_load, request_count FROM agg')
def x1_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The streaming aggregation, applied to the whole table."""
    return stream.stream_windows(table(spark, d, "requests"), KEY)


@query(_EVAL + f" SELECT {_EVAL_COLS} FROM ev")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Requests to grid, splits, thresholds, baselines and their evaluation, in one plan."""
    return round_doubles(evaluated(spark, d).drop("actual_bursts", "predicted_bursts", "actual_burst_rate", "predicted_burst_rate").select("split", "model", "horizon", "n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "smape_percent", "bias")], "tp", "fp", "fn", "tn", "precision", "recall", "f1"))
