"""Forecasts without fitting: persistence and the same window of the day before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.features import HORIZONS, STEP_MINUTES, steps_of

SEASON = 288
MODELS = ["persistence", "seasonal_naive"]


def wide(series: DataFrame, key: str, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """One row per target window with, per horizon h, forecast_origin_h, last_available_window_h, pred_persistence_h and pred_seasonal_h.

    Persistence is the load of the window before the origin, h / 5 + 1 rows before the target; the season is 288 rows.
    The season must have ended when the forecast is made, which holds up to 1,435 minutes.
    """
    by = Window.partitionBy(key).orderBy("bin_idx")
    out = {}
    for h in horizons:
        if h + STEP_MINUTES > SEASON * STEP_MINUTES:
            raise ValueError(f"the season has not ended {h} minutes ahead")
        k = steps_of(h)
        out[f"forecast_origin_{h}"] = F.timestamp_seconds(F.unix_seconds("timestamp") - h * 60)
        out[f"last_available_window_{h}"] = F.timestamp_seconds(F.unix_seconds("timestamp") - (k + 1) * STEP_MINUTES * 60)
        out[f"pred_persistence_{h}"] = F.lag("actual_token_load", k + 1).over(by)
        out[f"pred_seasonal_{h}"] = F.lag("actual_token_load", SEASON).over(by)
    return series.select(key, "timestamp", "split", F.col("token_load").alias("actual_token_load"), "actual_burst", "threshold", "bin_idx").withColumns(out).drop("bin_idx")


def long(predictions: DataFrame, key: str, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Wide predictions as (key, timestamp, split, horizon, model, y_true, y_pred, actual_burst, predicted_burst, threshold); rows without a prediction or threshold are left out."""
    rows = [
        F.struct(F.lit(h).cast("bigint").alias("horizon"), F.lit(m).alias("model"), F.col(f"pred_{p}_{h}").cast("double").alias("y_pred"))
        for h in horizons
        for m, p in zip(MODELS, ("persistence", "seasonal"), strict=True)
    ]
    flat = predictions.select(key, "timestamp", "split", F.col("actual_token_load").cast("double").alias("y_true"), "actual_burst", "threshold", F.explode(F.array(*rows)).alias("x"))
    flat = flat.select(key, "timestamp", "split", "x.horizon", "x.model", "y_true", "x.y_pred", "actual_burst", (F.col("x.y_pred") >= F.col("threshold")).alias("predicted_burst"), "threshold")
    return flat.where(F.col("y_pred").isNotNull() & F.col("threshold").isNotNull())


def by_timestamp(series: DataFrame, key: str, horizon: int) -> DataFrame:
    """The same two baselines looked up at exact timestamps, as for a series of another period: (key, timestamp, persistence, seasonal_naive), fully matched rows only."""
    loads = series.select(F.col(key).alias("__key"), F.unix_seconds("timestamp").alias("__s"), "token_load")
    out = series.select(key, "timestamp", F.unix_seconds("timestamp").alias("s"))
    for name, back in (("persistence", (steps_of(horizon) + 1) * STEP_MINUTES * 60), ("seasonal_naive", SEASON * STEP_MINUTES * 60)):
        at = loads.withColumn("__s", F.col("__s") + back).withColumnRenamed("token_load", name)
        out = out.join(at, F.col(key).eqNullSafe(F.col("__key")) & (F.col("s") == F.col("__s"))).drop("__key", "__s")
    return out.drop("s")
