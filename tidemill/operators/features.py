"""Features that only know the past, targets, and sequences for recurrent models.

A timestamp is the left edge of its window. For the forecast origin t the newest usable window is the one before t, the
label is the load of the window at t + h, and a row belongs to the split of its target.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemill.functions.scalars import phase, ratio_or_zero
from tidemill.plans.windows import over_blocks, over_series

LAGS = (1, 2, 3, 6, 12, 24, 48, 288)
WINDOWS = (3, 6, 12)
HORIZONS = (5, 15, 60)
STEP_MINUTES = 5
DAY, WEEK = 86_400, 604_800
BACK, AHEAD = 288, 12
#: Words that no feature name may hold, as they would tell the target or the calendar.
FORBIDDEN = ("target", "split", "burst", "weekday", "holiday")


@dataclass(frozen=True)
class FeatureDef:
    name: str
    category: str
    newest_row: str
    source: str


def registry() -> list[FeatureDef]:
    """All 36 features in their order, each with its category, newest row used and source columns."""
    out = [FeatureDef(f"lag_{k}", "lag", f"t-{k}", "token_load") for k in LAGS]
    out += [FeatureDef(f"rolling_{f}_{w}", "rolling", "t-1", "token_load") for f in ("mean", "std", "max") for w in WINDOWS]
    for name, source in (
        ("request_count_rolling_mean", "request_count"),
        ("gpt4_share_history", "gpt4_request_count, request_count"),
        ("api_share_history", "api_request_count, request_count"),
        ("mean_request_tokens_history", "request_tokens_sum, request_count"),
        ("mean_response_tokens_history", "response_tokens_sum, request_count"),
    ):
        out += [FeatureDef(f"{name}_{w}", "composition", "t-1", source) for w in WINDOWS]
    out += [FeatureDef(f"relative_{p}_{f}", "phase", "t", "timestamp") for p in ("day", "week") for f in ("sin", "cos")]
    names = [d.name for d in out]
    bad = [n for n in names if any(w in n.split("_") for w in FORBIDDEN)]
    if bad or len(set(names)) != len(names):
        raise ValueError(f"forbidden or repeated feature names: {bad}")
    return out


FEATURES = [d.name for d in registry()]


def registry_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name, d.category, d.newest_row, d.source) for d in registry()], "feature string, category string, newest_row string, source string")


def feature_sets() -> dict[str, list[str]]:
    """Ablation sets by name: all 36, the 30 without shares of models and services, the 12 lags and phases."""
    shares = ("gpt4_share", "api_share")
    return {"full": FEATURES, "no_shares": [f for f in FEATURES if not f.startswith(shares)], "lags_and_phase": [f for f in FEATURES if f.startswith(("lag", "relative"))]}


def past_columns(by: WindowSpec) -> dict[str, Column]:
    """Every feature that looks back, over windows of rows before the origin; null until its window is full."""
    load = F.col("token_load").cast("double")
    out: dict[str, Column] = {f"lag_{k}": F.lag(load, k).over(by) for k in LAGS}
    frames = {w: by.rowsBetween(-w, -1) for w in WINDOWS}
    full = lambda c, w: F.when(F.count("token_load").over(frames[w]) == w, c)
    for w, frame in frames.items():
        out[f"rolling_mean_{w}"] = full(F.avg(load).over(frame), w)
        out[f"rolling_std_{w}"] = full(F.stddev_samp(load).over(frame), w)
        out[f"rolling_max_{w}"] = full(F.max(load).over(frame), w)
        out[f"request_count_rolling_mean_{w}"] = full(F.avg(F.col("request_count").cast("double")).over(frame), w)
        for name, top in (("gpt4_share", "gpt4_request_count"), ("api_share", "api_request_count"), ("mean_request_tokens", "request_tokens_sum"), ("mean_response_tokens", "response_tokens_sum")):
            # No requests in the window, or no full window yet: 0. Sums of whole numbers, so no order matters.
            out[f"{name}_history_{w}"] = F.when(F.count("token_load").over(frame) == w, ratio_or_zero(F.sum(top).over(frame).cast("double"), F.sum("request_count").over(frame))).otherwise(F.lit(0.0))
    return out


def phase_columns(ts: str = "timestamp") -> dict[str, Column]:
    seconds = F.unix_seconds(F.col(ts))
    return {f"relative_{n}_{f.__name__}": f(phase(seconds, p)) for n, p in (("day", DAY), ("week", WEEK)) for f in (F.sin, F.cos)}


def feature_matrix(series: DataFrame, key: str, halo: bool = False, block: int = 2016) -> DataFrame:
    """The series with all features; with halo, in blocks of rows (series must be dense in bin_idx)."""
    looked = over_blocks(series, key, "bin_idx", past_columns, BACK, 0, block) if halo else over_series(series, key, "bin_idx", past_columns)
    return looked.withColumns(phase_columns())


def steps_of(horizon: int) -> int:
    """Rows ahead of a horizon in minutes, a positive multiple of the step."""
    if horizon <= 0 or horizon % STEP_MINUTES:
        raise ValueError(f"horizon must be a positive multiple of {STEP_MINUTES} minutes, not {horizon}")
    return horizon // STEP_MINUTES


def targets(df: DataFrame, key: str, horizon: int) -> DataFrame:
    """Adds target_time, target, target_split and target_burst of the row `horizon` minutes ahead; null past the end."""
    by = Window.partitionBy(key).orderBy("bin_idx")
    k = steps_of(horizon)
    return df.withColumns({"target_time": F.lead("timestamp", k).over(by), "target": F.lead("token_load", k).over(by), "target_split": F.lead("split", k).over(by), "target_burst": F.lead("actual_burst", k).over(by)})


def horizon_dataset(matrix: DataFrame, key: str, horizon: int, features: Sequence[str] = tuple(FEATURES), need_split: bool = True) -> DataFrame:
    """Origins with all features and a target: warm-up rows and rows without target are dropped."""
    needed = [*features, "target", "target_burst", *(["target_split"] if need_split else [])]
    ahead = targets(matrix, key, horizon).withColumn("horizon", F.lit(horizon).cast("bigint")).dropna(subset=needed)
    return ahead.select(key, F.col("timestamp").alias("feature_time"), "target_time", "horizon", F.col("target_split").alias("split"), F.col("target_burst").alias("actual_burst"), F.col("target").cast("double").alias("target"), *features)


def alignment(dataset: DataFrame, series: DataFrame, key: str, horizon: int) -> DataFrame:
    """(gate, violations): target minus origin is the horizon, targets are the series' loads, splits follow in time."""
    loads = series.select(F.col(key).alias("__key"), F.col("timestamp").alias("__time"), F.col("token_load").alias("__load"))
    joined = dataset.join(loads, F.col(key).eqNullSafe(F.col("__key")) & (F.col("target_time") == F.col("__time")), "left")
    direct = joined.agg(
        F.count_if(F.unix_seconds("target_time") - F.unix_seconds("feature_time") != horizon * 60).alias("horizon"),
        F.count_if(~F.coalesce(F.col("__load").cast("double") == F.col("target"), F.lit(False))).alias("values"),
    ).unpivot([], ["horizon", "values"], "gate", "violations")
    ends = dataset.groupBy(key).agg(*[f(F.when(F.col("split") == s, F.col("target_time"))).alias(f"{s}_{f.__name__}") for s in ("train", "valid", "test") for f in (F.min, F.max)])
    order = ends.agg(F.count_if((F.col("train_max") >= F.col("valid_min")) | (F.col("valid_max") >= F.col("test_min"))).alias("violations")).select(F.lit("order").alias("gate"), "violations")
    return direct.unionByName(order)


def dataset_summary(datasets: DataFrame) -> DataFrame:
    """(horizon, split, n_rows, bursts, first and last target) of horizon datasets."""
    return datasets.groupBy("horizon", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("actual_burst").alias("bursts"), F.min("target_time").alias("first_target"), F.max("target_time").alias("last_target"))


SEQUENCE_INPUTS = ["token_load", "request_count", "gpt4_share", "api_share", "mean_request_tokens", "mean_response_tokens", "relative_day_sin", "relative_day_cos", "relative_week_sin", "relative_week_cos"]


def sequence_inputs(series: DataFrame) -> DataFrame:
    """The ten inputs of a window itself; shares and means of empty windows are 0."""
    n = F.col("request_count")
    own = {
        "gpt4_share": ratio_or_zero(F.col("gpt4_request_count").cast("double"), n),
        "api_share": ratio_or_zero(F.col("api_request_count").cast("double"), n),
        "mean_request_tokens": F.coalesce("mean_request_tokens", F.lit(0.0)),
        "mean_response_tokens": F.coalesce("mean_response_tokens", F.lit(0.0)),
    }
    return series.withColumns(own | phase_columns())


def sequences(series: DataFrame, key: str, inputs: Sequence[str], lookback: int, horizon: int) -> DataFrame:
    """Per origin the `lookback` rows before it as arrays, with target and its split; only whole sequences with a target.

    (key, input_start, input_end, origin, target_time, split, target, sequence: array of arrays of FLOAT, oldest first).
    """
    by = Window.partitionBy(key).orderBy("bin_idx")
    frame = by.rowsBetween(-lookback, -1)
    row = F.array(*[F.col(c).cast("float") for c in inputs])
    looked = targets(series, key, horizon).withColumns({"sequence": F.collect_list(row).over(frame), "input_start": F.min("timestamp").over(frame), "input_end": F.max("timestamp").over(frame)})
    return looked.where((F.size("sequence") == lookback) & F.col("target").isNotNull()).select(key, "input_start", "input_end", F.col("timestamp").alias("origin"), "target_time", F.col("target_split").alias("split"), F.col("target").cast("double").alias("target"), "sequence")


def scaler(series: DataFrame, key: str, columns: Sequence[str], lookback: int, horizon: int) -> DataFrame:
    """(key, column, mean, scale) over the distinct rows that train sequences see; population deviation, 0 becomes 1.

    The rows are those from the first train sequence's first input to the row before its last origin: for each key the
    rows whose position is below that of the last train origin. Keys without a train sequence have no rows.
    """
    ahead = targets(series, key, horizon)
    last = F.max(F.when((F.col("target_split") == "train") & (F.col("bin_idx") >= lookback), F.col("bin_idx"))).over(Window.partitionBy(key))
    seen = ahead.withColumn("__last", last).where(F.col("bin_idx") < F.col("__last"))
    stats = seen.groupBy(key).agg(*[f(F.col(c).cast("double")).alias(f"{f.__name__}|{c}") for c in columns for f in (F.avg, F.stddev_pop)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`avg|{c}`").alias("mean"), F.coalesce(F.nullif(F.col(f"`stddev_pop|{c}`"), F.lit(0.0)), F.lit(1.0)).alias("scale")) for c in columns]))
    return stats.select(key, rows.alias("x")).select(key, "x.*")


def scaled(value: Column, mean: Column, scale: Column) -> Column:
    return (value - mean) / scale


def unscaled(value: Column, mean: Column, scale: Column) -> Column:
    """Back to tokens, never below 0."""
    return F.greatest(value * scale + mean, F.lit(0.0))


def contemporaneous_features(series: DataFrame, key: str) -> DataFrame:
    """The preliminary variant, which knows the window of the origin: means and deviations over 3, 6, 12 and 24 rows up to it, first difference, counts."""
    by = Window.partitionBy(key).orderBy("bin_idx")
    load = F.col("token_load").cast("double")
    out: dict[str, Column] = {"diff_1": load - F.lag(load, 1).over(by), "lag_1": F.lag(load, 1).over(by)}
    for w in (3, 6, 12, 24):
        frame = by.rowsBetween(-(w - 1), 0)
        full = F.count("token_load").over(frame) == w
        out[f"roll_mean_{w}"] = F.when(full, F.avg(load).over(frame))
        out[f"roll_std_{w}"] = F.when(full, F.stddev_samp(load).over(frame))
    return series.withColumns(out)
