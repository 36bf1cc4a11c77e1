"""Exploratory statistics of complete series (key, bin_idx, timestamp, token_load, ...)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.scalars import clamped_bucket

DAY, WEEK = 86_400, 604_800
DAY_ROWS, WEEK_ROWS = 288, 2016


def day_of(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(DAY)).cast("bigint")


def describe_load(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: windows, mean, median, P95, P99, greatest, coefficient of variation (sample deviation), share of zero windows."""
    x = F.col("token_load").cast("double")
    q = F.percentile(x, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"), F.avg(x).alias("mean_load"), q.alias("__q"), F.max("token_load").alias("max_load"), F.try_divide(F.stddev_samp(x), F.avg(x)).alias("cv"), F.avg((F.col("token_load") == 0).cast("double")).alias("zero_share"))
    return out.withColumns({"median_load": F.col("__q")[0], "p95_load": F.col("__q")[1], "p99_load": F.col("__q")[2]}).drop("__q")


def daily_totals(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return series.groupBy(*keys, day_of(F.col("timestamp")).alias("day_no")).agg(F.sum("token_load").alias("tokens"), F.count(F.lit(1)).alias("n_windows"))


def daily_extremes(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., max_day, median_day) of the daily totals."""
    return daily_totals(series, keys).groupBy(*keys).agg(F.max("tokens").alias("max_day"), F.median("tokens").alias("median_day"))


def hourly_profile(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., hour, mean_load) by hour of the relative day."""
    hour = F.floor(F.pmod(F.unix_seconds("timestamp"), F.lit(DAY)) / F.lit(3600)).cast("bigint")
    return series.groupBy(*keys, hour.alias("hour")).agg(F.avg(F.col("token_load").cast("double")).alias("mean_load"))


def hourly_extremes(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., peak_hour, trough_hour, peak_to_trough); of equal hours the first, ratio null for a trough of 0."""
    p = hourly_profile(series, keys)
    out = p.groupBy(*keys).agg(F.max_by("hour", F.struct("mean_load", -F.col("hour"))).alias("peak_hour"), F.min_by("hour", F.struct("mean_load", "hour")).alias("trough_hour"), F.max("mean_load").alias("__a"), F.min("mean_load").alias("__b"))
    return out.withColumn("peak_to_trough", F.try_divide("__a", "__b")).drop("__a", "__b")


def trailing_mean(series: DataFrame, key: str, rows: int = DAY_ROWS) -> DataFrame:
    """Adds trailing_mean over the last `rows` windows, the own included; fewer at the start."""
    by = Window.partitionBy(key).orderBy("bin_idx").rowsBetween(-(rows - 1), 0)
    return series.withColumn("trailing_mean", F.avg(F.col("token_load").cast("double")).over(by))


def half_ratio(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., first_median, second_median, ratio) of the two halves of a series; the first is the shorter."""
    early = F.col("bin_idx") < F.floor(F.col("n_bins") / 2)
    x = F.col("token_load").cast("double")
    out = series.groupBy(*keys).agg(F.median(F.when(early, x)).alias("first_median"), F.median(F.when(~early, x)).alias("second_median"))
    return out.withColumn("ratio", F.try_divide("second_median", "first_median"))


def nearest_to_median(totals: DataFrame, keys: Sequence[str], unit: str, value: str) -> DataFrame:
    """The unit of each key whose value is nearest the median of all its units, the first of equally near ones."""
    middle = F.median(value).over(Window.partitionBy(*keys))
    return totals.withColumn("__d", F.abs(F.col(value) - middle)).groupBy(*keys).agg(F.min_by(F.struct(unit, value), F.struct("__d", unit)).alias("x")).select(*keys, f"x.{unit}", f"x.{value}")


def representative_relative_week(series: DataFrame, key: str) -> DataFrame:
    """The complete week, counted from the series' start, with the total nearest the median."""
    weeks = series.groupBy(key, F.floor(F.col("bin_idx") / WEEK_ROWS).alias("week_no")).agg(F.count(F.lit(1)).alias("n"), F.sum("token_load").alias("tokens"))
    return nearest_to_median(weeks.where(F.col("n") == WEEK_ROWS), [key], "week_no", "tokens")


def representative_daily_stride_week(series: DataFrame, key: str, rows: int = WEEK_ROWS) -> DataFrame:
    """Of all spans of seven days that begin at midnight and are complete, the one with the total nearest the median.

    Totals of days are added over seven days: no row meets more than its own day.
    """
    days = daily_totals(series, [key]).withColumnRenamed("n_windows", "n")
    by = Window.partitionBy(key).orderBy("day_no").rangeBetween(0, 6)
    spans = days.withColumns({"rows": F.sum("n").over(by), "week_tokens": F.sum("tokens").over(by)})
    return nearest_to_median(spans.where(F.col("rows") == rows).select(key, F.col("day_no").alias("start_day"), F.col("week_tokens").alias("tokens")), [key], "start_day", "tokens")


def representative_epoch_week(series: DataFrame, key: str, rows: int = WEEK_ROWS) -> DataFrame:
    """Of the weeks fixed by the epoch with all rows, the one nearest the median; without any, the seven days from the first row: (key, start_seconds)."""
    week = F.floor(F.unix_seconds("timestamp") / F.lit(WEEK)).cast("bigint")
    weeks = series.groupBy(key, week.alias("week_no")).agg(F.count(F.lit(1)).alias("n"), F.sum("token_load").alias("tokens"))
    best = nearest_to_median(weeks.where(F.col("n") >= rows), [key], "week_no", "tokens").withColumnRenamed(key, "__key")
    first = series.groupBy(key).agg(F.min(F.unix_seconds("timestamp")).alias("first"))
    return first.join(best, F.col(key).eqNullSafe(F.col("__key")), "left").select(key, F.coalesce(F.col("week_no") * WEEK, F.col("first")).alias("start_seconds"))


def representative_day(series: DataFrame, key: str, rows: int = DAY_ROWS) -> DataFrame:
    """The complete day with the total nearest the median, the earlier of equally near ones."""
    return nearest_to_median(daily_totals(series, [key]).where(F.col("n_windows") == rows).drop("n_windows"), [key], "day_no", "tokens")


def peak_zoom(series: DataFrame, key: str, hours: int) -> DataFrame:
    """Rows within `hours` of each key's highest load, the first of equal ones."""
    peak = F.max_by(F.unix_seconds("timestamp"), F.struct("token_load", -F.col("bin_idx"))).over(Window.partitionBy(key))
    return series.withColumn("__p", peak).where(F.abs(F.unix_seconds("timestamp") - F.col("__p")) <= hours * 3600).drop("__p")


def phase_heatmap(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., slot, phase_1 .. phase_7): mean load by window of the day and day of the relative week."""
    seconds = F.unix_seconds("timestamp")
    cells = series.select(*keys, F.floor(F.pmod(seconds, F.lit(DAY)) / F.lit(300)).cast("bigint").alias("slot"), (F.floor(F.pmod(seconds, F.lit(WEEK)) / F.lit(DAY)) + 1).alias("phase"), F.col("token_load").cast("double").alias("x"))
    return cells.groupBy(*keys, "slot").agg(*[F.avg(F.when(F.col("phase") == p, F.col("x"))).alias(f"phase_{p}") for p in range(1, 8)])


def log_histogram(df: DataFrame, value: str, buckets: int, top: float) -> DataFrame:
    """(bucket, n): log(1 + value) in equal buckets 1..buckets of [0, log(1 + top)], the last closed.

    Bucket 0 counts negative values, bucket buckets + 1 those above top; nulls are not counted.
    """
    v = F.col(value)
    inside = clamped_bucket(F.log1p(F.when(v >= 0, v).cast("double")), 0.0, math.log1p(top), buckets)
    bucket = F.when(v < 0, F.lit(0).cast("bigint")).when(v > top, F.lit(buckets + 1).cast("bigint")).otherwise(inside)
    return df.where(v.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """(keys..., spearman): correlation of ranks, equal values sharing the mean of their ranks."""
    def rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2.0

    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, rank(a).alias("__a"), rank(b).alias("__b"))
    return both.groupBy(*keys).agg(F.corr("__a", "__b").alias("spearman"))


def autocorrelation(series: DataFrame, key: str, lags: Sequence[int] = (1, 3, 12, 288)) -> DataFrame:
    """(key, lag_1, ...): Pearson correlation of a series with itself k rows earlier."""
    by = Window.partitionBy(key).orderBy("bin_idx")
    x = F.col("token_load").cast("double")
    return series.select(key, x.alias("x"), *[F.lag(x, k).over(by).alias(f"__{k}") for k in lags]).groupBy(key).agg(*[F.corr("x", f"__{k}").alias(f"lag_{k}") for k in lags])


def acf(series: DataFrame, key: str, lags: int = DAY_ROWS) -> DataFrame:
    """(key, lag, acf): biased autocorrelation for 0..lags: products of deviations over the whole sum of squares.

    Each row meets its `lags` followers by equality of their position.
    """
    centred = series.withColumn("d", F.col("token_load").cast("double") - F.avg(F.col("token_load").cast("double")).over(Window.partitionBy(key)))
    by = Window.partitionBy(key).orderBy("bin_idx")
    ahead = F.collect_list("d").over(by.rowsBetween(0, lags))
    pairs = centred.withColumn("ahead", ahead).select(key, "d", F.posexplode("ahead").alias("lag", "other"))
    sums = pairs.groupBy(key, F.col("lag").cast("bigint").alias("lag")).agg(F.sum(F.col("d") * F.col("other")).alias("s"))
    whole = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(Window.partitionBy(key))
    return sums.withColumn("acf", F.try_divide(F.col("s"), whole)).select(key, "lag", "acf")


def levinson_durbin(r: Sequence[float]) -> np.ndarray:
    """Partial autocorrelations from autocorrelations r[0] = 1, r[1], ... by the Yule-Walker recursion."""
    out, phi, v = np.ones(len(r)), np.zeros(0), 1.0
    for k in range(1, len(r)):
        a = (r[k] - float(np.dot(phi, np.asarray(r[1:k])[::-1]))) / v if v > 0 else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        v *= 1 - a * a
        out[k] = a
    return out


def pacf(series: DataFrame, key: str, lags: int = 48) -> DataFrame:
    """(key, lag, pacf) from acf(); the recursion runs on the lags + 1 numbers of each key."""
    kind = dict(series.dtypes)[key]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, i, v) for k, r in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True) for i, v in enumerate(levinson_durbin([x["acf"] for x in r]))]
            yield pd.DataFrame(rows, columns=[key, "lag", "pacf"])

    lists = acf(series, key, lags).where(F.col("acf").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("r"))
    return lists.mapInPandas(run, f"{key} {kind}, lag bigint, pacf double")


def daily_composition(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., day_no, requests, gpt4_share, api_share); shares of a day without requests are null."""
    out = series.groupBy(*keys, day_of(F.col("timestamp")).alias("day_no")).agg(F.sum("request_count").alias("requests"), F.sum("gpt4_request_count").alias("__g"), F.sum("api_request_count").alias("__a"))
    return out.select(*keys, "day_no", "requests", F.try_divide(F.col("__g").cast("double"), F.col("requests")).alias("gpt4_share"), F.try_divide(F.col("__a").cast("double"), F.col("requests")).alias("api_share"))


def seeded_sample(df: DataFrame, key: Sequence[str], rows: int, seed: int = 42) -> DataFrame:
    """`rows` rows, the same for a seed however the table is partitioned: those with the least hash of their key (a top-k, not a full sort)."""
    return df.orderBy(F.xxhash64(*[F.col(k) for k in key], F.lit(seed)), *key).limit(rows)


def composition(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys..., column, n, share): counts of each category and their share of the key's rows."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def rank_fusion(ranks: DataFrame, item: str, rank: str, top: int = 12) -> DataFrame:
    """(item, mean_rank): the `top` items by the mean of their ranks over all lists, ties by name."""
    return ranks.groupBy(item).agg(F.avg(F.col(rank).cast("double")).alias("mean_rank")).orderBy("mean_rank", item).limit(top)
