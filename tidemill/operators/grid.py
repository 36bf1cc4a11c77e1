"""Requests on a complete left-closed grid of windows, splits by position, thresholds and bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.scalars import category_key

WINDOW_SECONDS = 300
SHARES = (0.70, 0.15)
QUANTILE = 0.95
COUNTS = ["gpt4_request_count", "chatgpt_request_count", "api_request_count", "conversation_request_count", "batch_1_request_count", "batch_2_request_count", "batch_3_request_count"]
SUMS = ["token_load", "request_count", "request_tokens_sum", "response_tokens_sum", *COUNTS]


def bin_of(ts: Column, seconds: int = WINDOW_SECONDS) -> Column:
    """Number of the left-closed window since the epoch."""
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def tumbling(requests: DataFrame, key: str, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """One row per key and window with requests: (key, bin, sums and counts by category). Rows without a time are left out."""
    model, log = category_key(F.col("model")), category_key(F.col("log_type"))
    return requests.where(F.col("timestamp").isNotNull()).groupBy(key, bin_of(F.col("timestamp"), seconds).alias("bin")).agg(
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("token_load"),
        F.count(F.lit(1)).alias("request_count"),
        F.coalesce(F.sum("request_tokens"), F.lit(0)).alias("request_tokens_sum"),
        F.coalesce(F.sum("response_tokens"), F.lit(0)).alias("response_tokens_sum"),
        F.count_if(model == "gpt4").alias("gpt4_request_count"),
        F.count_if(model == "chatgpt").alias("chatgpt_request_count"),
        F.count_if(log == "apilog").alias("api_request_count"),
        F.count_if(log == "conversationlog").alias("conversation_request_count"),
        *[F.count_if(F.col("source_batch") == str(b)).alias(f"batch_{b}_request_count") for b in (1, 2, 3)],
    )


def complete(windows: DataFrame, key: str, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Every window from a key's first to its last; empty ones have zero counts and null means.

    Each window brings the empty ones up to the next, so the grid needs no join. Adds bin_idx (position, from 0), n_bins,
    timestamp (left edge), means, source_batch and is_zero_window.
    """
    by = Window.partitionBy(key).orderBy("bin")
    whole = Window.partitionBy(key)
    spread = windows.withColumns({"__next": F.lead("bin").over(by), "__first": F.min("bin").over(whole), "__last": F.max("bin").over(whole)})
    spread = spread.withColumn("__bin", F.explode(F.sequence("bin", F.coalesce(F.col("__next") - 1, F.col("bin")))))
    own = F.col("__bin") == F.col("bin")
    filled = spread.select(key, F.col("__bin").alias("bin"), (F.col("__bin") - F.col("__first")).alias("bin_idx"), (F.col("__last") - F.col("__first") + 1).alias("n_bins"), *[F.when(own, F.col(c)).otherwise(F.lit(0).cast("bigint")).alias(c) for c in SUMS])
    one, two, three = (F.col(f"batch_{b}_request_count") > 0 for b in (1, 2, 3))
    label = F.concat_ws("|", F.when(one, F.lit("1")), F.when(two, F.lit("2")), F.when(three, F.lit("3")))
    return filled.withColumns(
        {
            "timestamp": F.timestamp_seconds(F.col("bin") * seconds),
            "mean_request_tokens": F.try_divide(F.col("request_tokens_sum").cast("double"), F.col("request_count")),
            "mean_response_tokens": F.try_divide(F.col("response_tokens_sum").cast("double"), F.col("request_count")),
            "source_batch": F.coalesce(F.nullif(label, F.lit("")), F.lit("none")),
            "is_zero_window": F.col("request_count") == 0,
        }
    )


def split_by_position(series: DataFrame, shares: tuple[float, float] = SHARES) -> DataFrame:
    """split: train, valid and test by position in the complete grid of a key, bounds rounded down."""
    train = F.floor(F.col("n_bins") * F.lit(shares[0]))
    valid = F.floor(F.col("n_bins") * F.lit(shares[0] + shares[1]))
    return series.withColumn("split", F.when(F.col("bin_idx") < train, F.lit("train")).when(F.col("bin_idx") < valid, F.lit("valid")).otherwise(F.lit("test")))


def thresholds(series: DataFrame, key: str, quantile: float = QUANTILE) -> DataFrame:
    """(key, threshold, train_rows): exact quantile with linear interpolation over the train windows alone."""
    return series.where(F.col("split") == "train").groupBy(key).agg(F.percentile(F.col("token_load").cast("double"), quantile).alias("threshold"), F.count(F.lit(1)).alias("train_rows"))


def with_bursts(series: DataFrame, key: str, quantile: float = QUANTILE) -> DataFrame:
    """Adds threshold (of the key's train windows, null without any) and actual_burst (load at or above it).

    The threshold comes from a window over the key, whose rows lie together already: no join, no second shuffle.
    """
    train = F.when(F.col("split") == "train", F.col("token_load").cast("double"))
    return series.withColumn("threshold", F.percentile(train, quantile).over(Window.partitionBy(key))).withColumn("actual_burst", F.col("token_load") >= F.col("threshold"))


def build_series(requests: DataFrame, key: str, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Requests to the complete series with splits, thresholds and bursts."""
    return with_bursts(split_by_position(complete(tumbling(requests, key, seconds), key, seconds)), key)


def frozen_series(requests: DataFrame, key: str, frozen: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """A series of another period under thresholds fitted before: (frozen: key, threshold); split is robustness_zero_shot."""
    series = complete(tumbling(requests, key, seconds), key, seconds).withColumn("split", F.lit("robustness_zero_shot"))
    held = frozen.select(F.col(key).alias("__key"), "threshold")
    return series.join(held, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key").withColumn("actual_burst", F.col("token_load") >= F.col("threshold"))


def split_summary(series: DataFrame, key: str) -> DataFrame:
    """Per key and split: rows, extent, load, bursts and zero windows."""
    return series.groupBy(key, "split").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.min("timestamp").alias("first_window"),
        F.max("timestamp").alias("last_window"),
        F.sum("request_count").alias("requests"),
        F.sum("token_load").alias("tokens"),
        F.max("token_load").alias("max_load"),
        F.count_if("is_zero_window").alias("zero_windows"),
        F.count_if("actual_burst").alias("burst_windows"),
        F.avg(F.col("actual_burst").cast("double")).alias("burst_rate"),
    )


def boundary_audit(series: DataFrame, key: str, first: str = "1", second: str = "2", seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Between the last window with requests of one batch and the first of the next: gap, windows and empty windows strictly between."""
    ends = series.groupBy(key).agg(
        F.max(F.when(F.col(f"batch_{first}_request_count") > 0, F.col("bin"))).alias("last_first"), F.min(F.when(F.col(f"batch_{second}_request_count") > 0, F.col("bin"))).alias("first_second")
    )
    ends = ends.where(F.col("last_first").isNotNull() & F.col("first_second").isNotNull()).withColumnRenamed(key, "__key")
    between = series.join(ends, F.col(key).eqNullSafe(F.col("__key")) & (F.col("bin") > F.col("last_first")) & (F.col("bin") < F.col("first_second")), "right")
    return between.groupBy(F.col("__key").alias(key), "last_first", "first_second").agg(F.count("bin").alias("windows_between"), F.count_if("is_zero_window").alias("zero_windows_between")).select(
        key, ((F.col("first_second") - F.col("last_first")) * seconds).alias("gap_seconds"), "windows_between", "zero_windows_between"
    )


def recomputed(requests: DataFrame, series: DataFrame, key: str, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Every window whose sums differ from those over the requests in [timestamp, timestamp + window): empty if all is well.

    Stronger than a check of some windows; requests meet their window by equality of its number, not by a range join.
    """
    raw = requests.where(F.col("timestamp").isNotNull()).select(F.col(key).alias("__key"), bin_of(F.col("timestamp"), seconds).alias("__bin"), "total_tokens").groupBy("__key", "__bin").agg(F.sum("total_tokens").alias("__load"), F.count(F.lit(1)).alias("__count"))
    both = series.join(raw, F.col(key).eqNullSafe(F.col("__key")) & (F.col("bin") == F.col("__bin")), "full")
    wrong = (F.coalesce("__load", F.lit(0)) != F.coalesce("token_load", F.lit(-1))) | (F.coalesce("__count", F.lit(0)) != F.coalesce("request_count", F.lit(-1)))
    return both.where(wrong).select(F.coalesce(key, "__key").alias(key), F.coalesce("bin", "__bin").alias("bin"))


def gates(series: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """(gate, violations): unique and contiguous windows, closed categories, reconciled sums; all zero if all is well."""
    by = Window.partitionBy(key).orderBy("bin")
    stepped = series.withColumn("__step", F.col("bin") - F.lag("bin").over(by))
    own = stepped.agg(
        F.count_if(F.col("__step") == 0).alias("unique"),
        F.count_if(F.col("__step") > 1).alias("contiguous"),
        F.count_if(F.col("gpt4_request_count") + F.col("chatgpt_request_count") != F.col("request_count")).alias("models_closed"),
        F.count_if(F.col("api_request_count") + F.col("conversation_request_count") != F.col("request_count")).alias("log_types_closed"),
        F.sum("request_count").alias("__n"),
        F.sum("token_load").alias("__t"),
    )
    raw = requests.where(F.col("timestamp").isNotNull()).agg(F.count(F.lit(1)).alias("__rn"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("__rt"))
    # One row on either side.
    both = own.join(F.broadcast(raw))
    checked = both.withColumns({"requests_reconcile": F.abs(F.coalesce("__n", F.lit(0)) - F.col("__rn")), "tokens_reconcile": F.abs(F.coalesce("__t", F.lit(0)) - F.col("__rt"))})
    return checked.unpivot([], ["unique", "contiguous", "models_closed", "log_types_closed", "requests_reconcile", "tokens_reconcile"], "gate", "violations")
