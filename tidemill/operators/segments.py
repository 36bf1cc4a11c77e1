"""Errors by segment: bursts, phase of the day and week, composition of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.metrics import confusion, detection, regression
from tidemill.operators.spikes import source_medians

DAY_PARTS = ["00–06h", "06–12h", "12–18h", "18–24h"]


def composition_medians(series: DataFrame) -> DataFrame:
    """(gpt4_median, api_median): exact medians of the shares over train windows with requests, one row; see source_medians."""
    n = F.nullif(F.col("request_count"), F.lit(0).cast("bigint"))
    used = series.where((F.col("split") == "train") & (F.col("request_count") > 0))
    shares = F.array(*[F.struct(F.lit(k).alias("share"), (F.col(f"{k}_request_count").cast("double") / n).alias("value")) for k in ("gpt4", "api")])
    medians = source_medians(used.select(F.explode(shares).alias("x")).select("x.*"), ["share"], "value", ["value"])
    return medians.agg(*[F.max(F.when(F.col("share") == k, F.col("median"))).alias(f"{k}_median") for k in ("gpt4", "api")])


def day_part(ts: Column) -> Column:
    """Quarter of the day, left-closed."""
    quarter = F.floor(F.pmod(F.unix_seconds(ts), F.lit(86_400)) / F.lit(21_600)).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in DAY_PARTS]), quarter + 1)


def week_phase(ts: Column) -> Column:
    """Relative phase 1..7: whole days since the start of the epoch's week."""
    day = (F.floor(F.pmod(F.unix_seconds(ts), F.lit(604_800)) / F.lit(86_400)) + 1).cast("string")
    return F.concat(F.lit("Relative phase "), day)


def share_level(part: Column, whole: Column, median: Column) -> Column:
    """High above the median, else Low; null without requests."""
    return F.when(whole > 0, F.when(part.cast("double") / F.nullif(whole, F.lit(0).cast("bigint")) > median, F.lit("High")).otherwise(F.lit("Low")))


def labelled(predictions: DataFrame, series: DataFrame, key: str) -> DataFrame:
    """Predictions with (dimension, segment), one row per dimension that applies to the target window."""
    counts = series.select(F.col(key).alias("__key"), F.col("timestamp").alias("__time"), "request_count", "gpt4_request_count", "api_request_count")
    joined = predictions.join(counts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("timestamp") == F.col("__time")), "left").drop("__key", "__time")
    # One row.
    joined = joined.join(F.broadcast(composition_medians(series)))
    dims = {
        "burst": F.when(F.col("actual_burst"), F.lit("burst")).otherwise(F.lit("non-burst")),
        "day_part": day_part(F.col("timestamp")),
        "week_phase": week_phase(F.col("timestamp")),
        "gpt4_share": share_level(F.col("gpt4_request_count"), F.col("request_count"), F.col("gpt4_median")),
        "api_share": share_level(F.col("api_request_count"), F.col("request_count"), F.col("api_median")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("segment")) for k, v in dims.items()]))
    return joined.withColumn("__x", rows).withColumns({"dimension": F.col("__x.dimension"), "segment": F.col("__x.segment")}).drop("__x").where(F.col("segment").isNotNull())


def segment_errors(predictions: DataFrame, series: DataFrame, key: str, by: Sequence[str] = ("horizon", "model")) -> DataFrame:
    """Errors, bias, mean loads and burst counts per dimension and segment; five dimensions in one pass."""
    rows = labelled(predictions, series, key)
    out = rows.groupBy(*by, "dimension", "segment").agg(
        F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in (regression() | confusion()).items()], F.avg("y_true").alias("mean_y_true"), F.avg("y_pred").alias("mean_y_pred")
    )
    return detection(out)
