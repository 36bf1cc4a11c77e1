"""Totals and averages over trailing periods, days without activity included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECONDS_A_DAY = 86_400


def day_number(ts: Column) -> Column:
    """Whole days since 1970-01-01 UTC."""
    return F.floor(F.unix_micros(ts) / F.lit(SECONDS_A_DAY * 1_000_000)).cast("bigint")


def daily_dense(df: DataFrame, entity: str, ts: str, measures: Sequence[str], active: str | None = None) -> DataFrame:
    """One row per entity and day from its first to its last day: (entity, day_no, measures...), days without a row as zero.

    Rows are summed by day first (partial sums before the shuffle), so a hot entity costs one row a day from then on.
    The calendar is each entity's own run of days, put in as zero rows before a second sum: no join, and a null entity
    is an entity like any other. `active`: the measure that must be above zero on the first and the last day (else any
    row counts). Null measures count as zero; rows with a null timestamp belong to no day and are left out.
    """
    daily = (
        df.where(F.col(ts).isNotNull())
        .groupBy(F.col(entity).alias("__entity"), day_number(F.col(ts)).alias("day_no"))
        .agg(
            *[F.sum(F.coalesce(F.col(m), F.lit(0))).alias(m) for m in measures],
            (F.max(F.coalesce(F.col(active) > 0, F.lit(False))) if active else F.lit(True)).alias("__active"),
        )
    )
    whole = Window.partitionBy("__entity")
    first = F.min(F.when(F.col("__active"), F.col("day_no"))).over(whole)
    last = F.max(F.when(F.col("__active"), F.col("day_no"))).over(whole)
    following = F.lead("day_no").over(whole.orderBy("day_no"))
    inside = daily.withColumns({"__first": first, "__last": last}).where(F.col("day_no").between(F.col("__first"), F.col("__last")))
    # Each day brings the empty days up to the next one; the calendar is never larger than its result.
    filled = inside.withColumn("__next", following).withColumn(
        "__day", F.explode(F.sequence(F.col("day_no"), F.coalesce(F.col("__next") - 1, F.col("day_no"))))
    )
    own = F.col("__day") == F.col("day_no")
    return filled.select(
        F.col("__entity").alias(entity),
        F.col("__day").alias("day_no"),
        *[F.when(own, F.col(m)).otherwise(F.lit(0)).alias(m) for m in measures],
    )


def trailing(dense: DataFrame, entity: str, measures: Sequence[str], periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Sums and averages over the last `periods` days, today included, on the rows of daily_dense.

    Days before the first count as zero, so an average always divides by the whole period. Adds <measure>_sum_<p>
    and <measure>_avg_<p>.
    """
    by = Window.partitionBy(entity).orderBy("day_no")
    out: dict[str, Column] = {}
    for p in periods:
        for m in measures:
            total = F.sum(m).over(by.rowsBetween(-(p - 1), 0))
            out[f"{m}_sum_{p}"] = total
            out[f"{m}_avg_{p}"] = total / F.lit(float(p))
    return dense.withColumns(out)


def silent_periods(dense: DataFrame, entity: str, measure: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Days whose trailing total of `measure` is zero: (entity, day_no, period_days)."""
    rolled = trailing(dense, entity, [measure], periods)
    pairs = F.array(*[F.struct(F.lit(p).cast("bigint").alias("p"), F.col(f"{measure}_sum_{p}").alias("s")) for p in periods])
    return (
        rolled.select(entity, "day_no", F.explode(pairs).alias("x"))
        .where(F.col("x.s") == 0)
        .select(entity, "day_no", F.col("x.p").alias("period_days"))
    )
