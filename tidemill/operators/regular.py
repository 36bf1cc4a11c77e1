"""Irregular readings onto a regular grid by validity intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_SECONDS = 300


def cells(df: DataFrame, source: str, ts: str, value: str, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """One row per source and grid cell that holds a reading.

    Every reading is valid from its own time to the next reading's: within a cell that is found by a window over
    (source, cell), so a hot source is split into its cells and no task sees more than one cell's readings at once.
    Columns: source, cell (number since the epoch, left-closed), n (readings), total (their sum), first_us, last_us,
    last_value (the value valid when the cell ends), inner_us (microseconds between readings of the cell under a value)
    and inner_weight (the same times the value; values are whole numbers, so sums are exact).
    Readings at the same microsecond: the largest value is valid, all are counted. A null value is a reading without
    value: it counts in n, adds nothing, and holds the value before it. Null timestamps are left out.
    """
    us = F.unix_micros(F.col(ts))
    width = cell_seconds * 1_000_000
    at = df.where(F.col(ts).isNotNull()).select(
        F.col(source).alias("source"), F.floor(us / F.lit(width)).cast("bigint").alias("cell"), us.alias("us"), F.col(value).alias("value")
    )
    moments = at.groupBy("source", "cell", "us").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("value"))
    by = Window.partitionBy("source", "cell").orderBy("us")
    held = F.last("value", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    valid = F.when(F.col("held").isNotNull(), F.lead("us").over(by) - F.col("us"))
    return (
        moments.withColumn("held", held)
        .withColumn("valid", valid)
        .withColumn("weight", F.col("held").cast("decimal(38,0)") * F.col("valid"))
        .groupBy("source", "cell")
        .agg(
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
            F.max_by("held", "us").alias("last_value"),
            F.coalesce(F.sum("valid"), F.lit(0)).alias("inner_us"),
            F.coalesce(F.sum("weight"), F.lit(0)).cast("decimal(38,0)").alias("inner_weight"),
        )
    )


def holds(cell_rows: DataFrame) -> DataFrame:
    """The validity intervals that leave their cell: each cell's last value is valid until the next cell's first reading.

    Adds next_cell and next_us (null for the last cell of a source). The window runs over cells, of which a source has
    at most one per grid step of its recorded time, however many its readings are.
    """
    by = Window.partitionBy("source").orderBy("cell")
    return cell_rows.withColumns({"next_cell": F.lead("cell").over(by), "next_us": F.lead("first_us").over(by)})


def cut(held: DataFrame, cell_seconds: int = CELL_SECONDS, hold_seconds: int = 3600) -> DataFrame:
    """The validity intervals cut by the grid: adds end_us and pieces, one per cell an interval touches, in order.

    A piece is (c, n_readings, covered): the cell, its own readings (1 for the head of the next cell that holds one, whose
    readings are counted there) and the microseconds of the cell under the interval. An interval touches its own cell, the
    empty cells after it and the head of the next cell with a reading; it ends `hold_seconds` after its reading at the latest.
    """
    width = cell_seconds * 1_000_000
    end_us = F.least(F.coalesce(F.col("next_us"), (F.col("cell") + 1) * width), F.col("last_us") + hold_seconds * 1_000_000)
    valued = F.col("last_value").isNotNull()

    def piece(c):
        covered = F.least(F.col("end_us"), (c + 1) * width) - F.greatest(F.col("last_us"), c * width)
        readings = F.when(c == F.col("cell"), F.col("n")).when(c == F.col("next_cell"), F.lit(1)).otherwise(F.lit(0))
        return F.struct(c.alias("c"), readings.cast("bigint").alias("n_readings"), F.when(valued & (covered > 0), covered).otherwise(F.lit(0)).alias("covered"))

    return held.withColumn("end_us", end_us).withColumn("pieces", F.transform(F.sequence("cell", F.coalesce("next_cell", "cell")), piece))


def gaps(pieces: DataFrame, least: int = 12, most: int = 2016, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Runs of `least` to `most` cells without a reading between two readings: (source, gap_start, n_windows, coverage).

    pieces: rows of cut(); the empty cells between two readings are pieces of one interval, so no run is put together
    over rows. coverage is the fraction of the run that is still under the interval.
    """
    empty = pieces.withColumn("empty", F.filter("pieces", lambda p: p["n_readings"] == 0)).where(F.size("empty").between(least, most))
    covered = F.aggregate("empty", F.lit(0).cast("bigint"), lambda total, p: total + p["covered"])
    n = F.size("empty").cast("bigint")
    return empty.select("source", (F.col("empty")[0]["c"] * cell_seconds).alias("gap_start"), n.alias("n_windows"), (covered / (n * F.lit(cell_seconds * 1e6))).alias("coverage"))


def regular_grid(df: DataFrame, source: str, ts: str, value: str, cell_seconds: int = CELL_SECONDS, hold_seconds: int = 3600) -> DataFrame:
    """The gap-free series of each source from its first to its last reading's cell.

    Columns: source, window_start (epoch seconds), n_readings, total (sum of values, 0 in empty cells), time_weighted
    (average of the step function over the covered part of the cell, null if nothing covers it), coverage (fraction of
    the cell under a validity interval; an interval ends `hold_seconds` after its reading at the latest, inside a cell it
    always reaches the next reading of that cell), status: observed, held (empty, covered at least in part) or missing.
    """
    width = cell_seconds * 1_000_000
    spans = cut(holds(cells(df, source, ts, value, cell_seconds)), cell_seconds, hold_seconds).withColumn("p", F.explode("pieces"))
    own = F.col("p.c") == F.col("cell")
    inner = F.when(own, F.col("inner_us")).otherwise(F.lit(0))
    pieces = spans.select(
        "source",
        F.col("p.c").alias("c"),
        F.when(own, F.col("n")).otherwise(F.lit(0)).alias("n"),
        F.when(own, F.coalesce(F.col("total"), F.lit(0))).otherwise(F.lit(0)).alias("total"),
        (F.col("p.covered") + inner).alias("covered"),
        (F.coalesce(F.col("last_value"), F.lit(0)).cast("decimal(38,0)") * F.col("p.covered") + F.when(own, F.col("inner_weight")).otherwise(F.lit(0))).cast("decimal(38,0)").alias("weight"),
    )
    whole = pieces.groupBy("source", "c").agg(
        F.sum("n").alias("n_readings"), F.sum("total").alias("total"), F.sum("covered").alias("covered"), F.sum("weight").cast("decimal(38,0)").alias("weight")
    )
    return whole.select(
        "source",
        (F.col("c") * cell_seconds).alias("window_start"),
        "n_readings",
        "total",
        F.when(F.col("covered") > 0, F.col("weight").cast("double") / F.col("covered").cast("double")).alias("time_weighted"),
        (F.col("covered") / F.lit(float(width))).alias("coverage"),
        F.when(F.col("n_readings") > 0, F.lit("observed")).when(F.col("covered") > 0, F.lit("held")).otherwise(F.lit("missing")).alias("status"),
    )
