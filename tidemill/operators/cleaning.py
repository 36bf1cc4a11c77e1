"""Cleaning of raw request traces with a reconciled ledger of deletions, and audits of what was read."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import coerce_numeric, epoch_to_timestamp, is_missing, label_or_missing
from tidemill.plans.windows import with_previous

RAW = ["timestamp", "model", "request_tokens", "response_tokens", "total_tokens", "log_type"]
OPTIONAL = ["session_id", "elapsed_time"]
#: Shapes in which a line is no row, before all rules.
SHAPES = ["quoting", "column_count"]
#: The rules in the order in which they delete; a row counts for the first it fails.
REASONS = ["unparseable_timestamp", "non_numeric_tokens", "negative_tokens", "critical_missing", "duplicate"]


def normalize_name(name: str) -> str:
    """A heading in lower snake case."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(c) for c in df.columns])


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    """df itself; raises with the names of all columns it lacks."""
    lacking = sorted(set(needed) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def numbers() -> dict[str, Column]:
    return {c: coerce_numeric(F.col(c)) for c in ("timestamp", "request_tokens", "response_tokens", "total_tokens")}


def failing_rule() -> Column:
    """The first rule a raw row fails, duplicates aside; null for a sound row."""
    n = numbers()
    negative = F.lit(False)
    for c in ("request_tokens", "response_tokens", "total_tokens"):
        negative = negative | F.coalesce(n[c] < 0, F.lit(False))
    return (
        F.when(epoch_to_timestamp(n["timestamp"]).isNull(), F.lit(REASONS[0]))
        .when(n["request_tokens"].isNull() | n["response_tokens"].isNull(), F.lit(REASONS[1]))
        .when(negative, F.lit(REASONS[2]))
        .when(is_missing(F.col("model")) | is_missing(F.col("log_type")), F.lit(REASONS[3]))
    )


def distinct_rows(raw: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Rows that differ in any of `columns` (null equals null), with copies (how often) and first (least of `order`).

    Whole values are compared, no hashes; copies are counted before the shuffle, so a row that makes up a third of the
    table is one row a task.
    """
    return raw.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first"))


def ledger(raw: DataFrame, columns: Sequence[str], order: str, shape: str | None = None) -> DataFrame:
    """(reason, n) for every rule, rules that delete nothing included, and reason 'kept'.

    Equal rows fail alike, so of n equal sound rows one is kept and n - 1 are duplicates. shape: a column that holds one of
    SHAPES for lines that are no rows, and null for the others; each such line counts for its shape.
    """
    first = [shape] if shape else []
    rule = F.coalesce(F.col(shape), failing_rule()) if shape else failing_rule()
    judged = distinct_rows(raw, [*columns, *first], order).withColumn("reason", rule)
    reasons = [*(SHAPES if shape else []), *REASONS[:-1]]
    sums = judged.agg(
        *[F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("copies"))), F.lit(0)).alias(r) for r in reasons],
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("copies") - 1)), F.lit(0)).alias(REASONS[-1]),
        F.count_if(F.col("reason").isNull()).alias("kept"),
    )
    return sums.unpivot([], [*reasons, REASONS[-1], "kept"], "reason", "n")


def clean(raw: DataFrame, columns: Sequence[str], order: str, batch: Column) -> DataFrame:
    """Sound rows, once each, with their types: total_tokens is recomputed, the delivered one kept beside it."""
    n = numbers()
    tokens = {c: n[c].try_cast("bigint") for c in ("request_tokens", "response_tokens")}
    kept = distinct_rows(raw, columns, order).where(failing_rule().isNull())
    optional = {
        "session_id": F.trim("session_id") if "session_id" in columns else F.lit(None).cast("string"),
        "elapsed_time": coerce_numeric(F.col("elapsed_time")) if "elapsed_time" in columns else F.lit(None).cast("double"),
    }
    return kept.select(
        epoch_to_timestamp(n["timestamp"]).alias("timestamp"),
        n["timestamp"].alias("timestamp_relative_seconds"),
        F.trim("model").alias("model"),
        F.trim("log_type").alias("log_type"),
        batch.alias("source_batch"),
        tokens["request_tokens"].alias("request_tokens"),
        tokens["response_tokens"].alias("response_tokens"),
        (tokens["request_tokens"] + tokens["response_tokens"]).alias("total_tokens"),
        n["total_tokens"].try_cast("bigint").alias("reported_total_tokens"),
        *[v.alias(k) for k, v in optional.items()],
    )


def total_mismatches(cleaned: DataFrame) -> DataFrame:
    """(mismatches, reported): sound rows whose delivered total, where there is one, is not the sum."""
    return cleaned.agg(F.count_if(F.col("reported_total_tokens") != F.col("total_tokens")).alias("mismatches"), F.count("reported_total_tokens").alias("reported"))


def missing_profile(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing, rate) over all raw rows; rate is null for an empty table."""
    rows = raw.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(is_missing(F.col(c))).alias(c) for c in columns])
    return rows.unpivot(["__rows"], list(columns), "column", "missing").select("column", "missing", F.try_divide(F.col("missing").cast("double"), F.col("__rows")).alias("rate"))


def category_frequencies(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, label, n): trimmed values, null and blank as <MISSING>."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), label_or_missing(F.col(c)).alias("label")) for c in columns]))
    return raw.select(pairs.alias("x")).groupBy("x.column", "x.label").agg(F.count(F.lit(1)).alias("n"))


def counter_json(frequencies: DataFrame, key: str, label: str, n: str) -> DataFrame:
    """(key, counts): one JSON object of label: n per key, labels in order. Labels are categories, a few per key."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(label), F.col(n))))
    return frequencies.groupBy(key).agg(F.to_json(F.map_from_entries(entries)).alias("counts"))


def zero_output(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., zero_rows, numeric_rows, zero_ratio): rows without output among those with a number."""
    n = coerce_numeric(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column)
    return df.groupBy(*keys).agg(F.count_if(n == 0).alias("zero_rows"), F.count(n).alias("numeric_rows")).withColumn("zero_ratio", F.try_divide(F.col("zero_rows").cast("double"), F.col("numeric_rows")))


def order_gaps(df: DataFrame, file: str, order: str, seconds: Column, threshold: float = 3600.0, block_rows: int = 500_000) -> DataFrame:
    """(file, max_gap, gaps_over, negative_steps) between successive rows of a file, in the order of the number `order`.

    Rows without a time are left out before steps are taken; max_gap is at least 0. Files are cut into blocks of
    `block_rows` numbers, so that one large file is many tasks.
    """
    timed = df.select(F.col(file).alias("file"), F.col(order).alias("o"), seconds.alias("s")).where(F.col("s").isNotNull()).withColumn("block", F.floor(F.col("o") / F.lit(block_rows)))
    step = F.col("s") - F.col("before")
    out = with_previous(timed, ["file"], "block", ["o"], "s", "before").groupBy("file").agg(
        F.greatest(F.coalesce(F.max(step), F.lit(0.0)), F.lit(0.0)).alias("max_gap"), F.count_if(step > threshold).alias("gaps_over"), F.count_if(step < 0).alias("negative_steps")
    )
    return out.withColumnRenamed("file", file)


def extent(cleaned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Extent of time and tokens per key: rows, min_seconds, max_seconds, duration_days, requests_per_hour, max_tokens, sum_tokens."""
    seconds = F.col("timestamp_relative_seconds")
    out = cleaned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(seconds).alias("min_seconds"), F.max(seconds).alias("max_seconds"), F.max("total_tokens").alias("max_tokens"), F.sum("total_tokens").alias("sum_tokens")
    )
    span = F.col("max_seconds") - F.col("min_seconds")
    return out.withColumns({"duration_days": span / 86400.0, "requests_per_hour": F.try_divide(F.col("n_rows").cast("double"), span / 3600.0)})


def union_audits(records: Sequence[DataFrame]) -> DataFrame:
    """Audit records of differing columns as one table; what a record lacks is null."""
    out = records[0]
    for r in records[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def strictly_valid(raw: DataFrame) -> DataFrame:
    """Raw rows whose numbers all read, none negative, and whose total is the sum; duplicates stay."""
    n = numbers()
    fine = n["timestamp"].isNotNull()
    for c in ("request_tokens", "response_tokens", "total_tokens"):
        fine = fine & (n[c] >= 0)
    return raw.where(F.coalesce(fine & (n["request_tokens"] + n["response_tokens"] == n["total_tokens"]), F.lit(False)))
