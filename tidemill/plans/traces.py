"""Queries over raw traces: reading, writing, cleaning and auditing, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import scalars
from tidemill.operators import badrows, cleaning, eda, metrics
from tidemill.operators import grid as g
from tidemill.plans.problems import _LINES
from tidemill.plans.registry import Registry, table
from tidemill.session import shared_dir
from tidemill.sources import traces

query = Registry()

COLUMNS = [*cleaning.RAW, *cleaning.OPTIONAL]
HEADINGS = {"timestamp_relative_seconds": "Timestamp", "model": "Model", "request_tokens": "Request tokens", "response_tokens": "Response tokens", "reported_total_tokens": "Total tokens", "log_type": "Log Type"}
CUTOFF = "1970-01-20 00:00:00"


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidemill-{uuid.uuid4().hex}"


def all_lines(spark: SparkSession, d: str) -> DataFrame:
    """All trace lines as columns of text: source_file, line_no, COLUMNS and shape, why a line is no row (its columns are null then)."""
    judged = badrows.judge(table(spark, d, "trace_lines"))
    shape = F.when(F.col("cells").isNull(), F.lit("quoting")).when(F.size("cells") != F.size("names"), F.lit("column_count"))
    return judged.withColumn("shape", shape).select("line_id", "source_file", "line_no", "shape", *[F.when(F.col("shape").isNull(), F.nullif(badrows.cell(c), F.lit(""))).alias(c) for c in COLUMNS])


def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    """Trace lines of the right shape; see all_lines."""
    return all_lines(spark, d).where(F.col("shape").isNull()).drop("shape")


_NUM = r"CASE WHEN regexp_full_match({0}, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') AND abs(try_cast({0} AS DOUBLE)) <= 1.7976931348623157e308 THEN try_cast({0} AS DOUBLE) END"
_RAW = (
    _LINES
    + ", raw AS (SELECT line_id, source_file, line_no, "
    + ", ".join(f"nullif(cells[list_position(names, '{c}')], '') AS \"{c}\"" for c in COLUMNS)
    + " FROM v WHERE quoted AND len(cells) = len(names)), num AS (SELECT *, "
    + ", ".join(f'{_NUM.format(chr(34) + c + chr(34))} AS n_{c}' for c in ("timestamp", "request_tokens", "response_tokens", "total_tokens", "elapsed_time"))
    + " FROM raw)"
)
_KEYS = ", ".join(f'"{c}"' for c in COLUMNS)
_JUDGED = (
    _RAW
    + r""", dist AS (SELECT """
    + _KEYS
    + r""", n_timestamp, n_request_tokens, n_response_tokens, n_total_tokens, n_elapsed_time, count(*) AS copies, min(line_id) AS first FROM num GROUP BY ALL),
judged AS (SELECT *, CASE WHEN n_timestamp IS NULL THEN 'unparseable_timestamp' WHEN n_request_tokens IS NULL OR n_response_tokens IS NULL THEN 'non_numeric_tokens'
  WHEN coalesce(n_request_tokens < 0, false) OR coalesce(n_response_tokens < 0, false) OR coalesce(n_total_tokens < 0, false) THEN 'negative_tokens'
  WHEN model IS NULL OR log_type IS NULL THEN 'critical_missing' END AS reason FROM dist),
cleaned AS (SELECT make_timestamp(round(n_timestamp * 1000000)::BIGINT) AS ts, n_timestamp AS timestamp_relative_seconds, model, log_type, trunc(n_request_tokens)::BIGINT AS request_tokens, trunc(n_response_tokens)::BIGINT AS response_tokens,
  trunc(n_request_tokens)::BIGINT + trunc(n_response_tokens)::BIGINT AS total_tokens, trunc(n_total_tokens)::BIGINT AS reported_total_tokens, session_id, n_elapsed_time AS elapsed_time FROM judged WHERE reason IS NULL)
"""
)


def cleaned_lines(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean(raw_lines(spark, d), COLUMNS, "line_id", F.lit("1"))


# -- sources and sinks


@query(r"""SELECT source_batch, count(*) AS n_rows, sum(request_tokens)::BIGINT AS request_tokens, sum(response_tokens)::BIGINT AS response_tokens, count(reported_total_tokens) AS with_total, round(max(timestamp_relative_seconds), 6) AS last_second FROM requests GROUP BY ALL""")
def s1_csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Requests written as headed CSV (s8), scanned back with snake-case headings (s2), gated (s3), everything as text and then coerced."""
    path = _folder(spark)
    traces.write_csv(table(spark, d, "requests").select("source_batch", *HEADINGS), path, HEADINGS)
    raw = traces.scan_csv(spark, path, cleaning.RAW)
    n = {c: scalars.coerce_numeric(F.col(c)) for c in ("request_tokens", "response_tokens", "total_tokens", "timestamp")}
    return raw.groupBy("source_batch").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(n["request_tokens"].cast("bigint")).alias("request_tokens"), F.sum(n["response_tokens"].cast("bigint")).alias("response_tokens"), F.count(n["total_tokens"]).alias("with_total"), F.round(F.max(n["timestamp"]), 6).alias("last_second"))


@query(r"""SELECT trim(regexp_replace(lower(trim(c)), '[^0-9a-z]+', '_', 'g'), '_') AS name, count(*) AS n_files FROM (SELECT UNNEST(string_split(line, ',')) AS c FROM trace_lines WHERE line_no = 1) GROUP BY ALL""")
def s2_normalize_columns(spark: SparkSession, d: str) -> DataFrame:
    heads = table(spark, d, "trace_lines").where(F.col("line_no") == 1).select(F.explode(badrows.cells_of(F.col("line"))).alias("c"))
    return heads.groupBy(badrows.column_name(F.col("c")).alias("name")).agg(F.count(F.lit(1)).alias("n_files"))


@query(r"""SELECT source_batch, log_type, count(*) AS n_rows, sum(total_tokens)::BIGINT AS tokens FROM requests GROUP BY ALL""")
def s4_parquet_sink(spark: SparkSession, d: str) -> DataFrame:
    """Written as zstd Parquet by batch and scanned back pruned (s5)."""
    path = _folder(spark)
    traces.write_parquet(table(spark, d, "requests"), path, ["source_batch"])
    back = traces.scan_parquet(spark, path, ["source_batch", "log_type", "total_tokens"])
    return back.groupBy(F.col("source_batch").cast("string").alias("source_batch"), "log_type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("total_tokens").alias("tokens"))


@query(r"""SELECT endpoint_id, sum(token_load)::BIGINT AS tokens FROM series_5min GROUP BY ALL""")
def s5_parquet_pruned(spark: SparkSession, d: str) -> DataFrame:
    return traces.scan_parquet(spark, f"{d}/series_5min.parquet", ["endpoint_id", "token_load"]).groupBy("endpoint_id").agg(F.sum("token_load").alias("tokens"))


@query(rf"""SELECT max("timestamp") AS newest, coalesce(max("timestamp") = TIMESTAMPTZ '{CUTOFF}+00', false) AS reached FROM series_5min WHERE "timestamp" <= TIMESTAMPTZ '{CUTOFF}+00'""")
def s6_parquet_filtered(spark: SparkSession, d: str) -> DataFrame:
    return traces.reaches(traces.scan_through(spark, f"{d}/series_5min.parquet", ["timestamp"], CUTOFF), CUTOFF)


@query(r"""SELECT floor(epoch_us("timestamp") / 86400000000)::BIGINT AS day_no, source_batch, count(*) AS n_rows, sum(total_tokens)::BIGINT AS tokens FROM requests GROUP BY ALL""")
def s7_partial_aggregates(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.unix_micros("timestamp") / F.lit(86_400_000_000)).cast("bigint")
    return table(spark, d, "requests").groupBy(day.alias("day_no"), "source_batch").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("total_tokens").alias("tokens"))


@query(r"""SELECT source_batch, '{' || string_agg('"' || model || '":' || n, ',' ORDER BY model) || '}' AS counts FROM (SELECT source_batch, trim(model) AS model, count(*) AS n FROM requests GROUP BY ALL) GROUP BY source_batch""")
def s9_json_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "requests").groupBy("source_batch", F.trim("model").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    return cleaning.counter_json(counts, "source_batch", "model", "n")


@query(r"""SELECT endpoint_id, CASE WHEN train_rows < 100 THEN 'few rows' ELSE definition END AS definition, train_rows FROM burst_thresholds""")
def s10_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "burst_thresholds").select("endpoint_id", "definition", "train_rows")
    return metrics.upsert(old, old.where(F.col("train_rows") < 100).withColumn("definition", F.lit("few rows")), ["endpoint_id"])


@query(r"""SELECT window_id, "timestamp" AS parsed FROM series_5min""")
def s11_parse_dates(spark: SparkSession, d: str) -> DataFrame:
    text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return table(spark, d, "series_5min").select("window_id", scalars.parse_date(text).alias("parsed"))


@query(r"""SELECT actual_burst AS strict, coalesce(actual_burst, false) AS lenient, count(*) AS n FROM series_5min GROUP BY ALL""")
def s12_parse_bool(spark: SparkSession, d: str) -> DataFrame:
    text = F.upper(F.col("actual_burst").cast("string"))
    return table(spark, d, "series_5min").groupBy(scalars.parse_bool_strict(text).alias("strict"), scalars.parse_bool_lenient(text).alias("lenient")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT line_id, lower(trim(cell)) IN ('true', '1', 'yes') AS flag FROM (SELECT line_id, split_part(line, ',', 4) AS cell FROM trace_lines WHERE line_no > 1)""")
def s13_parse_bool_lenient(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "trace_lines").where(F.col("line_no") > 1).select("line_id", scalars.parse_bool_lenient(F.split_part("line", F.lit(","), F.lit(4))).alias("flag"))


# -- cleaning and audit


@query(_RAW + " SELECT line_id, n_timestamp, n_request_tokens, n_response_tokens, n_total_tokens FROM num")
def c1_coerce_numeric(spark: SparkSession, d: str) -> DataFrame:
    return raw_lines(spark, d).select("line_id", *[v.alias(f"n_{c}") for c, v in cleaning.numbers().items()])


@query(_RAW + ' SELECT line_id, make_timestamp(round(n_timestamp * 1000000)::BIGINT) AT TIME ZONE \'UTC\' AS "timestamp" FROM num')
def c2_epoch_to_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return raw_lines(spark, d).select("line_id", scalars.epoch_to_timestamp(cleaning.numbers()["timestamp"]).alias("timestamp"))


@query(_RAW + " SELECT line_id, model IS NULL OR trim(model) = '' AS model_missing, log_type IS NULL OR trim(log_type) = '' AS log_type_missing FROM raw")
def c3_missing_mask(spark: SparkSession, d: str) -> DataFrame:
    return raw_lines(spark, d).select("line_id", *[scalars.is_missing(F.col(c)).alias(f"{c}_missing") for c in ("model", "log_type")])


_REQUEST_KEYS = ', '.join(f'"{c}"' for c in ("endpoint_id", "timestamp", "timestamp_relative_seconds", "model", "log_type", "source_batch", "request_tokens", "response_tokens", "total_tokens", "reported_total_tokens", "session_id", "elapsed_time", "received_at"))


@query(f"SELECT {_REQUEST_KEYS}, count(*) AS copies, min(request_id) AS first FROM requests GROUP BY {_REQUEST_KEYS}")
def c4_all_field_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Requests that differ in anything delivered; request_id, given on arrival, tells copies apart."""
    return cleaning.distinct_rows(table(spark, d, "requests"), [c.strip('"') for c in _REQUEST_KEYS.split(", ")], "request_id")


_LEDGER = _JUDGED + """, ledger AS (SELECT r AS reason, coalesce(sum(CASE WHEN r = 'kept' THEN (reason IS NULL)::INT WHEN r = 'duplicate' THEN CASE WHEN reason IS NULL THEN copies - 1 END WHEN reason = r THEN copies END), 0)::BIGINT AS n
  FROM (SELECT UNNEST(['unparseable_timestamp', 'non_numeric_tokens', 'negative_tokens', 'critical_missing', 'duplicate', 'kept']) AS r) LEFT JOIN judged ON true GROUP BY r
  UNION ALL SELECT 'quoting', count(*) FILTER (NOT quoted) FROM v UNION ALL SELECT 'column_count', count(*) FILTER (quoted AND len(cells) <> len(names)) FROM v)"""


def ledger_of(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.ledger(all_lines(spark, d), COLUMNS, "line_id", "shape")


@query(_LEDGER + " SELECT reason, n FROM ledger")
def c5_deletion_ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger_of(spark, d)


@query(_LEDGER + " SELECT (SELECT count(*) FROM trace_lines WHERE line_no > 1) AS raw_rows, sum(n)::BIGINT AS ledger_rows, sum(n) = (SELECT count(*) FROM trace_lines WHERE line_no > 1) AS reconciles FROM ledger")
def c6_ledger_reconciles(spark: SparkSession, d: str) -> DataFrame:
    """The ledger against all lines delivered but headers, those that are no rows included."""
    lines = table(spark, d, "trace_lines").where(F.coalesce(F.col("line_no") > 1, F.lit(True)))
    total = ledger_of(spark, d).agg(F.sum("n").alias("ledger_rows"))
    return lines.agg(F.count(F.lit(1)).alias("raw_rows")).join(F.broadcast(total)).withColumn("reconciles", F.col("raw_rows") == F.col("ledger_rows"))  # one row each


@query(_JUDGED + " SELECT count(*) FILTER (reported_total_tokens <> total_tokens) AS mismatches, count(reported_total_tokens) AS reported FROM cleaned")
def c7_total_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.total_mismatches(cleaned_lines(spark, d))


@query(_JUDGED + " SELECT ts AT TIME ZONE 'UTC' AS \"timestamp\", * EXCLUDE (ts), '1' AS source_batch FROM cleaned")
def c8_clean(spark: SparkSession, d: str) -> DataFrame:
    return cleaned_lines(spark, d)


@query(_RAW + " SELECT c AS \"column\", m AS missing, m / nullif(n, 0)::DOUBLE AS rate FROM (SELECT count(*) AS n, " + ", ".join(f'count(*) FILTER ("{c}" IS NULL) AS "{c}"' for c in COLUMNS) + " FROM raw) UNPIVOT (m FOR c IN (" + ", ".join(f'"{c}"' for c in COLUMNS) + "))")
def c9_missing_profile(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.missing_profile(raw_lines(spark, d), COLUMNS)


@query(_RAW + """ SELECT 'model' AS "column", coalesce(model, '<MISSING>') AS label, count(*) AS n FROM raw GROUP BY ALL UNION ALL SELECT 'log_type', coalesce(log_type, '<MISSING>'), count(*) FROM raw GROUP BY ALL""")
def c10_category_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.category_frequencies(raw_lines(spark, d), ["model", "log_type"])


@query(_RAW + " SELECT source_file, count(*) FILTER (n_response_tokens = 0) AS zero_rows, count(n_response_tokens) AS numeric_rows, count(*) FILTER (n_response_tokens = 0) / nullif(count(n_response_tokens), 0)::DOUBLE AS zero_ratio FROM num GROUP BY ALL")
def c11_zero_output(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.zero_output(raw_lines(spark, d), "response_tokens", ["source_file"])


@query(_RAW + """, steps AS (SELECT source_file, n_timestamp - lag(n_timestamp) OVER (PARTITION BY source_file ORDER BY line_no) AS s FROM num WHERE n_timestamp IS NOT NULL)
SELECT source_file, round(greatest(coalesce(max(s), 0.0), 0.0), 6) AS max_gap, count(*) FILTER (s > 3600) AS gaps_over, count(*) FILTER (s < 0) AS negative_steps FROM steps GROUP BY ALL""")
def c12_file_order_gaps(spark: SparkSession, d: str) -> DataFrame:
    gaps = cleaning.order_gaps(raw_lines(spark, d), "source_file", "line_no", cleaning.numbers()["timestamp"])
    return gaps.withColumn("max_gap", F.round("max_gap", 6))


@query(r"""SELECT source_batch, n_rows, min_seconds, max_seconds, max_tokens, sum_tokens, round((max_seconds - min_seconds) / 86400.0e0, 6) AS duration_days, round(n_rows / nullif((max_seconds - min_seconds) / 3600.0e0, 0), 6) AS requests_per_hour
FROM (SELECT source_batch, count(*) AS n_rows, min(timestamp_relative_seconds) AS min_seconds, max(timestamp_relative_seconds) AS max_seconds, max(total_tokens) AS max_tokens, sum(total_tokens)::BIGINT AS sum_tokens FROM requests GROUP BY ALL)""")
def c13_extent(spark: SparkSession, d: str) -> DataFrame:
    out = cleaning.extent(table(spark, d, "requests"), ["source_batch"])
    return out.withColumns({c: F.round(c, 6) for c in ("duration_days", "requests_per_hour")})


@query(r"""SELECT source_batch, count(*) FILTER (response_tokens = 0) AS zero_rows, count(response_tokens) AS numeric_rows, count(*) FILTER (response_tokens = 0) / nullif(count(response_tokens), 0)::DOUBLE AS zero_ratio FROM requests GROUP BY ALL""")
def c14_failure_audit(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.zero_output(table(spark, d, "requests"), "response_tokens", ["source_batch"])


@query(r"""SELECT source_batch, count(*) AS n_rows, CASE WHEN source_batch = '3' THEN count(session_id) END AS sessions FROM requests GROUP BY source_batch""")
def c15_audit_union(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "requests")
    plain = t.where(F.col("source_batch") != "3").groupBy("source_batch").agg(F.count(F.lit(1)).alias("n_rows"))
    third = t.where(F.col("source_batch") == "3").groupBy("source_batch").agg(F.count(F.lit(1)).alias("n_rows"), F.count("session_id").alias("sessions"))
    return cleaning.union_audits([plain, third])


@query(r"""WITH f AS (SELECT endpoint_id, min(floor(epoch_us("timestamp") / 300000000))::BIGINT AS a FROM requests GROUP BY ALL),
b AS (SELECT endpoint_id, a, UNNEST(range(a, a + 576)) AS bin FROM f),
r AS (SELECT endpoint_id, floor(epoch_us("timestamp") / 300000000)::BIGINT AS bin, count(*) AS n, sum(total_tokens) AS t FROM requests GROUP BY ALL)
SELECT b.endpoint_id, (b.bin * 300)::BIGINT AS bin_start, coalesce(n, 0)::BIGINT AS request_count, coalesce(t, 0)::BIGINT AS total_tokens FROM b LEFT JOIN r ON r.endpoint_id = b.endpoint_id AND r.bin = b.bin""")
def c16_smoke_two_days(spark: SparkSession, d: str) -> DataFrame:
    """The first two days of every endpoint: 576 bins each, empty ones zero."""
    bins = g.tumbling(table(spark, d, "requests"), "endpoint_id").select("endpoint_id", "bin", "request_count", F.col("token_load").alias("total_tokens"))
    first = bins.groupBy("endpoint_id").agg(F.min("bin").alias("first"))
    # The grid as zero rows of a second sum: no join.
    zero = first.select("endpoint_id", F.explode(F.sequence("first", F.col("first") + 575)).alias("bin"), F.lit(0).cast("bigint").alias("request_count"), F.lit(0).cast("bigint").alias("total_tokens"), F.lit(True).alias("grid"))
    both = bins.withColumn("grid", F.lit(False)).unionByName(zero).groupBy("endpoint_id", "bin").agg(F.sum("request_count").alias("request_count"), F.sum("total_tokens").alias("total_tokens"), F.max("grid").alias("grid"))
    return both.where("grid").select("endpoint_id", (F.col("bin") * 300).alias("bin_start"), "request_count", "total_tokens")


@query(_RAW + " SELECT line_id FROM num WHERE n_timestamp IS NOT NULL AND n_request_tokens >= 0 AND n_response_tokens >= 0 AND n_total_tokens >= 0 AND n_request_tokens + n_response_tokens = n_total_tokens")
def c17_strictly_valid(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.strictly_valid(raw_lines(spark, d)).select("line_id")


# -- what was read, by batch


@query(r"""SELECT source_batch, log_type, n, n / sum(n) OVER (PARTITION BY source_batch) AS share FROM (SELECT source_batch, log_type, count(*) AS n FROM requests GROUP BY ALL)""")
def d19_category_composition(spark: SparkSession, d: str) -> DataFrame:
    return eda.composition(table(spark, d, "requests"), ["source_batch"], "log_type")


@query(r"""SELECT source_batch, floor(epoch_us("timestamp") / 86400000000)::BIGINT AS day_no, count(*) AS requests FROM requests GROUP BY ALL""")
def d20_daily_requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "requests").groupBy("source_batch", eda.day_of(F.col("timestamp")).alias("day_no")).agg(F.count(F.lit(1)).alias("requests"))


@query(_LEDGER + """ SELECT (sum(n))::BIGINT AS raw_rows, (max(n) FILTER (reason = 'kept')) AS kept_rows, round(100.0e0 * (sum(n) - max(n) FILTER (reason = 'kept')) / nullif(sum(n), 0), 6) AS deleted_percent FROM ledger""")
def d22_retention(spark: SparkSession, d: str) -> DataFrame:
    out = ledger_of(spark, d).agg(F.sum("n").alias("raw_rows"), F.max(F.when(F.col("reason") == "kept", F.col("n"))).alias("kept_rows"))
    return out.withColumn("deleted_percent", F.round(F.lit(100.0) * F.try_divide((F.col("raw_rows") - F.col("kept_rows")).cast("double"), F.col("raw_rows")), 6))


@query(r"""SELECT source_batch, day_span, gap_hours FROM (SELECT source_batch, (max(s) - min(s)) / 86400.0e0 AS day_span, round((min(s) - lag(max(s)) OVER (ORDER BY source_batch)) / 3600.0e0, 6) AS gap_hours FROM (SELECT source_batch, timestamp_relative_seconds AS s FROM requests) GROUP BY source_batch)""".replace("SELECT source_batch, day_span,", "SELECT source_batch, round(day_span, 6) AS day_span,"))
def d22_batch_spans(spark: SparkSession, d: str) -> DataFrame:
    """Days each batch spans, and the hours from the end of the batch before it; negative where they overlap."""
    s = F.col("timestamp_relative_seconds")
    ends = table(spark, d, "requests").groupBy("source_batch").agg(F.min(s).alias("first"), F.max(s).alias("last"))
    by = Window.orderBy("source_batch")  # as many rows as batches
    gap = (F.col("first") - F.lag("last").over(by)) / 3600.0
    return ends.select("source_batch", F.round((F.col("last") - F.col("first")) / 86_400.0, 6).alias("day_span"), F.round(gap, 6).alias("gap_hours"))


@query(r"""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN total_tokens < 0 THEN 0 WHEN total_tokens > 100000 THEN 81 ELSE least(floor(ln(1 + total_tokens::DOUBLE) / (ln(100001.0e0) / 80))::BIGINT + 1, 80) END AS bucket FROM requests WHERE total_tokens IS NOT NULL) GROUP BY ALL""")
def d12_log_histogram(spark: SparkSession, d: str) -> DataFrame:
    return eda.log_histogram(table(spark, d, "requests"), "total_tokens", 80, 100_000)
