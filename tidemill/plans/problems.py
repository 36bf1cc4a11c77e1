"""Queries of the general data problems over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import badrows, drift, regular, rolling, spikes
from tidemill.plans.physical import materialize, sized_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- 1: schemas that drift between files


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "feed_records"))


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unify(table(spark, d, "feed_records"))


def p1_correspondences(spark: SparkSession, d: str) -> DataFrame:
    return drift.successive(table(spark, d, "feed_records"))["correspondences"].withColumn("score", F.round("score", 4))


# -- 2: rolling totals


def _dense(spark: SparkSession, d: str, active: str | None) -> DataFrame:
    return rolling.daily_dense(table(spark, d, "series_5min"), "endpoint_id", "timestamp", ["token_load", "request_count"], active)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.silent_periods(_dense(spark, d, "request_count"), "endpoint_id", "request_count")


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    rolled = rolling.trailing(_dense(spark, d, None), "endpoint_id", ["token_load", "request_count"])
    return rolled.select(*[F.round(c, 4).alias(c) if "_avg_" in c else F.col(c) for c in rolled.columns])


# -- 3: regular grid


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    intervals = regular.holds(regular.cells(table(spark, d, "requests"), "endpoint_id", "timestamp", "total_tokens"))
    return regular.gaps(regular.cut(intervals)).select(F.col("source").alias("endpoint_id"), "gap_start", "n_windows")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = regular.regular_grid(table(spark, d, "requests"), "endpoint_id", "timestamp", "total_tokens")
    return grid.select(
        F.col("source").alias("endpoint_id"),
        "window_start",
        "n_readings",
        F.col("total").alias("token_load"),
        F.round("time_weighted", 3).alias("time_weighted"),
        F.round("coverage", 6).alias("coverage"),
        "status",
    )


# -- 4: implausible readings

TIMES_MEDIAN = 20


def _requests_readings(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "requests").select(F.col("request_id").alias("row_id"), "endpoint_id", "timestamp", "total_tokens", "response_tokens")
    bad = spikes.flag_impossible({"response_tokens": F.col("response_tokens") < 0, "total_tokens": (F.col("total_tokens") < 0) | (F.col("total_tokens") < F.col("response_tokens"))})
    return t.withColumns({"impossible": bad, "counts": F.lit(True)})


def _series_readings(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "series_5min").select(F.col("window_id").alias("row_id"), "endpoint_id", "timestamp", "token_load", "request_count")
    bad = spikes.flag_impossible({"token_load": (F.col("token_load") < 0) | ((F.col("token_load") > 0) & (F.col("request_count") == 0))})
    return t.withColumns({"impossible": bad, "counts": F.coalesce(F.col("request_count") > 0, F.lit(False))})


#: The fields that hold readings, by table.
READINGS = [("requests", "total_tokens"), ("requests", "response_tokens"), ("series_5min", "token_load")]


def _named(rows: DataFrame, kind: str) -> DataFrame:
    """(tbl, row_id, field, kind) of rows that bear the position of their field in READINGS."""
    tbl, field = [F.element_at(F.array(*[F.lit(x) for x in names]), F.col("reading") + 1) for names in zip(*READINGS)]
    return rows.select(tbl.alias("tbl"), "row_id", field.alias("field"), F.lit(kind).alias("kind"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    tables = {"requests": _requests_readings(spark, d), "series_5min": _series_readings(spark, d)}
    sound = impossible = None
    for k, (tbl, f) in enumerate(READINGS):
        bad = F.array_contains("impossible", f)
        of = lambda rows: rows.select(F.lit(k).alias("reading"), "row_id", "endpoint_id", "timestamp", F.col(f).cast("bigint").alias("value"))  # noqa: B023, E731
        good, no = of(tables[tbl].where(~bad & F.col("counts") & F.col(f).isNotNull())), of(tables[tbl].where(bad))
        sound, impossible = (good, no) if sound is None else (sound.unionByName(good), impossible.unionByName(no))
    high = spikes.spikes(sound, ["endpoint_id", "reading"], "value", "timestamp", ["row_id"], TIMES_MEDIAN)
    found = _named(impossible, "impossible").unionByName(_named(high, "spike"))
    for tbl, rows in tables.items():
        stuck = spikes.stuck_rows(rows, "endpoint_id", "timestamp", "row_id", [f for t, f in READINGS if t == tbl])
        found = found.unionByName(stuck.select(F.lit(tbl).alias("tbl"), "row_id", "field", F.lit("stuck").alias("kind")))
    return found


def p4_context(spark: SparkSession, d: str) -> DataFrame:
    """Contextual flags of the three fields of p4_found, impossible readings aside: (tbl, field, endpoint_id, row_id, hour, value, q1, q3, outside, jumped)."""
    requests, series = _requests_readings(spark, d), _series_readings(spark, d)
    out = None
    for tbl, rows, field in (("requests", requests, "total_tokens"), ("requests", requests, "response_tokens"), ("series_5min", series, "token_load")):
        possible = rows.where(~F.array_contains("impossible", field))
        flags = spikes.contextual_flags(possible, "endpoint_id", "timestamp", "row_id", field).withColumns({"value": F.col("value").cast("bigint"), "tbl": F.lit(tbl), "field": F.lit(field)})
        part = flags.select("tbl", "field", F.col("source").alias("endpoint_id"), "row_id", "hour", "value", F.round("q1", 3).alias("q1"), F.round("q3", 3).alias("q3"), "outside", "jumped")
        out = part if out is None else out.unionByName(part)
    return out


# -- 6: rows that fail to parse


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.failures(badrows.judge(table(spark, d, "trace_lines")))


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    return badrows.split_rows(table(spark, d, "trace_lines"))[0]


def p6_rejected(spark: SparkSession, d: str) -> DataFrame:
    return badrows.split_rows(table(spark, d, "trace_lines"))[1]


QUERIES = {f.__name__: f for f in (p1_found, p1_unified, p1_correspondences, p2_found, p2_rolling, p3_found, p3_grid, p4_found, p4_context, p6_found, p6_loaded, p6_rejected)}

ORACLES = {}

ORACLES["p1_found"] = r"""
WITH r AS (SELECT feed_id, file_no, payload::JSON AS p FROM feed_records),
e AS (SELECT feed_id, file_no, json_extract(p, '$.rid')::VARCHAR AS rid, UNNEST(json_keys(p)) AS k, p FROM r),
c AS (
  SELECT feed_id, file_no, rid, trim(regexp_replace(lower(k), '[^a-z0-9]+', '_', 'g'), '_') AS f, v,
    CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS t
  FROM (SELECT feed_id, file_no, rid, k, json_extract(p, '/' || replace(replace(k, '~', '~0'), '/', '~1')) AS v FROM e WHERE k <> 'rid')
  WHERE json_type(v) <> 'NULL'),
s AS (SELECT feed_id, file_no, f, arg_max(t, (n, t)) AS t FROM (SELECT feed_id, file_no, f, t, count(*) AS n FROM c GROUP BY ALL) GROUP BY ALL),
files AS (SELECT DISTINCT feed_id, file_no FROM feed_records),
pairs AS (SELECT b.feed_id, b.file_no FROM files b JOIN files a ON a.feed_id = b.feed_id AND a.file_no = b.file_no - 1),
gone AS (SELECT p.feed_id, p.file_no, s.f FROM pairs p JOIN s ON s.feed_id = p.feed_id AND s.file_no = p.file_no - 1
  WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.feed_id = p.feed_id AND x.file_no = p.file_no AND x.f = s.f)),
came AS (SELECT p.feed_id, p.file_no, s.f FROM pairs p JOIN s ON s.feed_id = p.feed_id AND s.file_no = p.file_no
  WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.feed_id = p.feed_id AND x.file_no = p.file_no - 1 AND x.f = s.f)),
ren AS (
  SELECT g.feed_id, g.file_no, g.f AS o, n.f AS w FROM gone g JOIN came n ON n.feed_id = g.feed_id AND n.file_no = g.file_no
  JOIN c a ON a.feed_id = g.feed_id AND a.file_no = g.file_no - 1 AND a.f = g.f
  JOIN c b ON b.feed_id = g.feed_id AND b.file_no = g.file_no AND b.f = n.f AND b.rid = a.rid
  GROUP BY ALL HAVING count(*) >= 3 AND bool_and(a.t = b.t AND a.v::VARCHAR = b.v::VARCHAR))
SELECT feed_id, file_no, 'renamed' AS change_kind, o AS old_field, w AS new_field FROM ren
UNION ALL SELECT feed_id, file_no, 'removed', f, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.feed_id = g.feed_id AND r.file_no = g.file_no AND r.o = g.f)
UNION ALL SELECT feed_id, file_no, 'added', '', f FROM came g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.feed_id = g.feed_id AND r.file_no = g.file_no AND r.w = g.f)
UNION ALL SELECT b.feed_id, b.file_no, 'retyped', b.f, b.f FROM s b JOIN s a ON a.feed_id = b.feed_id AND a.file_no = b.file_no - 1 AND a.f = b.f WHERE a.t <> b.t
"""

_DAILY = r"""
WITH daily AS (SELECT endpoint_id, floor(epoch_us("timestamp") / 86400000000)::BIGINT AS day_no, coalesce(sum(token_load), 0)::BIGINT AS token_load, coalesce(sum(request_count), 0)::BIGINT AS request_count,
  bool_or(coalesce(request_count > 0, false)) AS active FROM series_5min WHERE "timestamp" IS NOT NULL GROUP BY ALL),
ends AS (SELECT endpoint_id, min(day_no) AS a, max(day_no) AS b FROM daily WHERE {active} GROUP BY ALL),
calendar AS (SELECT endpoint_id, UNNEST(range(a, b + 1))::BIGINT AS day_no FROM ends),
dense AS (SELECT k.endpoint_id, k.day_no, coalesce(token_load, 0)::BIGINT AS token_load, coalesce(request_count, 0)::BIGINT AS request_count
  FROM calendar k LEFT JOIN daily d ON d.endpoint_id = k.endpoint_id AND d.day_no = k.day_no)
"""

ORACLES["p2_found"] = _DAILY.replace("{active}", "active") + r""",
s AS (SELECT endpoint_id, day_no, p AS period_days, (SELECT sum(x.request_count) FROM dense x WHERE x.endpoint_id = d.endpoint_id AND x.day_no BETWEEN d.day_no - p + 1 AND d.day_no) AS total
  FROM dense d, (SELECT UNNEST([7::BIGINT, 30::BIGINT]) AS p))
SELECT endpoint_id, day_no, period_days FROM s WHERE total = 0
"""

ORACLES["p2_rolling"] = _DAILY.replace("{active}", "true") + """SELECT endpoint_id, day_no, token_load, request_count, """ + ", ".join(
    f"{m}_sum_{p}::BIGINT AS {m}_sum_{p}, round({m}_sum_{p} / {p}.0e0, 4) AS {m}_avg_{p}" for p in (7, 30) for m in ("token_load", "request_count")
) + " FROM (SELECT *, " + ", ".join(
    f"sum({m}) OVER (PARTITION BY endpoint_id ORDER BY day_no ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW) AS {m}_sum_{p}" for p in (7, 30) for m in ("token_load", "request_count")
) + " FROM dense)"

ORACLES["p3_found"] = r"""
WITH c AS (SELECT DISTINCT endpoint_id, floor(epoch_us("timestamp") / 300000000)::BIGINT AS cell FROM requests WHERE "timestamp" IS NOT NULL),
n AS (SELECT endpoint_id, cell, lead(cell) OVER (PARTITION BY endpoint_id ORDER BY cell) - cell - 1 AS k FROM c)
SELECT endpoint_id, (cell + 1) * 300 AS gap_start, k AS n_windows FROM n WHERE k BETWEEN 12 AND 2016
"""

ORACLES["p3_grid"] = r"""
WITH m AS (SELECT endpoint_id, epoch_us("timestamp") AS us, count(*) AS n, sum(total_tokens) AS total, max(total_tokens) AS v FROM requests WHERE "timestamp" IS NOT NULL GROUP BY ALL),
i AS (SELECT *, us // 300000000 AS cell, lead(us) OVER w AS nxt, lead(us) OVER w // 300000000 AS ncell FROM m WINDOW w AS (PARTITION BY endpoint_id ORDER BY us)),
j AS (SELECT *, CASE WHEN ncell = cell THEN nxt ELSE least(coalesce(nxt, (cell + 1) * 300000000), us + 3600000000) END AS stop, UNNEST(range(cell, coalesce(ncell, cell) + 1)) AS c FROM i),
p AS (SELECT endpoint_id, c, CASE WHEN c = cell THEN n ELSE 0 END AS n, CASE WHEN c = cell THEN total ELSE 0 END AS total, v,
  greatest(least(stop, (c + 1) * 300000000) - greatest(us, c * 300000000), 0) AS w FROM j)
SELECT endpoint_id, c * 300 AS window_start, sum(n)::BIGINT AS n_readings, sum(total)::BIGINT AS token_load,
  round(CASE WHEN sum(w) > 0 THEN sum(v::HUGEINT * w)::DOUBLE / sum(w)::DOUBLE END, 3) AS time_weighted, round(sum(w)::DOUBLE / 300000000.0e0, 6) AS coverage,
  CASE WHEN sum(n) > 0 THEN 'observed' WHEN sum(w) > 0 THEN 'held' ELSE 'missing' END AS status
FROM p GROUP BY endpoint_id, c
"""

ORACLES["p4_found"] = r"""
WITH r AS (
  SELECT 'requests' AS tbl, request_id AS row_id, 'total_tokens' AS field, endpoint_id, "timestamp" AS ts, total_tokens AS v, coalesce(total_tokens < 0 OR total_tokens < response_tokens, false) AS bad, true AS ok FROM requests
  UNION ALL SELECT 'requests', request_id, 'response_tokens', endpoint_id, "timestamp", response_tokens, coalesce(response_tokens < 0, false), true FROM requests
  UNION ALL SELECT 'series_5min', window_id, 'token_load', endpoint_id, "timestamp", token_load, coalesce(token_load < 0 OR (token_load > 0 AND request_count = 0), false), coalesce(request_count > 0, false) FROM series_5min),
m AS (SELECT tbl, field, endpoint_id, median(v) AS med FROM r WHERE NOT bad AND ok GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY tbl, field, endpoint_id ORDER BY ts, row_id) - row_number() OVER (PARTITION BY tbl, field, endpoint_id, v ORDER BY ts, row_id) AS island FROM r),
k AS (SELECT *, count(*) OVER (PARTITION BY tbl, field, endpoint_id, v, island) AS run FROM g)
SELECT tbl, row_id, field, 'impossible' AS kind FROM r WHERE bad
UNION ALL SELECT tbl, row_id, field, 'spike' FROM r JOIN m USING (tbl, field, endpoint_id) WHERE NOT bad AND ok AND v > 20 * med
UNION ALL SELECT tbl, row_id, field, 'stuck' FROM k WHERE run >= 12 AND v <> 0
"""

ORACLES["p4_context"] = r"""
WITH r AS (
  SELECT 'requests' AS tbl, request_id AS row_id, 'total_tokens' AS field, endpoint_id, "timestamp" AS ts, total_tokens AS v FROM requests WHERE NOT coalesce(total_tokens < 0 OR total_tokens < response_tokens, false)
  UNION ALL SELECT 'requests', request_id, 'response_tokens', endpoint_id, "timestamp", response_tokens FROM requests WHERE NOT coalesce(response_tokens < 0, false)
  UNION ALL SELECT 'series_5min', window_id, 'token_load', endpoint_id, "timestamp", token_load FROM series_5min WHERE NOT coalesce(token_load < 0 OR (token_load > 0 AND request_count = 0), false)),
u AS (SELECT *, (floor(epoch_us(ts) / 3600000000)::BIGINT % 24)::INT AS hour, CASE WHEN v = 0 THEN 0.0 ELSE exp((floor(ln(v) / ln(1.02e0)) + 0.5) * ln(1.02e0)) END AS m,
  lag(v) OVER (PARTITION BY tbl, field, endpoint_id ORDER BY epoch_us(ts), row_id)::DOUBLE AS b FROM r WHERE v IS NOT NULL AND ts IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY tbl, field, endpoint_id, hour ORDER BY v) AS i, count(*) OVER (PARTITION BY tbl, field, endpoint_id, hour) AS n FROM u),
q AS (SELECT tbl, field, endpoint_id, hour, max(m) FILTER (i = greatest(ceil(n * 0.25), 1)) AS q1, max(m) FILTER (i = greatest(ceil(n * 0.75), 1)) AS q3 FROM o GROUP BY ALL),
f AS (SELECT u.*, q1, q3, v > q3 + 3 * (q3 - q1) OR v < q1 - 3 * (q3 - q1) AS outside, coalesce(greatest(b, v) > 50 * greatest(least(b, v), 1), false) AS jumped
  FROM u JOIN q ON q.tbl = u.tbl AND q.field = u.field AND q.endpoint_id IS NOT DISTINCT FROM u.endpoint_id AND q.hour = u.hour)
SELECT tbl, field, endpoint_id, row_id, hour, v AS value, round(q1, 3) AS q1, round(q3, 3) AS q3, outside, jumped FROM f WHERE outside OR jumped
"""

_NUMBER = r"regexp_full_match({0}, '[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?') AND coalesce(try_cast({0} AS DOUBLE) BETWEEN 0 AND 1.7976931348623157e308, false)"
_LINES = r"""
WITH q AS (SELECT *, regexp_full_match(line, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS quoted FROM trace_lines),
c AS (SELECT line_id, source_file, line_no, quoted, CASE WHEN quoted THEN list_transform(regexp_extract_all(',' || line, '(?s),("(?:[^"]|"")*"|[^",]*)', 1),
  lambda x: trim(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) END AS cells FROM q),
h AS (SELECT source_file, list_transform(arg_min(cells, line_id), lambda x: trim(regexp_replace(lower(trim(x)), '[^0-9a-z]+', '_', 'g'), '_')) AS names FROM c WHERE line_no = 1 AND cells IS NOT NULL GROUP BY ALL),
j AS (SELECT c.*, coalesce(names, ['timestamp', 'model', 'request_tokens', 'response_tokens', 'total_tokens', 'log_type']) AS names FROM c LEFT JOIN h USING (source_file) WHERE line_no > 1),
v AS (SELECT *, cells[list_position(names, 'timestamp')] AS ts, cells[list_position(names, 'request_tokens')] AS req, cells[list_position(names, 'response_tokens')] AS resp,
  cells[list_position(names, 'model')] AS mo, cells[list_position(names, 'log_type')] AS lt FROM j),
f AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(cells) <> len(names) THEN 'column_count' WHEN NOT (""" + _NUMBER.format("ts") + r""") THEN 'timestamp'
  WHEN NOT (""" + _NUMBER.format("req") + " AND " + _NUMBER.format("resp") + r""") THEN 'tokens'
  WHEN req::DOUBLE <> floor(req::DOUBLE) OR resp::DOUBLE <> floor(resp::DOUBLE) THEN 'tokens'
  WHEN mo NOT IN ('GPT-4', 'ChatGPT') THEN 'model' WHEN lt NOT IN ('API log', 'Conversation log') THEN 'log_type' END AS reason FROM v)
"""
ORACLES["p6_found"] = _LINES + "SELECT line_id, reason FROM f WHERE reason IS NOT NULL"
_RANGED = _LINES + ", g AS (SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN ts::DOUBLE >= 9e12 OR req::DOUBLE + resp::DOUBLE >= 9e18 THEN 'range' END AS why FROM f)"
ORACLES["p6_rejected"] = _RANGED + "SELECT g.line_id, g.source_file, g.line_no, t.line, why AS reason FROM g JOIN trace_lines t USING (line_id) WHERE why IS NOT NULL"
_TOTAL = "cells[list_position(names, 'total_tokens')]"
ORACLES["p6_loaded"] = _RANGED + rf"""SELECT line_id, source_file, to_timestamp(ts::DOUBLE) AS "timestamp", ts::DOUBLE AS timestamp_relative_seconds, mo AS model, lt AS log_type,
  trunc(req::DOUBLE)::BIGINT AS request_tokens, trunc(resp::DOUBLE)::BIGINT AS response_tokens, trunc(req::DOUBLE)::BIGINT + trunc(resp::DOUBLE)::BIGINT AS total_tokens,
  CASE WHEN regexp_full_match({_TOTAL}, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') AND abs(try_cast({_TOTAL} AS DOUBLE)) < 9e18 THEN trunc(try_cast({_TOTAL} AS DOUBLE))::BIGINT END AS reported_total_tokens,
  nullif(cells[list_position(names, 'session_id')], '') AS session_id, try_cast(cells[list_position(names, 'elapsed_time')] AS DOUBLE) AS elapsed_time FROM g WHERE why IS NULL"""
