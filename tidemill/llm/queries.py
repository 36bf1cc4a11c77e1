"""Queries of the text problems over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import leakage, packing, percentiles, spans
from tidemill.plans.physical import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ERROR = 0.01


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    train = _table(spark, d, "series_5min").where(F.col("split") == "train").select("endpoint_id", "token_load")
    found = percentiles.percentiles(train, ["endpoint_id"], "token_load", [0.94, 0.96])
    bounds = found.groupBy(F.col("endpoint_id").alias("e")).agg(F.min_by("percentile", "share").alias("low"), F.max_by("percentile", "share").alias("high"))
    published = _table(spark, d, "burst_thresholds").where(F.col("p95_threshold").isNotNull()).select("endpoint_id", "p95_threshold")
    off = published.join(bounds, published["endpoint_id"].eqNullSafe(bounds["e"]))
    return off.where((F.col("p95_threshold") < F.col("low")) | (F.col("p95_threshold") > F.col("high"))).select("endpoint_id")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = percentiles.percentiles(_table(spark, d, "series_5min").select("endpoint_id", "source_batch", "token_load"), ["endpoint_id", "source_batch"], "token_load", [0.5, 0.95, 0.99])
    return found.select("endpoint_id", "source_batch", "share", F.round("percentile", 3).alias("percentile"), "n")


def p5_mergeable(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from sketches per endpoint and day, merged over the days, beside the exact rank values and the error.

    All windows count, those with zero or negative loads too. exact is the value at rank ceil(share * n), error the
    relative error of the estimate (0 where both are 0), at most ERROR.
    """
    series, shares = _table(spark, d, "series_5min").select("endpoint_id", "timestamp", "token_load"), [0.5, 0.95, 0.99]
    days = materialize(percentiles.daily_sketches(series, ["endpoint_id"], "timestamp", "token_load", ERROR))
    estimates = percentiles.sketch_percentiles(percentiles.merge_sketches(days, ["endpoint_id"]), ["endpoint_id"], shares, ERROR)
    found = percentiles.percentiles(series, ["endpoint_id"], "token_load", shares, at_rank=True)
    found = found.select(F.col("endpoint_id").alias("e"), F.col("share").alias("s"), F.col("percentile").alias("exact"), "n")
    both = estimates.join(found, F.col("endpoint_id").eqNullSafe(F.col("e")) & (F.col("share") == F.col("s")))
    off = F.abs(F.col("percentile") - F.col("exact"))
    error = F.when(off == 0, F.lit(0.0)).otherwise(off / F.abs(F.col("exact")))
    return both.select("endpoint_id", "share", F.round("percentile", 3).alias("percentile"), "exact", F.round(error, 6).alias("error"), "n")


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents"), _table(spark, d, "context_windows"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packing(spark, d))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))
    return found.withColumn("best_similarity", F.round("best_similarity", 6))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(leakage.leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"), near=False))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(spans.shared_windows(_table(spark, d, "documents")))


def p9_groups(spark: SparkSession, d: str) -> DataFrame:
    """The sets of documents that share a passage, as membership: a row per document and set, with the set's first, last and number of documents."""
    members = spans.sharing_groups(spans.shared_windows(_table(spark, d, "documents")))
    sets = members.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("n_docs"))
    return members.join(sets, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).select("first_doc", "last_doc", "n_docs", "doc_id")


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(spans.shared_windows(_table(spark, d, "documents")))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    documents = _table(spark, d, "documents")
    return spans.shared_report(documents, spans.shared_windows(documents))


QUERIES = {f.__name__: f for f in (p5_found, p5_percentiles, p5_mergeable, p7_packing, p7_fill, p8_found, p8_leaks, p9_found, p9_groups, p9_spans, p9_shared)}

ORACLES = {}

ORACLES["p5_found"] = r"""
WITH q AS (SELECT endpoint_id, quantile_cont(token_load::DOUBLE, 0.94) AS a, quantile_cont(token_load::DOUBLE, 0.96) AS b FROM series_5min WHERE split = 'train' GROUP BY ALL)
SELECT t.endpoint_id FROM burst_thresholds t JOIN q ON q.endpoint_id IS NOT DISTINCT FROM t.endpoint_id WHERE p95_threshold < a OR p95_threshold > b
"""

ORACLES["p5_percentiles"] = r"""
SELECT endpoint_id, source_batch, s::DOUBLE AS share, round(CASE s WHEN 0.5 THEN a WHEN 0.95 THEN b ELSE c END, 3) AS percentile, n
FROM (SELECT endpoint_id, source_batch, quantile_cont(token_load::DOUBLE, 0.5) AS a, quantile_cont(token_load::DOUBLE, 0.95) AS b, quantile_cont(token_load::DOUBLE, 0.99) AS c, count(token_load) AS n FROM series_5min GROUP BY ALL),
  (SELECT UNNEST([0.5, 0.95, 0.99]) AS s) WHERE n > 0
"""

#: Buckets of the sketches: exponents to the base 1 + ERROR, rising with the value.
_LOG = f"ln({1 + ERROR}e0)"
ORACLES["p5_mergeable"] = rf"""
WITH v AS (SELECT endpoint_id, token_load::DOUBLE AS v, CASE WHEN token_load = 0 THEN 0 ELSE sign(token_load) * (floor(ln(abs(token_load)) / {_LOG}) + 1) END AS b FROM series_5min WHERE token_load IS NOT NULL),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY endpoint_id) AS n FROM v WINDOW w AS (PARTITION BY endpoint_id ORDER BY v)),
r AS (SELECT endpoint_id, s::DOUBLE AS share, v AS exact, n, CASE WHEN b = 0 THEN 0.0 ELSE sign(b) * exp((abs(b) - 0.5) * {_LOG}) END AS p FROM o, (SELECT UNNEST([0.5e0, 0.95e0, 0.99e0]) AS s) WHERE i = greatest(ceil(s * n), 1))
SELECT endpoint_id, share, round(p, 3) AS percentile, exact, round(CASE WHEN p = exact THEN 0 ELSE abs(p - exact) / abs(exact) END, 6) AS error, n FROM r
"""


ORACLES["p8_found"] = r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}]+'), lambda w: lower(w)) AS w FROM documents),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}]+'), lambda w: lower(w)) AS w FROM eval_items),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 11)) AS k FROM d)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT item_id, w, UNNEST(range(1, len(w) - 11)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)
"""

_WINDOWS = r"""
WITH w AS (SELECT doc_id, k - 1 AS pos, substring(text, k, 200) AS s FROM (SELECT doc_id, text, UNNEST(range(1, length(text) - 198)) AS k FROM documents)),
h AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
m AS (SELECT DISTINCT doc_id, pos, s FROM w SEMI JOIN h USING (s))
"""
ORACLES["p9_found"] = _WINDOWS + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM m a JOIN m b ON a.s = b.s AND a.doc_id < b.doc_id"
ORACLES["p9_groups"] = _WINDOWS + """, g AS (SELECT DISTINCT docs FROM (SELECT s, list(DISTINCT doc_id ORDER BY doc_id) AS docs FROM m GROUP BY s))
SELECT docs[1] AS first_doc, docs[-1] AS last_doc, len(docs) AS n_docs, UNNEST(docs) AS doc_id FROM g"""
_SPANS = _WINDOWS + r""",
p AS (SELECT DISTINCT doc_id, pos FROM m),
g AS (SELECT doc_id, pos, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 200, true) AS apart FROM p),
n AS (SELECT *, sum(apart::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM g),
x AS (SELECT doc_id, min(pos) AS "start", max(pos) + 200 AS "end" FROM n GROUP BY doc_id, part)
"""
ORACLES["p9_spans"] = _SPANS + 'SELECT doc_id, "start", "end" FROM x'
ORACLES["p9_shared"] = _SPANS + r""",
t AS (SELECT doc_id, count(*) AS n, max("end" - "start") AS longest, sum("end" - "start")::BIGINT AS chars FROM x GROUP BY ALL),
z AS (SELECT doc_id, coalesce(max(length(text)), 0)::BIGINT AS n_chars FROM documents GROUP BY ALL)
SELECT z.doc_id, n_chars, coalesce(n, 0)::BIGINT AS n_spans, coalesce(longest, 0)::BIGINT AS longest, coalesce(chars, 0)::BIGINT AS shared_chars, round(coalesce(chars / nullif(n_chars, 0), 0)::DOUBLE, 6) AS shared_share
FROM z LEFT JOIN t ON t.doc_id = z.doc_id
"""
