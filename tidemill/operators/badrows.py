"""Raw delimited lines into typed rows and rejected lines with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.scalars import coerce_numeric
from tidemill.plans.physical import materialize, sized_join

#: The columns of a trace without a readable header.
TRACE_COLUMNS = ["timestamp", "model", "request_tokens", "response_tokens", "total_tokens", "log_type"]
#: The admitted names of models and log types.
MODELS = ["GPT-4", "ChatGPT"]
LOG_TYPES = ["API log", "Conversation log"]
#: Rules of trace cells: (column, check, reason, order of the reason). quoting and column_count come before them.
RULES = [
    ("timestamp", "number", "timestamp", 3),
    ("request_tokens", "whole", "tokens", 4),
    ("response_tokens", "whole", "tokens", 4),
    ("model", "model", "model", 5),
    ("log_type", "log_type", "log_type", 6),
]
REASONS = {1: "quoting", 2: "column_count", 3: "timestamp", 4: "tokens", 5: "model", 6: "log_type"}
NUMBER = r"^[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$"
#: Seconds and counts from these on do not fit TIMESTAMP and BIGINT.
SECONDS_END, COUNT_END = 9e12, 9e18
BLANKS = " \t\r\n\f\u000b"


def segments(line: Column) -> Column:
    """The line cut at every quotation mark: even places lie outside quotes, odd ones inside."""
    return F.split(line, '"', -1)


def well_quoted(line: Column) -> Column:
    """Whether quotes occur only around whole fields, inner ones doubled.

    Judged on the stretches between quotes, without a backtracking pattern, so that length does not matter: their number
    is odd, and a stretch outside quotes is empty (a doubled quote), or begins and ends with a comma where it meets one.
    """
    parts = segments(line)
    last = F.size(parts) - 1
    outside = F.filter(
        parts,
        lambda x, i: (i % 2 == 0) & (x != "") & (((i > 0) & ~x.startswith(",")) | ((i < last) & ~x.endswith(","))),
    )
    return (last % 2 == 0) & (F.size(outside) == 0)


def cells_of(line: Column) -> Column:
    """The fields of a well-quoted line, unquoted, blanks around them dropped."""
    # Commas outside quotes become a mark; where the mark itself occurs in the line it is spelled with an escape meanwhile.
    mark, escape = "\u0001", "\u0002"
    spelled = F.replace(F.replace(line, F.lit(escape), F.lit(escape + "b")), F.lit(mark), F.lit(escape + "a"))
    marked = F.array_join(F.transform(segments(spelled), lambda x, i: F.when(i % 2 == 0, F.translate(x, ",", mark)).otherwise(x)), '"')
    plain = lambda x: F.replace(F.replace(x, F.lit(escape + "a"), F.lit(mark)), F.lit(escape + "b"), F.lit(escape))
    unquoted = lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(F.split(marked, mark, -1), lambda x: F.btrim(plain(unquoted(x)), F.lit(BLANKS)))


def column_name(name: Column) -> Column:
    """Lower snake case of a heading: runs of other characters become one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.btrim(name)), "[^0-9a-z]+", "_"), F.lit("_"))


def valid_cell(check: Column, value: Column) -> Column:
    """Whether a cell holds what its rule asks for."""
    number = F.when(value.rlike(NUMBER), value.try_cast("double"))
    finite = number.isNotNull() & (number >= 0) & (number < F.lit(float("inf")))
    return F.coalesce(
        F.when(check == "number", finite)
        .when(check == "whole", finite & (number == F.floor(number)))
        .when(check == "model", value.isin(MODELS))
        .when(check == "log_type", value.isin(LOG_TYPES)),
        F.lit(False),
    )


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "column string, check string, reason string, place int")


def judge(lines: DataFrame) -> DataFrame:
    """Every record line (line_no > 1) with its parsed cells, its file's columns and the reason it fails (null if it loads).

    Input: line_id, source_file, line_no, line; output: those, cells (array), names (array of the file's columns) and
    reason. Cells are exploded into (line, column, value), joined with the rule table and the failures aggregated per
    line; lines are joined to their file's header by broadcast, or, of many files, by a
    salted key, as one file may hold a large part of all lines. A
    file without a header line is read with TRACE_COLUMNS; of several header lines the one with the lowest line_id holds.
    Null lines fail as column_count (they have no field); an empty line has one empty field.
    """
    cells = lines.select(
        "line_id", "source_file", "line_no", "line", F.when(F.coalesce(well_quoted(F.col("line")), F.lit(True)), F.coalesce(cells_of(F.col("line")), F.array().cast("array<string>"))).alias("cells")
    )
    headers = (
        cells.where((F.col("line_no") == 1) & F.col("cells").isNotNull())
        .groupBy("source_file")
        .agg(F.min_by("cells", "line_id").alias("heading"))
        .select("source_file", F.transform("heading", column_name).alias("names"))
    )
    records = cells.where(F.coalesce(F.col("line_no") > 1, F.lit(True)))
    default = F.array(*[F.lit(c) for c in TRACE_COLUMNS])
    return sized_join(records, materialize(headers), ["source_file"], ["line_id"], "left", row_bytes=1000).withColumn("names", F.coalesce("names", default))


def failures(judged: DataFrame) -> DataFrame:
    """(line_id, reason): the first reason that holds, for every line that fails. `judged`: the rows of judge()."""
    rules = F.broadcast(rule_table(judged.sparkSession))  # as many rows as RULES
    shape = F.when(F.col("cells").isNull(), F.lit(1)).when(F.size("cells") != F.size("names"), F.lit(2))
    shaped = judged.select("line_id", "cells", "names", shape.alias("shape"))
    by_shape = shaped.where(F.col("shape").isNotNull()).select("line_id", F.col("shape").alias("place"))
    exploded = shaped.where(F.col("shape").isNull()).select("line_id", F.explode(F.arrays_zip("names", "cells")).alias("x"))
    exploded = exploded.select("line_id", F.col("x.names").alias("column"), F.col("x.cells").alias("value"))
    by_cell = exploded.join(rules, "column").where(~valid_cell(F.col("check"), F.col("value"))).select("line_id", "place")
    names = F.create_map(*[y for k, v in REASONS.items() for y in (F.lit(k), F.lit(v))])
    worst = by_shape.unionByName(by_cell).groupBy("line_id").agg(F.min("place").alias("place"))
    return worst.select("line_id", names[F.col("place")].alias("reason"))


def cell(name: str) -> Column:
    """The text of a judged line's column, null if its file has none of that name."""
    return F.get("cells", F.array_position("names", name).cast("int") - 1)


def split_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loaded, rejected): the valid lines as typed requests, and (line_id, source_file, line_no, line, reason) of the others.

    loaded is the anti-join of the lines with the failures. total_tokens is the sum of both counts, reported_total_tokens
    what the line holds, null if that is no number. Columns a file does not have are null. Lines that are valid but whose
    time or counts do not fit a TIMESTAMP or BIGINT are rejected as `range`, the last of the reasons.
    """
    judged = materialize(judge(lines))
    seconds, request, response = (cell(c).try_cast("double") for c in ("timestamp", "request_tokens", "response_tokens"))
    wide = (seconds >= SECONDS_END) | (request + response >= COUNT_END)
    failing = failures(judged)
    found = judged.where(wide).select("line_id", F.lit("range").alias("reason"))
    failed = materialize(failing.unionByName(found).groupBy("line_id").agg(F.min_by("reason", F.col("reason") == "range").alias("reason")))
    rejected = judged.select("line_id", "source_file", "line_no", "line").join(failed, "line_id")
    clean = judged.join(failed, "line_id", "left_anti")
    reported = coerce_numeric(cell("total_tokens"))
    loaded = clean.select(
        "line_id",
        "source_file",
        F.timestamp_micros(F.round(seconds * 1e6).cast("bigint")).alias("timestamp"),
        seconds.alias("timestamp_relative_seconds"),
        cell("model").alias("model"),
        cell("log_type").alias("log_type"),
        request.cast("bigint").alias("request_tokens"),
        response.cast("bigint").alias("response_tokens"),
        (request.cast("bigint") + response.cast("bigint")).alias("total_tokens"),
        F.when(F.abs(reported) < COUNT_END, reported).cast("bigint").alias("reported_total_tokens"),
        F.nullif(cell("session_id"), F.lit("")).alias("session_id"),
        cell("elapsed_time").try_cast("double").alias("elapsed_time"),
    )
    return loaded, rejected
