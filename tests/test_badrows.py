"""Rejected lines: every reason, quoting, odd but valid lines, missing headers, long lines."""

import csv
import io
import random

from tidemill.operators import badrows

HEAD = "Timestamp,Model,Request tokens,Response tokens,Total tokens,Log Type"
GOOD = "1.5,GPT-4,10,2,12,API log"


def judge(spark, lines, head=HEAD):
    data = ([(0, "f", 1, head, "x")] if head is not None else []) + [(i + 1, "f", i + 2, x, "x") for i, x in enumerate(lines)]
    df = spark.createDataFrame(data, "line_id bigint, source_file string, line_no bigint, line string, cells string").repartition(3)
    return df, {r["line_id"] - 1: r["reason"] for r in badrows.failures(badrows.judge(df)).collect()}


def test_reasons(spark):
    lines = {
        GOOD: None, '1,GPT-4,1,1,2," API log "': None, "+1e3, ChatGPT ,1.0,1.25e3,,Conversation log": None, '"1",GPT-4,"1",1,2,API log': None,
        '1,"GPT-4,1,1,2,API log': "quoting", '1,GPT"-4,1,1,2,API log': "quoting", '1,"GPT-4"x,1,1,2,API log': "quoting", '1, "GPT-4",1,1,2,API log': "quoting", '"1,GPT-4,1': "quoting",
        "": "column_count", "1,GPT-4,1,1,2": "column_count", GOOD + ",": "column_count", "a,b": "column_count",
        "x,GPT-4,1,1,2,API log": "timestamp", "-1,GPT-4,1,1,2,API log": "timestamp", "1e999,GPT-4,1,1,2,API log": "timestamp", ",GPT-4,x,1,2,API log": "timestamp", "NaN,GPT-4,1,1,2,API log": "timestamp", "１,GPT-4,1,1,2,API log": "timestamp", "1d,GPT-4,1,1,2,API log": "timestamp",
        "1,GPT-4,1.5,1,2,API log": "tokens", "1,GPT-4,1,-1,2,API log": "tokens", "1,gpt-4,,1,2,API log": "tokens",
        "1,gpt-4,1,1,2,x": "model", "1,,1,1,2,x": "model", "1,GPT-4,1,1,2,Api log": "log_type", '1,GPT-4,1,1,2,"""API log"': "log_type",
    }
    _, got = judge(spark, list(lines))
    assert {k: got.get(i) for i, k in enumerate(lines)} == lines


def test_null_line_and_no_header(spark):
    _, got = judge(spark, [None, GOOD], None)
    assert got == {0: "column_count"}


def test_line_breaks_long_lines_and_columns(spark, rows):
    long = "s" * 300_000 + '""' * 50_000
    df, got = judge(spark, [f'{GOOD},"a\nb",1.5', f'{GOOD},"{long}",2', GOOD], HEAD + ",Session ID,Elapsed time")
    assert got == {2: "column_count"}
    loaded, rejected = badrows.split_rows(df)
    assert [(r["line_id"], len(r["session_id"]), r["elapsed_time"], r["request_tokens"]) for r in loaded.orderBy("line_id").collect()] == [(1, 3, 1.5, 10), (2, 350_000, 2.0, 10)]
    assert rows(rejected.select("line_id", "reason")) == [(3, "column_count")]


def test_cells_as_csv_reads_them(spark):
    rng = random.Random(6)
    records = [["".join(rng.choice('ab ,"\n') for _ in range(rng.randrange(6))) for _ in range(4)] for _ in range(200)]
    lines = []
    for r in records:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(r)
        lines.append(out.getvalue())
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = df.select("i", badrows.well_quoted(df["line"]).alias("ok"), badrows.cells_of(df["line"]).alias("cells")).orderBy("i").collect()
    assert all(g["ok"] for g in got)
    assert [list(g["cells"]) for g in got] == [[x.strip(" \t\r\n\f\v") for x in r] for r in records]


def test_marks_totals_and_range(spark, rows):
    odd = "1,GPT-4,1,1,2,API log,a\u0001b\u0002a\u0002,3"
    df, _ = judge(spark, [odd, "9e12,GPT-4,1,1,2,API log,,", "1,GPT-4,9e18,1,2,API log,,", '1,GPT-4,"3",4,oops,API log,"x\u0001,y",'], HEAD + ",Session ID,Elapsed time")
    loaded, rejected = badrows.split_rows(df)
    assert rows(loaded.select("line_id", "session_id", "total_tokens", "reported_total_tokens")) == [(1, "a\u0001b\u0002a\u0002", 2, 2), (4, "x\u0001,y", 7, None)]
    assert rows(rejected.select("line_id", "reason")) == [(2, "range"), (3, "range")]


def test_empty(spark, rows):
    df, _ = judge(spark, [], None)
    assert [rows(x) for x in badrows.split_rows(df)] == [[], []]
