"""Comparison of a query with its SQL on the small test tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata/sf0.001")


def connect(data: Path = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def text(x) -> str:
    if x is None or (not isinstance(x, (list, tuple, dict)) and not hasattr(x, "tolist") and pd.isna(x)):
        return "null"
    if isinstance(x, pd.Timestamp):
        return str(x.tz_convert("UTC").tz_localize(None) if x.tz else x)
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e15:
        x = int(x)
    return str(x)


def counted(pdf: pd.DataFrame) -> Counter:
    pdf = pdf[sorted(pdf.columns)]
    return Counter(tuple(text(v) for v in r) for r in pdf.itertuples(index=False))


def compare(spark, con, query, sql: str, data: Path = DATA) -> None:
    mine = query(spark, str(data)).toPandas()
    theirs = con.execute(sql).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = counted(mine), counted(theirs)
    assert a == b, f"only here: {list((a - b).items())[:3]}; only in SQL: {list((b - a).items())[:3]}"
