"""Reading and writing of traces, series and reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemill.functions.scalars import sig3
from tidemill.operators.cleaning import normalize_columns, require_columns


CORRUPT = "_corrupt_record"


def _csv(spark: SparkSession, path: str | Sequence[str], lines_split: bool) -> DataFrame:
    """Headed CSV as text with its malformed records in CORRUPT; names come from the heading alone, nothing is inferred."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", not lines_split).option("enforceSchema", False).option("columnPruning", False)
    names = reader.csv(path).columns
    rows = reader.option("columnNameOfCorruptRecord", CORRUPT).schema(StructType([StructField(n, StringType()) for n in [*names, CORRUPT]])).csv(path)
    # The reader refuses plans that ask for the malformed records alone; this asks for a field besides, and is always true.
    return rows.where(F.coalesce(F.length(F.col(f"`{names[0]}`")), F.lit(0)) >= 0)


def scan_csv(spark: SparkSession, path: str | Sequence[str], needed: Sequence[str] = (), lines_split: bool = False) -> DataFrame:
    """Headed CSV with every column as text, headings in snake case; raises if a needed column is missing.

    A quoted field may hold line breaks, so a file is one task; where it is known that none does, lines_split lets Spark
    split files among tasks. Records with more or fewer fields than the heading are left out; see rejected_csv.
    """
    whole = _csv(spark, path, lines_split)
    return require_columns(normalize_columns(whole.where(F.col(CORRUPT).isNull()).drop(CORRUPT)), needed)


def rejected_csv(spark: SparkSession, path: str | Sequence[str], lines_split: bool = False) -> DataFrame:
    """(source_file, record): the malformed records that scan_csv leaves out, as they stand."""
    return _csv(spark, path, lines_split).where(F.col(CORRUPT).isNotNull()).select(F.input_file_name().alias("source_file"), F.col(CORRUPT).alias("record"))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """zstd Parquet; the committer shows the files only when all are written."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the named columns; the reader prunes the others."""
    return require_columns(spark.read.parquet(path), columns).select(*columns)


def scan_through(spark: SparkSession, path: str, columns: Sequence[str], cutoff: str, ts: str = "timestamp") -> DataFrame:
    """Rows up to a moment, the comparison pushed into the scan; see reaches for the gate on the newest row."""
    return scan_parquet(spark, path, columns).where(F.col(ts) <= F.lit(cutoff).cast("timestamp"))


def reaches(df: DataFrame, cutoff: str, ts: str = "timestamp") -> DataFrame:
    """One row (newest, reached): whether the newest row lies exactly at the cutoff."""
    return df.agg(F.max(ts).alias("newest")).withColumn("reached", F.coalesce(F.col("newest") == F.lit(cutoff).cast("timestamp"), F.lit(False)))


def write_csv(df: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    """Headed CSV, columns renamed for readers where names says so; full precision."""
    df.withColumnsRenamed(names or {}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file of text at a path of any storage that Spark can write, replacing one of that name."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(context._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def report_csv(df: DataFrame, path: str, digits: int = 3) -> None:
    """A small report (metrics, rankings) as one CSV file with rounded numbers, on the storage the path names."""
    rows = df.collect()  # a report: as many rows as models, horizons and segments
    lines = [",".join(df.columns)] + [",".join(sig3(v, digits) if isinstance(v, float) or v is None else str(v) for v in r) for r in rows]
    _write_text(df.sparkSession, path, "\n".join(lines) + "\n")


def report_json(df: DataFrame, path: str) -> None:
    """A small report as a JSON list of rows, on the storage the path names."""
    _write_text(df.sparkSession, path, json.dumps([r.asDict(True) for r in df.collect()], ensure_ascii=False, default=str, indent=1))
