"""Physical building blocks: written intermediate tables, salted joins and size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import shared_dir

#: Bytes up to which a side may be broadcast: its counted rows times the bytes a row of it takes at most.
BROADCAST_BYTES = 20_000_000
ROW_BYTES = 100
#: Slices a hot key is split into.
SALTS = 16
_written: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write df to a table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs only the reading of files, and gives the planner real sizes.
    """
    path = f"{shared_dir(df.sparkSession)}/tidemill-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Delete all tables this process has written in between; for when no result that reads them is needed any more."""
    context = spark.sparkContext
    conf, n = context._jsc.hadoopConfiguration(), 0
    while _written:
        path = context._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n


def salt_of(*cols: str | Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join big (its hot keys split into `salts` slices by a hash of `spread`) with small, repeated once a slice.

    Null keys meet null keys. how: inner, left, left_semi or left_anti. Columns of small other than keys are appended.
    A key that holds a third of big is spread over `salts` tasks. Both sides are shuffled: the planner may not broadcast
    the repeated side, whose size its estimates do not know; see sized_join for a side that is small.
    """
    left = big.withColumn("__salt", salt_of(*spread, salts=salts))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnsRenamed({k: f"__r_{k}" for k in keys})
    right = right.withColumnRenamed("__salt", "__r_salt").hint("merge")
    cond = F.col("__salt") == F.col("__r_salt")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(right, cond, how).drop("__salt", "__r_salt", *[f"__r_{k}" for k in keys])


def skew_semi_join(big: DataFrame, counted: DataFrame, keys: list[str], n: str, parts: int = 10_000) -> DataFrame:
    """Rows of big whose keys are in counted (written; n: how many rows of big bear the key).

    A key with more than 1 / `parts` of all rows counted is hot; there can be `parts` of them at most, so they are
    broadcast and their rows stay where they are. All other keys are shuffled, none of them large. Keys are not null.
    """
    least = (counted.agg(F.sum(n)).first()[0] or 0) / parts
    hot = F.broadcast(counted.where(F.col(n) > least).select(*keys))
    cold = counted.where(F.col(n) <= least).select(*keys)
    return big.join(hot, keys, "left_semi").unionByName(big.join(hot, keys, "left_anti").join(cold, keys, "left_semi"))


def sized_join(big: DataFrame, written: DataFrame, keys: list[str], spread: list[str], how: str = "inner", rows: int | None = None, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Broadcast `written` (a materialized table, or one of `rows` rows at most) if its counted rows prove it small, else the salted join.

    row_bytes: what a row of `written` takes at most; it is small up to BROADCAST_BYTES in all.
    """
    if (written.count() if rows is None else rows) * row_bytes <= BROADCAST_BYTES:
        right = F.broadcast(written.withColumnsRenamed({k: f"__r_{k}" for k in keys}))
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        return big.join(right, cond, how).drop(*[f"__r_{k}" for k in keys])
    return salted_join(big, written, keys, spread, how)
