"""Windows over one long series without moving it to one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def over_series(df: DataFrame, key: str, index: str, build: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Columns over each key's rows in order of `index`: right for many keys, each of which a task can sort."""
    return df.withColumns(build(Window.partitionBy(key).orderBy(index)))


def over_blocks(df: DataFrame, key: str, index: str, build: Callable[[WindowSpec], dict[str, Column]], back: int, ahead: int = 0, block: int = 2016) -> DataFrame:
    """The same for series too long for a task: blocks of `block` rows with a halo of copied rows on either side.

    `index` must be dense (0, 1, 2, ...) within a key; `back` and `ahead` are the farthest rows that any column looks at.
    Each row is copied into the blocks whose rows can see it, and only rows of a block's own are kept.
    """
    first = F.floor(F.greatest(F.col(index) - ahead, F.lit(0)) / F.lit(block))
    last = F.floor((F.col(index) + back) / F.lit(block))
    spread = df.withColumn("__block", F.explode(F.sequence(first, last)))
    out = spread.withColumns(build(Window.partitionBy(key, "__block").orderBy(index)))
    return out.where(F.floor(F.col(index) / F.lit(block)) == F.col("__block")).drop("__block")


def with_previous(df: DataFrame, keys: list[str], block: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the `value` of the row before within keys, by (block, order), the rows of a key being cut into blocks.

    `block` must not fall as the order rises. Inside a block it is a plain lag; the last value of each block is carried to
    the next one by a window over blocks, so a key that holds a third of all rows is still many tasks. Null keys are keys.
    """
    inside = df.withColumn("__in", F.lag(value).over(Window.partitionBy(*keys, block).orderBy(*order)))
    inside = inside.withColumn("__first", F.row_number().over(Window.partitionBy(*keys, block).orderBy(*order)) == 1)
    last = df.groupBy(*keys, block).agg(F.max_by(value, F.struct(*order)).alias("__last"))
    carried = last.withColumn("__carried", F.lag("__last").over(Window.partitionBy(*keys).orderBy(block))).drop("__last").withColumnsRenamed({k: f"__c_{k}" for k in [*keys, block]})
    same = F.lit(True)
    for k in [*keys, block]:
        same = same & F.col(k).eqNullSafe(F.col(f"__c_{k}"))
    out = inside.join(carried, same, "left").withColumn(name, F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__in")))
    return out.drop("__in", "__first", "__carried", *[f"__c_{k}" for k in [*keys, block]])
