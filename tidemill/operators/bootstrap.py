"""Confidence intervals by resampling whole days."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.scalars import ratio_or_zero, smape_term
from tidemill.operators.metrics import confusion
from tidemill.operators.spikes import bucket_of
from tidemill.plans.physical import materialize, sized_join

METRICS = ["mae", "rmse", "smape_percent", "precision", "recall", "f1"]
#: Counts by score and day that one task takes at a time, and cells of a matrix in it.
SLICE_ROWS = 50_000
CELLS = 1_000_000


def day_blocks(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sufficient sums per group and UTC day, days numbered from 0 in order; partial days are blocks too."""
    e = F.col("y_pred") - F.col("y_true")
    day = F.floor(F.unix_seconds("timestamp") / F.lit(86_400)).cast("bigint")
    sums = predictions.groupBy(*keys, day.alias("day_no")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(e)).alias("abs_error"), F.sum(e * e).alias("sq_error"), F.sum(smape_term(F.col("y_true"), F.col("y_pred"))).alias("smape"), *[v.alias(k) for k, v in confusion().items()]
    )
    by = Window.partitionBy(*keys)
    return sums.withColumns({"pos": F.row_number().over(by.orderBy("day_no")) - 1, "blocks": F.count(F.lit(1)).over(by)})


def draws(sizes: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """(keys..., replicate, pos, times): how often each block is drawn in each replicate, `blocks` draws with replacement.

    sizes: (keys..., blocks). A draw is the first 32 bits of md5('seed:replicate:draw') modulo the number of blocks: the
    same on every engine and for every partitioning, with no state.
    """
    one = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"))))
    one = one.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("draw").cast("string")))
    pos = F.pmod(F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint"), F.col("blocks"))
    return one.groupBy(*keys, "replicate", pos.alias("pos")).agg(F.count(F.lit(1)).alias("times"))


def replicate_metrics(blocks: DataFrame, drawn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The metrics of every replicate from the blocks' sums, each as often as it was drawn; rows are never copied."""
    right = drawn.withColumnsRenamed({k: f"__{k}" for k in [*keys, "pos"]})
    same = F.col("pos") == F.col("__pos")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    w = F.col("times")
    sums = blocks.join(right, same).groupBy(*keys, "replicate").agg(*[F.sum(F.col(c) * w).alias(c) for c in ("n", "abs_error", "sq_error", "smape", "tp", "fp", "fn", "tn")])
    tp = F.col("tp").cast("double")
    return sums.select(
        *keys, "replicate", (F.col("abs_error") / F.col("n")).alias("mae"), F.sqrt(F.col("sq_error") / F.col("n")).alias("rmse"), (F.col("smape") * 100.0 / F.col("n")).alias("smape_percent"),
        ratio_or_zero(tp, F.col("tp") + F.col("fp")).alias("precision"), ratio_or_zero(tp, F.col("tp") + F.col("fn")).alias("recall"), ratio_or_zero(2 * tp, 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def intervals(replicated: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS, bounds: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """(keys..., metric, low, high): percentile intervals over the replicates."""
    flat = replicated.unpivot([*keys, "replicate"], list(metrics), "metric", "value")
    return flat.groupBy(*keys, "metric").agg(F.percentile("value", bounds[0]).alias("low"), F.percentile("value", bounds[1]).alias("high"))


def block_bootstrap(predictions: DataFrame, keys: Sequence[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Intervals of mae, rmse, smape, precision, recall and f1 per group; see day_blocks, draws and replicate_metrics."""
    blocks = day_blocks(predictions, keys)
    sizes = blocks.groupBy(*keys).agg(F.max("blocks").alias("blocks"))
    return intervals(replicate_metrics(blocks, draws(sizes, keys, replicates, seed), keys), keys)


@lru_cache(4)
def drawn_times(blocks: int, replicates: int, seed: int) -> np.ndarray:
    """The draws of one group as a matrix of blocks by replicates: how often each block is drawn."""
    out = np.zeros((blocks, replicates))
    for r in range(replicates):
        for j in range(blocks):
            out[int(hashlib.md5(f"{seed}:{r}:{j}".encode()).hexdigest()[:8], 16) % blocks, r] += 1
    return out


def step_sums(score: np.ndarray, pos: np.ndarray, tp: np.ndarray, n: np.ndarray, above_tp: np.ndarray, above_n: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Per replicate the sum of tp * precision over the distinct scores of a slice.

    A row: tp true cases among n of one score and block; above_tp, above_n: those of all higher scores, by block. Only
    scores with a true case add anything, so counts by block are summed up to each of these and multiplied with the draws:
    no row is repeated a replicate.
    """
    order = np.argsort(score, kind="stable")[::-1]
    score, pos, tp, n = score[order], pos[order], tp[order], n[order]
    a, b = score[1:], score[:-1]
    step = np.concatenate([[0], np.cumsum((a != b) & ((a == a) | (b == b)))])
    hits = np.flatnonzero(np.bincount(step, tp) > 0)
    # The next score with a true case, with which each row is counted; none after the last.
    mark = np.searchsorted(hits, step)
    blocks, replicates = times.shape
    size = max(1, CELLS // max(blocks, replicates))
    seen_tp, seen_n, out = above_tp @ times, above_n @ times, np.zeros(replicates)
    for at in range(0, len(hits), size):
        m = min(size, len(hits) - at)
        own = slice(*np.searchsorted(mark, [at, at + m]))
        cell = (mark[own] - at) * blocks + pos[own]
        weighted = lambda c: np.bincount(cell, c[own], m * blocks).reshape(m, blocks) @ times  # noqa: B023, E731
        here = weighted(tp)
        all_tp, all_n = seen_tp + np.cumsum(here, axis=0), seen_n + np.cumsum(weighted(n), axis=0)
        # Where no row has been drawn yet, no true case has.
        out += (here * all_tp / np.maximum(all_n, 1)).sum(axis=0)
        seen_tp, seen_n = all_tp[-1], all_n[-1]
    return out


def replicate_precision(predictions: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """(keys..., replicate, average_precision); 0 where no true case is drawn. Days are blocks as in day_blocks, null keys a group.

    Counted once by score and day. Scores are cut into slices of about SLICE_ROWS counts, each with the sums by day of all
    higher slices (a row per slice and day), so that one group is as many tasks as it has slices.
    """
    day = F.floor(F.unix_seconds("timestamp") / F.lit(86_400)).cast("bigint")
    counts = predictions.groupBy(*keys, day.alias("day_no"), F.col("y_pred").alias("score")).agg(F.count_if("actual_burst").alias("tp"), F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.withColumn("range", bucket_of(F.col("score"))))
    days = counts.groupBy(*keys, "day_no").agg(F.sum("tp").alias("group_tp"))
    days = materialize(days.withColumn("pos", (F.row_number().over(Window.partitionBy(*keys).orderBy("day_no")) - 1).cast("bigint")))
    # True cases without a score are missed: they count among all of a group only.
    ranges = counts.where(F.col("score").isNotNull()).groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("k"))
    down = Window.partitionBy(*keys).orderBy(F.desc("range"))
    ranges = materialize(ranges.select(*keys, "range", F.floor((F.sum("k").over(down) - F.col("k")) / SLICE_ROWS).cast("bigint").alias("slice")))
    rows = sized_join(sized_join(counts.where(F.col("score").isNotNull()), ranges, [*keys, "range"], ["score", "day_no"]), days.drop("group_tp"), [*keys, "day_no"], ["score"])
    rows = materialize(rows.select(*keys, "slice", "score", "pos", "tp", "n"))

    # Every slice has a row for every day, whether the day has scores there or not.
    zero = F.lit(0).cast("bigint")
    every = sized_join(ranges.select(*keys, "slice").distinct(), days.drop("day_no"), keys, ["slice"]).withColumns({"tp": zero, "n": zero})
    sums = every.unionByName(rows.select(*keys, "slice", "pos", "tp", "n").withColumn("group_tp", zero)).groupBy(*keys, "slice", "pos").agg(*[F.sum(c).alias(c) for c in ("tp", "n", "group_tp")])
    higher = Window.partitionBy(*keys, "pos").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    above = sums.select(*keys, "slice", "pos", "group_tp", *[F.coalesce(F.sum(c).over(higher), zero).alias(f"above_{c}") for c in ("tp", "n")])

    def run(key: tuple, own: pa.Table, by_day: pa.Table) -> pa.Table:
        by_day = by_day.sort_by("pos")
        times = drawn_times(by_day.num_rows, replicates, seed)
        total = by_day["group_tp"].to_numpy() @ times
        part = step_sums(*[own[c].to_numpy() for c in ("score", "pos", "tp", "n")], by_day["above_tp"].to_numpy(), by_day["above_n"].to_numpy(), times) / np.maximum(total, 1)
        return pa.Table.from_arrays([*[pa.repeat(k, replicates) for k in key[:-1]], pa.array(range(replicates), pa.int64()), pa.array(part)], [*keys, "replicate", "part"])

    kinds = dict(predictions.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "replicate bigint", "part double"])
    parts = rows.groupBy(*keys, "slice").cogroup(above.groupBy(*keys, "slice")).applyInArrow(run, schema)
    return parts.groupBy(*keys, "replicate").agg(F.sum("part").alias("average_precision"))


def bootstrap_precision(predictions: DataFrame, keys: Sequence[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Intervals of average precision, which no sums of days give; see replicate_precision."""
    return intervals(replicate_precision(predictions, keys, replicates, seed), keys, ["average_precision"])
