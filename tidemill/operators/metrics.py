"""Errors of forecasts and of burst detection, and what is built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.scalars import ratio_or_zero, smape_term
from tidemill.operators.spikes import bucket_of

#: Orders of rows in reports.
HORIZON_ORDER = [15, 5, 60]
MODEL_ORDER = ["persistence", "seasonal_naive", "gbt", "lstm"]


def regression() -> dict[str, Column]:
    """Aggregates mae, rmse, smape_percent and bias over y_true and y_pred."""
    e = F.col("y_pred") - F.col("y_true")
    return {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "smape_percent": F.lit(100.0) * F.avg(smape_term(F.col("y_true"), F.col("y_pred"))), "bias": F.avg(e)}


def confusion() -> dict[str, Column]:
    """Aggregates tp, fp, fn and tn, both sides at or above the threshold."""
    a, p = F.col("y_true") >= F.col("threshold"), F.col("y_pred") >= F.col("threshold")
    return {"tp": F.count_if(a & p), "fp": F.count_if(~a & p), "fn": F.count_if(a & ~p), "tn": F.count_if(~a & ~p)}


def detection(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn; 0 where undefined."""
    tp = F.col("tp").cast("double")
    return counts.withColumns({"precision": ratio_or_zero(tp, F.col("tp") + F.col("fp")), "recall": ratio_or_zero(tp, F.col("tp") + F.col("fn"))}).withColumn(
        "f1", ratio_or_zero(2 * tp, 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    )


def evaluate(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All metrics of each group of long predictions, in one aggregation: errors, confusion, rates and counts of bursts."""
    out = detection(predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in (regression() | confusion()).items()]))
    n = F.col("n").cast("double")
    return out.withColumns({"actual_bursts": F.col("tp") + F.col("fn"), "predicted_bursts": F.col("tp") + F.col("fp"), "actual_burst_rate": (F.col("tp") + F.col("fn")) / n, "predicted_burst_rate": (F.col("tp") + F.col("fp")) / n})


def score_steps(predictions: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """(keys..., score, tp, n, seen_tp, seen_n, all_tp, step, steps): one row per distinct score, from the highest (step 0), with running sums.

    Equal scores are one step. The running sums go over ranges of scores first and then within each range, so that all
    scores of one model need not pass through one task.
    """
    w = F.lit(1).cast("bigint") if weight is None else weight
    steps = predictions.groupBy(*keys, F.col("y_pred").alias("score")).agg(F.sum(F.when(F.col("actual_burst"), w).otherwise(0)).alias("tp"), F.sum(w).alias("n")).withColumn("range", bucket_of(F.col("score")))
    whole, down = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("range"))
    ranges = steps.groupBy(*keys, "range").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    ranges = ranges.select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("range").alias("__range"), F.sum("tp").over(whole).alias("all_tp"), F.sum("k").over(whole).alias("steps"),
        *[(F.sum(c).over(down) - F.col(c)).alias(f"__above_{c}") for c in ("tp", "n", "k")],
    )
    same = F.col("range") == F.col("__range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    by = Window.partitionBy(*keys, "range").orderBy(F.desc("score"))
    own = steps.withColumns({"seen_tp": F.sum("tp").over(by), "seen_n": F.sum("n").over(by), "step": F.row_number().over(by) - 1})
    return own.join(ranges, same).select(
        *keys, "score", "tp", "n", (F.col("seen_tp") + F.col("__above_tp")).alias("seen_tp"), (F.col("seen_n") + F.col("__above_n")).alias("seen_n"), "all_tp", (F.col("step") + F.col("__above_k")).alias("step"), "steps"
    )


def average_precision(predictions: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """(keys..., average_precision, defined): precision weighted by the recall each score adds; 0 and false without positives."""
    steps = score_steps(predictions, keys, weight)
    part = F.col("tp").cast("double") * F.col("seen_tp") / F.nullif(F.col("seen_n"), F.lit(0).cast("bigint"))
    return steps.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(part), F.max("all_tp")), F.lit(0.0)).alias("average_precision"), (F.max("all_tp") > 0).alias("defined"))


def pr_curve(predictions: DataFrame, keys: Sequence[str], points: int = 500) -> DataFrame:
    """(keys..., score, precision, recall) at every distinct score, thinned to at most `points` evenly spaced steps per group."""
    # A step stays if it is the first of its share of the group's steps, or the last of all.
    share = lambda i: F.floor(i * (points - 1) / F.greatest(F.col("steps") - 1, F.lit(1)))
    step = F.col("step")
    kept = score_steps(predictions, keys).where((F.col("steps") <= points) | (step == 0) | (step == F.col("steps") - 1) | (share(step) != share(step - 1)))
    return kept.select(*keys, "score", (F.col("seen_tp").cast("double") / F.col("seen_n")).alias("precision"), ratio_or_zero(F.col("seen_tp").cast("double"), F.col("all_tp")).alias("recall"))


def improvement(metrics: DataFrame, keys: Sequence[str], value: str = "mae", base: str = "seasonal_naive") -> DataFrame:
    """Adds improvement_percent of `value` against the base model of the same keys, and whether it is better."""
    ref = metrics.where(F.col("model") == base).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(value).alias("__base"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = metrics.join(ref, same, "left")
    return out.withColumns({"improvement": F.col("__base") - F.col(value), "improvement_percent": F.lit(100.0) * F.try_divide(F.col("__base") - F.col(value), F.col("__base")), "better": F.col(value) < F.col("__base")}).drop("__base", *[f"__{k}" for k in keys])


def order_key(c: Column, order: Sequence) -> Column:
    """Position of a value in a report order, those not in it last."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(c == v, F.lit(i)).otherwise(out)
    return out


def coverage_gates(predictions: DataFrame, key: str, models: Sequence[str]) -> DataFrame:
    """(gate, violations): each model once per key, timestamp and horizon, one actual value among them, labels equal over horizons."""
    at = predictions.groupBy(key, "timestamp", "horizon").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("model").alias("models"), F.count_distinct("y_true").alias("actuals"))
    labels = predictions.groupBy(key, "timestamp").agg((F.min("actual_burst") != F.max("actual_burst")).alias("differ"))
    first = at.agg(F.count_if(F.col("n") != F.col("models")).alias("unique"), F.count_if(F.col("models") != len(models)).alias("coverage"), F.count_if(F.col("actuals") != 1).alias("one_actual")).unpivot([], ["unique", "coverage", "one_actual"], "gate", "violations")
    return first.unionByName(labels.agg(F.count_if("differ").alias("violations")).select(F.lit("labels").alias("gate"), "violations"))


def alignment_audit(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per source of predictions: rows, extent, distinct times, nulls, disagreement of stored and recomputed bursts."""
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
        F.count_distinct("timestamp").alias("distinct_times"),
        F.count_if(F.col("y_pred").isNull()).alias("null_predictions"),
        F.count_if(F.col("y_pred") < 0).alias("negative_predictions"),
        F.count_if(F.col("predicted_burst") != (F.col("y_pred") >= F.col("threshold"))).alias("burst_disagreements"),
    )


def error_analysis(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: mean, median and P95 of loads and errors, zeros and bias in valid and test, and the change of the mean from valid to test in percent."""
    e = F.abs(F.col("y_pred") - F.col("y_true"))

    def part(s: str) -> list[Column]:
        at = lambda c: F.when(F.col("split") == s, c)
        return [
            F.avg(at(F.col("y_true"))).alias(f"{s}_mean"), F.median(at(F.col("y_true"))).alias(f"{s}_median"), F.percentile(at(F.col("y_true")), 0.95).alias(f"{s}_p95"),
            F.count_if((F.col("split") == s) & (F.col("y_true") == 0)).alias(f"{s}_zeros"), F.avg(at(e)).alias(f"{s}_mae"), F.avg(at(F.col("y_pred") - F.col("y_true"))).alias(f"{s}_bias"),
        ]

    out = predictions.groupBy(*keys).agg(*part("valid"), *part("test"))
    return out.withColumn("mean_change_percent", F.lit(100.0) * F.try_divide(F.col("test_mean") - F.col("valid_mean"), F.col("valid_mean")))


def diagnostics(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: rows, distinct predictions, whether constant, negative ones, least and greatest."""
    out = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y_pred").alias("distinct_predictions"), F.count_if(F.col("y_pred") < 0).alias("negative"), F.min("y_pred").alias("least"), F.max("y_pred").alias("greatest"))
    return out.withColumn("constant", F.col("distinct_predictions") <= 1)


def normalized_confusion(metrics: DataFrame) -> DataFrame:
    """Adds shares of each row of the confusion matrix; 0 for an empty row."""
    p, n = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    share = lambda c, of: ratio_or_zero(F.col(c).cast("double"), of)
    return metrics.withColumns({"tp_share": share("tp", p), "fn_share": share("fn", p), "fp_share": share("fp", n), "tn_share": share("tn", n)})


def ranked(table: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds the rank within the keys and whether it is the first; `order` must be total for a set result."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return table.withColumn(name, F.row_number().over(by).cast("bigint")).withColumn("selected", F.col(name) == 1)


def generalization_gap(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., always_above, best_epoch) of a training history (epoch, train_loss, valid_loss); of equal losses the first epoch."""
    return history.groupBy(*keys).agg(F.bool_and(F.col("valid_loss") > F.col("train_loss")).alias("always_above"), F.min_by("epoch", F.struct("valid_loss", "epoch")).alias("best_epoch"))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that raises where a key repeats on either side."""
    def once(df: DataFrame) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        return df.withColumn("__n", F.when(n > 1, F.raise_error("repeated join key").cast("bigint")).otherwise(n)).where(F.col("__n") == 1).drop("__n")

    return once(left).join(once(right), list(keys))


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with all rows of the keys in `rows` replaced by `rows`."""
    taken = rows.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return table.join(taken, same, "left_anti").unionByName(rows, allowMissingColumns=True)
