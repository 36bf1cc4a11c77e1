"""Exact percentiles per group by distributed multi-select, and mergeable sketches with a stated error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.spikes import quantile_sketch, sketch_rank
from tidemill.plans.physical import materialize, sized_join

#: Values a part proposes for each of its open ranges, and so about as many pivots a range has in a round.
PIVOTS = 31
#: Parts that propose: partitions are put together beyond this number, so a range never meets more proposals than PARTS * PIVOTS.
PARTS = 4096
#: Accuracy of a part's local quantiles: a proposal may be off by 1 / ACCURACY of the part's own rows.
ACCURACY = 1000


def _same(keys: Sequence[str], mark: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{mark}{k}"))
    return same


def _pivots(candidates: DataFrame, group: list[str]) -> DataFrame:
    """(group..., pivots): in order, values of the candidates at which the weighted proposals cross a PIVOTS-th of their weight.

    Each part proposes the medians and the quantiles around them of its own candidates, every one weighing as much as
    the part has rows for it. A value that crosses several marks is one pivot; with few different values all are pivots.
    """
    shares = F.array(*[F.lit((k + 0.5) / PIVOTS) for k in range(PIVOTS)])
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS))
    local = candidates.groupBy(*group, part.alias("part")).agg(F.percentile_approx("v", shares, ACCURACY).alias("proposals"), F.count(F.lit(1)).alias("rows"))
    proposed = local.select(*group, F.explode("proposals").alias("v"), "rows")
    by = Window.partitionBy(*group)
    seen = F.sum("rows").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    mark = lambda w: F.floor(w * F.lit(PIVOTS) / F.col("whole"))
    crossing = proposed.withColumns({"whole": F.sum("rows").over(by), "seen": seen}).where(mark(F.col("seen")) > mark(F.col("seen") - F.col("rows")))
    return crossing.groupBy(*group).agg(F.array_sort(F.collect_set("v")).alias("pivots"))  # at most PIVOTS


def _sides(candidates: DataFrame, pivots: DataFrame, group: list[str]) -> DataFrame:
    """The candidates with pivots and side: 2 k + 1 for the k-th pivot itself, 2 k for values between it and the one before."""
    met = sized_join(candidates, pivots, group, ["v"], row_bytes=100 + 8 * PIVOTS)
    # The number of pivots below a value by binary search; beyond the last pivot get() is null.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(PIVOTS.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("pivots", at + step - 1) < F.col("v"), step).otherwise(0))
    side = F.transform(F.array(below), lambda k: 2 * k + F.when(F.get("pivots", k) == F.col("v"), 1).otherwise(0))
    return met.withColumn("side", F.get(side, F.lit(0)))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: Sequence[float], at_rank: bool = False) -> DataFrame:
    """Percentiles, exact: (keys..., share, percentile, n); with linear interpolation, or at_rank: the value at rank ceil(share * n).

    Multi-select over all groups and ranks at once. In each round every part (partition) proposes local quantiles of its
    own candidates per group and open range, their median among them; weighted quantiles of the proposals become the
    pivots; candidates are counted below, at and above every pivot; ranges in which no wanted rank lies are discarded, and
    the others go on until every rank's value has been a pivot. A range shrinks to about 1 / PIVOTS of itself in a round,
    and a value that is repeated more often becomes a pivot at once, so rounds grow with the logarithm to base PIVOTS of
    the largest group. No value is shuffled but proposals: the first round reads the table itself, later ones what is left
    of it, and only counts per pivot leave a task. Values are compared as DOUBLE; null and NaN values are not counted, so
    a group without other values has no row. Null keys form a group.
    """
    v = F.col(value).cast("double")
    candidates = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, F.lit("").alias("range"), v.alias("v"))
    group = [*keys, "range"]
    wanted: DataFrame | None = None
    state: DataFrame | None = None
    found: list[DataFrame] = []
    while True:
        pivots = materialize(_pivots(candidates, group))
        sides = _sides(candidates, pivots, group)
        tally = sides.groupBy(*group, "side").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v"))
        by = Window.partitionBy(*group)
        tally = tally.withColumns({"before": F.sum("n").over(by.orderBy("side")) - F.col("n"), "whole": F.sum("n").over(by)})
        if state is None:
            tally = materialize(tally)
            sizes = tally.where(F.col("before") == 0).select(*keys, F.col("whole").alias("n"))
            wanted = sizes.select(*keys, "n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
            at = F.greatest(F.ceil(F.col("share") * F.col("n")) - 1, F.lit(0).cast("bigint")) if at_rank else F.col("share") * (F.col("n") - 1)
            wanted = wanted.withColumns({"low": F.floor(at), "part": at - F.floor(at)})
            ranks = wanted.select(*keys, F.explode(F.array_distinct(F.array("low", F.when(F.col("part") > 0, F.col("low") + 1).otherwise(F.col("low"))))).alias("rank")).distinct()
            # An open rank: its place among the candidates of its range.
            state = ranks.select(*keys, "rank", F.lit("").alias("range"), F.col("rank").alias("place"))
        counts = tally.withColumnsRenamed({k: f"c_{k}" for k in group})
        inside = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))
        met = state.join(counts, _same(group, "c_") & inside)
        judged = materialize(met.select(*keys, "rank", "range", "side", "v", (F.col("place") - F.col("before")).alias("place")))
        at_pivot = F.col("side") % 2 == 1
        found.append(judged.where(at_pivot).select(*keys, "rank", F.col("v").alias("value")))
        rest = judged.where(~at_pivot)
        open_ = rest.count()
        if not open_:
            break
        narrower = F.concat_ws(".", "range", F.col("side").cast("string"))
        state = rest.select(*keys, "rank", narrower.alias("range"), "place")
        held = rest.select(*group, "side").distinct()
        candidates = materialize(sized_join(sides.drop("pivots"), held, [*group, "side"], ["v"], "left_semi", rows=open_).select(*keys, narrower.alias("range"), "v"))
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    values = values.withColumnsRenamed({k: f"v_{k}" for k in keys})
    both = wanted.join(values, _same(keys, "v_") & ((F.col("rank") == F.col("low")) | ((F.col("rank") == F.col("low") + 1) & (F.col("part") > 0))))
    out = both.groupBy(*keys, "share", "n", "part").agg(F.min_by("value", "rank").alias("a"), F.max_by("value", "rank").alias("b"))
    between = F.when((F.col("part") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return out.select(*keys, "share", between.alias("percentile"), "n")


def daily_sketches(df: DataFrame, keys: list[str], ts: str, value: str, error: float) -> DataFrame:
    """One mergeable sketch per key and day: (keys..., day_no, bucket, n); see quantile_sketch."""
    day = F.floor(F.unix_micros(F.col(ts)) / F.lit(86_400_000_000)).cast("bigint")
    return quantile_sketch(df.withColumn("day_no", day), [*keys, "day_no"], value, error)


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of any parts (partitions, days) put together into one per key."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def sketch_percentiles(sketch: DataFrame, keys: list[str], shares: Sequence[float], error: float) -> DataFrame:
    """Percentiles from a sketch, each within the relative `error` of the value at its rank: (keys..., share, percentile)."""
    parts = [sketch_rank(sketch, keys, s, "percentile", error).withColumn("share", F.lit(float(s))) for s in shares]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
