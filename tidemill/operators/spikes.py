"""Readings that cannot be right for their source: impossible, spiking or stuck values, and contextual fences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.physical import ROW_BYTES, materialize, sized_join
from tidemill.plans.windows import with_previous

#: Relative width of a sketch bucket; a quantile read from the sketch is off by at most this share.
SKETCH_ERROR = 0.02
#: Magnitudes below this share one bucket on either side of zero.
LEAST = 1e-300
DAY_SECONDS = 86_400
#: What a row of `profiles` takes at most: 25 bounds and five numbers beside its keys.
PROFILE_BYTES = ROW_BYTES + 300


def _shift(error: float) -> int:
    """What is added to the exponent of a magnitude, so that that of LEAST becomes 1."""
    return 1 - math.floor(math.log(LEAST) / math.log1p(error))


def bucket_of(value: Column, error: float = SKETCH_ERROR) -> Column:
    """Signed logarithmic bucket of a number, rising with it: 0 for zero, else by the exponent of |v| to the base 1 + error.

    The exponent is shifted so that it is positive from LEAST on; smaller magnitudes count as LEAST.
    """
    size = F.floor(F.log(F.greatest(F.abs(value).cast("double"), F.lit(LEAST))) / F.lit(math.log1p(error))).cast("bigint") + _shift(error)
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, size).otherwise(-size)


def quantile_sketch(df: DataFrame, keys: list[str], value: str, error: float = SKETCH_ERROR) -> DataFrame:
    """Mergeable sketch: (keys..., bucket, n). Sketches of partitions, hours or days merge by adding n per bucket.

    Counting is partial before the shuffle, so a hot key moves at most one row per bucket and task. Null values are not counted.
    """
    return df.where(F.col(value).isNotNull()).groupBy(*keys, bucket_of(F.col(value), error).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _middle(bucket: Column, error: float) -> Column:
    """The middle of a bucket."""
    at = F.abs(bucket).cast("double") - _shift(error) + 0.5
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * F.exp(at * F.lit(math.log1p(error))))


def _holds(share: float, seen: Column, n: Column, total: Column) -> Column:
    """Whether a bucket, of n values that end at rank `seen`, holds rank ceil(share * total), at least the first."""
    rank = F.greatest(F.ceil(total * F.lit(share)), F.lit(1))
    return (seen >= rank) & (seen - n < rank)


def sketch_rank(sketch: DataFrame, keys: list[str], share: float, name: str, error: float = SKETCH_ERROR) -> DataFrame:
    """The value at rank ceil(share * n), at least the first, of every key, from a sketch, as the middle of its bucket."""
    by = Window.partitionBy(*keys).orderBy("bucket")
    total = F.sum("n").over(Window.partitionBy(*keys))
    seen = F.sum("n").over(by)
    ranked = sketch.withColumns({"__seen": seen, "__total": total}).where(_holds(share, F.col("__seen"), F.col("n"), F.col("__total")))
    return ranked.select(*keys, _middle(F.col("bucket"), error).alias(name))


def source_medians(df: DataFrame, keys: list[str], value: str, spread: list[str], error: float = SKETCH_ERROR) -> DataFrame:
    """The exact median of every key (middle value, or mean of the two middle ones): (keys..., median, n).

    A merged sketch finds the one or two buckets that hold the middle ranks; only the values in them are counted one by
    one, and of those again only distinct values travel, so no key's values are gathered.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, *[c for c in spread if c not in keys], F.col(value).alias("__v"), bucket_of(F.col(value), error).alias("bucket"))
    by = Window.partitionBy(*keys).orderBy("bucket")
    sketch = rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    ranked = sketch.withColumns({"below": F.sum("n").over(by) - F.col("n"), "total": F.sum("n").over(Window.partitionBy(*keys))})
    middle = materialize(ranked.where(_holds_middle()).select(*keys, "bucket", "below", "total"))
    return _medians_of(sized_join(rows, middle, [*keys, "bucket"], spread), keys)


def _holds_middle() -> Column:
    """Whether n values after `below` others hold one of the one or two middle ranks of `total`."""
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda rank: (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
    return holds(low) | holds(high)


def _medians_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., median, n) from the values __v of the middle buckets: (keys..., bucket, below, total, __v)."""
    counts = rows.groupBy(*keys, "bucket", "below", "total", "__v").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys, "bucket").orderBy("__v")
    found = counts.withColumn("below", F.col("below") + F.sum("n").over(order) - F.col("n"))
    return found.where(_holds_middle()).groupBy(*keys).agg(F.avg(F.col("__v").cast("double")).alias("median"), F.max("total").alias("n"))


def stuck_rows(df: DataFrame, source: str, ts: str, row_id: str, fields: list[str], least: int = 12, block_seconds: int = DAY_SECONDS) -> DataFrame:
    """Rows in a run of at least `least` successive rows of their source with the same value other than 0: (source, row_id, field).

    Succession is by (ts, row_id). A source is cut into blocks of `block_seconds`, so that a hot one is many groups;
    runs are found inside the blocks, and only the first and the last run of a block are put together across blocks:
    two rows a block instead of all readings. Nulls break a run and are never stuck. Rows without a timestamp come first.
    Blocks are put in order once; what differs from the readings beside it is left out there, but for the ends of a block.
    """
    block = F.coalesce(F.floor(F.unix_micros(F.col(ts)) / F.lit(block_seconds * 1_000_000)), F.lit(-(2**62))).cast("bigint")
    base = df.select(F.col(source).alias("source"), F.col(ts).alias("ts"), F.col(row_id).alias("row_id"), block.alias("block"), *[F.col(f).alias(f"__v_{f}") for f in fields])
    by = Window.partitionBy("source", "block").orderBy("ts", "row_id")
    placed = base.withColumns(
        {"i": F.row_number().over(by), "last": F.lead(F.lit(1)).over(by).isNull()}
        | {f"__before_{f}": F.lag(f"__v_{f}").over(by) for f in fields}
        | {f"__after_{f}": F.lead(f"__v_{f}").over(by) for f in fields}
    )
    parts, kept = [], F.lit(False)
    for f in fields:
        v = F.col(f"__v_{f}")
        # Zeros are never stuck, so those at an end stand alone.
        starts = F.coalesce((v != F.col(f"__before_{f}")) | (v == 0), F.lit(True))
        beside = F.coalesce((v != 0) & ((v == F.col(f"__before_{f}")) | (v == F.col(f"__after_{f}"))), F.lit(False)) if least > 1 else F.lit(True)
        keep = beside | (F.col("i") == 1) | F.col("last")
        kept = kept | keep
        parts.append(F.struct(F.lit(f).alias("field"), v.alias("value"), starts.alias("starts"), keep.alias("keep")))
    long = placed.where(kept).select("source", "block", "row_id", "i", "last", F.explode(F.array(*parts)).alias("x")).select("source", "block", "row_id", "i", "last", "x.*")
    begun = F.max(F.when(F.col("starts"), F.col("i"))).over(Window.partitionBy("source", "block", "field").orderBy("i"))
    whole = Window.partitionBy("source", "block", "field", "run")
    sized = long.where("keep").withColumn("run", begun).withColumns({"n": F.count(F.lit(1)).over(whole), "at_end": (F.col("run") == 1) | F.max("last").over(whole)})
    sized = sized.where(F.col("at_end") | ((F.col("n") >= least) & (F.col("value") != 0)))
    sized = materialize(sized.select("source", "block", "row_id", "field", "value", "run", "n", "at_end"))
    ends = sized.where("at_end").groupBy("source", "block", "field", "run").agg(F.max("value").alias("value"), F.max("n").alias("n"))
    order = Window.partitionBy("source", "field").orderBy("block", "run")
    goes_on = (F.col("run") == 1) & (F.col("value") == F.lag("value").over(order))
    chains = (
        ends.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
        .withColumn("chain", F.count_if(~F.col("goes_on")).over(order))
        .withColumn("total", F.sum("n").over(Window.partitionBy("source", "field", "chain")))
        .where((F.col("total") >= least) & (F.col("value") != 0))
        .select(*[F.col(c).alias(f"c_{c}") for c in ("source", "block", "field", "run")])
    )
    some = sized.where(F.col("value") != 0)
    same = F.lit(True)
    for c in ("source", "block", "field", "run"):
        same = same & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    return some.join(chains, same, "left").where((F.col("n") >= least) | F.col("c_run").isNotNull()).select("source", "row_id", "field")


def jumps(before: Column, value: Column, jump: float) -> Column:
    """Whether the change between two readings is implausible, the same in both directions; see contextual_flags."""
    a, b = F.abs(before), F.abs(value)
    across = F.signum(before) * F.signum(value) < 0
    return F.when(across, a + b > jump).otherwise(F.greatest(a, b) > jump * F.greatest(F.least(a, b), F.lit(1.0)))


def hour_of(ts: Column) -> Column:
    """Hour of the day, UTC; null without a time."""
    return F.pmod(F.floor(F.unix_micros(ts) / F.lit(3_600_000_000)), F.lit(24)).cast("int")


def fences(sketch: DataFrame, keys: list[str], context: str, fence: float, error: float = SKETCH_ERROR) -> DataFrame:
    """(keys..., context, q1, q3, low, high) from a sketch by keys and context: low and high are `fence` spreads beyond the quartiles."""
    group = [*keys, context]
    q1, q3 = sketch_rank(sketch, group, 0.25, "q1", error), sketch_rank(sketch, group, 0.75, "q3", error)
    same = F.lit(True)
    for k in group:
        same = same & F.col(k).eqNullSafe(F.col(f"__3_{k}"))
    both = q1.join(q3.withColumnsRenamed({k: f"__3_{k}" for k in group}), same).drop(*[f"__3_{k}" for k in group])
    spread = F.col("q3") - F.col("q1")
    return both.withColumns({"low": F.col("q1") - fence * spread, "high": F.col("q3") + fence * spread})


def profiles(sketch: DataFrame, keys: list[str], fence: float, times: float, error: float = SKETCH_ERROR) -> DataFrame:
    """From a sketch by keys and __hour, one row a key: (keys..., __high, __low_bucket, __low_below, __high_bucket, __high_below, __total).

    __high: for the hours 0 to 23 and no hour the bound above which a value is proposed, `fence` spreads beyond the quartiles of
    the hour, and at most the bound below which no value is more than `times` the median of its keys; that bound comes from the
    sketch merged over all hours, lowered by its error, so no such value stays within the fences. The buckets are those of
    the two middle ranks over all hours, each with the number of values below it.

    A key has at most one row a bucket and hour here, however many its readings, so the sketch is shuffled by key, once.
    """
    in_hour = Window.partitionBy(*keys, "__hour").orderBy("bucket")
    in_all = Window.partitionBy(*keys).orderBy("bucket")
    first, here, last = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing
    ranked = (
        sketch.repartition(*keys)
        .withColumns({"__seen": F.sum("n").over(in_hour.rowsBetween(first, here)), "__n": F.sum("n").over(in_hour.rowsBetween(first, last))})
        # Rows of several hours have the same bucket: all of them count at once.
        .withColumns({"__below": F.coalesce(F.sum("n").over(in_all.rangeBetween(first, -1)), F.lit(0)), "__upto": F.sum("n").over(in_all.rangeBetween(first, here)), "__total": F.sum("n").over(in_all.rowsBetween(first, last))})
    )
    q1, q3 = [_holds(share, F.col("__seen"), F.col("n"), F.col("__n")) for share in (0.25, 0.75)]
    low, high = [(F.col("__below") <= rank) & (rank < F.col("__upto")) for rank in (F.floor((F.col("__total") - 1) / 2), F.floor(F.col("__total") / 2))]
    middle = _middle(F.col("bucket"), error)
    of_hour = (
        ranked.where(q1 | q3 | low | high)
        .groupBy(*keys, "__hour")
        .agg(
            F.max(F.when(q1, middle)).alias("q1"),
            F.max(F.when(q3, middle)).alias("q3"),
            *[F.max(F.when(held, F.col(c))).alias(f"__{side}_{name}") for side, held in (("low", low), ("high", high)) for name, c in (("bucket", "bucket"), ("below", "__below"))],
            F.max("__total").alias("__total"),
        )
        .withColumn("high", F.col("q3") + fence * (F.col("q3") - F.col("q1")))
    )
    hours = [F.col("__hour") == h for h in range(24)] + [F.col("__hour").isNull()]
    out = of_hour.groupBy(*keys).agg(
        *[F.max(F.when(at, F.col("high"))).alias(f"__high_{h}") for h, at in enumerate(hours)],
        *[F.max(c).alias(c) for c in ("__low_bucket", "__low_below", "__high_bucket", "__high_below", "__total")],
    )
    m = _middle(F.col("__low_bucket"), error)
    bound = F.lit(times) * (m - F.abs(m) * F.lit(error))
    highs = F.array(*[F.when(F.col(f"__high_{h}").isNotNull(), F.least(F.col(f"__high_{h}"), bound)) for h in range(25)])
    return out.select(*keys, highs.alias("__high"), "__low_bucket", "__low_below", "__high_bucket", "__high_below", "__total")


def spikes(df: DataFrame, keys: list[str], value: str, ts: str, spread: list[str], times: float, fence: float = 3.0, error: float = SKETCH_ERROR) -> DataFrame:
    """Rows of df whose value is more than `times` the median of their keys, as proposed by the fences of their hour and then checked.

    One sketch by keys and hour of the day, counted partially in every task, gives the fences; merged over the hours it
    also gives the buckets of the medians; see profiles for why no spike is missed. One more pass takes the rows
    outside their fence and the values of the middle buckets; the former are held against the exact median, counted from the
    latter. Null values are no spikes; rows without a time are an hour of their own.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("__hour", hour_of(F.col(ts)))
    known = materialize(profiles(quantile_sketch(rows, [*keys, "__hour"], value, error), keys, fence, times, error))
    held = sized_join(rows.withColumn("__bucket", bucket_of(F.col(value), error)), known, keys, spread, row_bytes=PROFILE_BYTES)
    outside = F.coalesce(F.col(value) > F.element_at("__high", F.coalesce(F.col("__hour") + 1, F.lit(25))), F.lit(False))
    low, high = F.col("__bucket") == F.col("__low_bucket"), F.col("__bucket") == F.col("__high_bucket")
    picked = held.withColumns({"__outside": outside, "__middle": low | high}).where(F.col("__outside") | F.col("__middle"))
    # Of a value in the middle only what is counted is written.
    picked = materialize(picked.select(*keys, *[(F.col(c) if c == value else F.when(F.col("__outside"), F.col(c))).alias(c) for c in df.columns if c not in keys], "__outside", "__middle", "__bucket", F.when(low, F.col("__low_below")).otherwise(F.col("__high_below")).alias("__below"), "__total"))
    middle = picked.where("__middle").select(*keys, F.col("__bucket").alias("bucket"), F.col("__below").alias("below"), F.col("__total").alias("total"), F.col(value).alias("__v"))
    medians = materialize(_medians_of(middle, keys).select(*keys, "median"))
    proposed = picked.where("__outside").select(*df.columns)
    return sized_join(proposed, medians, keys, spread).where(F.col(value) > times * F.col("median")).drop("median")


def contextual_flags(df: DataFrame, source: str, ts: str, row_id: str, value: str, fence: float = 3.0, jump: float = 50.0, error: float = SKETCH_ERROR) -> DataFrame:
    """Readings outside their source's habits: (source, row_id, hour, value, q1, q3, outside, jumped).

    Quartiles come from quantile sketches by source and hour of the day, merged over all partitions; `outside` is true
    beyond q1 - fence * (q3 - q1) or q3 + fence * (q3 - q1), `jumped` where one of the reading and the source's reading
    before it (by ts, row_id) is more than `jump` times the other, upward or downward: sizes below 1 count as 1, so beside
    zero the other must be beyond `jump`, and where the sign changes the sizes are added. A first reading never jumps. Sources are cut into days for the order, the last
    reading of a day is carried to the next. Only flagged rows are returned; null values are never flagged.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(source).alias("source"),
        F.col(row_id).alias("row_id"),
        F.unix_micros(F.col(ts)).alias("us"),
        hour_of(F.col(ts)).alias("hour"),
        F.col(value).alias("value"),
    )
    rows = rows.withColumn("day", F.floor(F.col("us") / F.lit(DAY_SECONDS * 1_000_000)).cast("bigint"))
    bounds = materialize(fences(quantile_sketch(rows, ["source", "hour"], "value", error), ["source"], "hour", fence, error=error))
    linked = with_previous(rows, ["source"], "day", ["us", "row_id"], "value", "before")
    flagged = sized_join(linked.select("source", "row_id", "hour", "value", "before"), bounds, ["source", "hour"], ["row_id"]).withColumns(
        {
            "outside": (F.col("value") > F.col("high")) | (F.col("value") < F.col("low")),
            "jumped": F.coalesce(jumps(F.col("before").cast("double"), F.col("value").cast("double"), jump), F.lit(False)),
        }
    )
    return flagged.where(F.col("outside") | F.col("jumped")).select("source", "row_id", "hour", "value", "q1", "q3", "outside", "jumped")


def flag_impossible(rules: dict[str, Column]) -> Column:
    """An array of the fields of a row that hold an impossible value, by rule."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(f)) for f, rule in rules.items()]))
