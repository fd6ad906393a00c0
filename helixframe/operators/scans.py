"""Recurrences along long sequences as associative scans: maps are composed inside ranges of rows, then over ranges.

No task holds a whole subject or episode: a range gives one row per sequence that it touches (or one per segment of a
sequence), and only these rows are put in order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Powers of the discount stay above this inside a segment, and count as nothing below the other bound.
SMALLEST, NOTHING = 1e-30, 1e-320


def ranged(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows dealt out by ranges of key and order and written once, with the number of their range in ``_part``."""
    return written(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def carried(rows: DataFrame, by: Sequence[str], order: Sequence[str], column: str, out: str) -> DataFrame:
    """Adds ``out``: the last value of ``column`` that isn't null, at or before each row of its sequence.

    A row maps the state to itself (null) or to a constant; such maps compose to the last constant.
    """
    by, order = list(by), list(order)
    parts = ranged(rows, by, order)
    place = F.struct(*order)
    ends = parts.where(F.col(column).isNotNull()).groupBy(*by, "_part").agg(F.max_by(column, place).alias("_last"))
    every = parts.select(*by, "_part").distinct().join(ends, [*by, "_part"], "left")
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    starts = every.select(*by, "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_start"))
    inside = W.partitionBy("_part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    told = parts.withColumn(out, F.last(column, ignorenulls=True).over(inside)).join(starts, [*by, "_part"])
    return told.select(*rows.columns, F.coalesce(out, "_start").alias(out))


def previous(rows: DataFrame, by: Sequence[str], order: Sequence[str], column: str, out: str) -> DataFrame:
    """Adds ``out``: the value of ``column`` one row before, inside its sequence; null at its start."""
    by, order = list(by), list(order)
    parts = ranged(rows, by, order)
    ends = parts.groupBy(*by, "_part").agg(F.max_by(column, F.struct(*order)).alias("_end"))
    starts = ends.select(*by, "_part", F.lag("_end").over(W.partitionBy(*by).orderBy("_part")).alias("_start"))  # a row per range
    inside = W.partitionBy("_part", *by).orderBy(*order)
    told = parts.withColumns({out: F.lag(column).over(inside), "_first": F.row_number().over(inside) == 1}).join(starts, [*by, "_part"])
    return told.select(*rows.columns, F.when(F.col("_first"), F.col("_start")).otherwise(F.col(out)).alias(out))


def discounted(rows: DataFrame, gamma: float, by: Sequence[str], step: str, reward: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of later rewards (own one included), each times gamma to the power of its steps ahead.

    A row maps the value behind it to reward + gamma^gap x value.  Inside a segment - so many steps that powers of gamma
    stay far from the smallest number - these affine maps compose to suffix sums of rewards times powers; a segment's
    map is its value at its first step, and segments ahead are added with their own powers until these are nothing.
    ``step`` is a whole number and grows along a sequence; gaps count as steps without a reward.
    """
    if not 0 <= gamma <= 1:
        raise ValueError("the discount is between 0 and 1")
    if gamma == 0:
        return rows.withColumn(out, F.col(reward).cast("double"))
    by = list(by)
    length = math.floor(math.log(SMALLEST) / math.log(gamma)) if gamma < 1 else None
    reach = math.ceil(math.log(NOTHING) / math.log(gamma)) if gamma < 1 else None
    parts = ranged(rows, by, [step])
    # The range's first step is where segments are counted from.
    base = parts.groupBy(*by, "_part").agg(F.min(step).alias("_base"))
    told = parts.join(base, [*by, "_part"])
    told = told.withColumn("_segment", F.floor((F.col(step) - F.col("_base")) / length) if length else F.lit(0))
    power = lambda steps: F.pow(F.lit(float(gamma)), steps)
    start = F.col("_base") + F.col("_segment") * (length or 0)
    told = told.withColumn("_start", start).withColumn("_weight", power(F.col(step) - F.col("_start")))
    key = [*by, "_part", "_segment"]
    segments = told.groupBy(*key, "_start").agg(F.sum(F.col(reward) * F.col("_weight")).alias("_value"))
    ahead = W.partitionBy(*by).orderBy("_start")  # a row per segment
    ahead = ahead.rangeBetween(1, reach) if reach else ahead.rowsBetween(1, W.unboundedFollowing)
    if gamma == 1:
        behind = F.coalesce(F.sum("_value").over(ahead), F.lit(0.0))
        segments = segments.withColumn("_behind", behind)
    else:
        segments = segments.withColumn("_ahead", F.collect_list(F.struct(F.col("_start").alias("s"), F.col("_value").alias("v"))).over(ahead))
        total = F.aggregate("_ahead", F.lit(0.0), lambda sum_, x: sum_ + x["v"] * power(x["s"] - F.col("_start")))
        segments = segments.withColumn("_behind", total).drop("_ahead")
    suffix = W.partitionBy(*key).orderBy(step).rowsBetween(0, W.unboundedFollowing)
    summed = told.withColumn("_own", F.sum(F.col(reward) * F.col("_weight")).over(suffix))
    joined = summed.join(segments.select(*key, "_behind"), key)
    return joined.select(*rows.columns, ((F.col("_own") + F.col("_behind")) / F.col("_weight")).alias(out))


def stepped_means(values: DataFrame, value: str, at: DataFrame | None = None) -> DataFrame:
    """(_i, _q): the mean, over groups, of the values with index ``_i`` in their group, at each index where it may change
    and at the indices ``_i`` of ``at``.

    ``values`` has a row per group and distinct value, with ``_n`` copies from index ``before__n`` on: an interval of
    indices.  A sweep adds the value at the interval's start and takes it away behind its end; sums run by ranges.  So
    a value with any number of copies is two rows.
    """
    from .ranks import cumulative

    v = F.col(value).cast("double")
    begins = values.select(F.col("before__n").alias("_i"), v.alias("_v"), F.lit(1).alias("_c"))
    ends = values.select((F.col("before__n") + F.col("_n")).alias("_i"), (-v).alias("_v"), F.lit(-1).alias("_c"))
    events = begins.unionByName(ends)
    if at is not None:
        events = events.unionByName(at.select("_i", F.lit(0.0).alias("_v"), F.lit(0).alias("_c")))
    jumps = events.groupBy("_i").agg(F.sum("_v").alias("_v"), F.sum("_c").alias("_c"))
    swept = cumulative(jumps, [], ["_i"], ["_v", "_c"])
    count = F.col("before__c") + F.col("_c")
    return swept.where(count > 0).select("_i", ((F.col("before__v") + F.col("_v")) / count).alias("_q"))
