"""Running totals, ranks and quantiles over a whole table or over large groups, without sorting them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written


def cumulative(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds ``before_c`` and ``all_c`` for each column c: its sum over the rows of the group that come before, and over
    the group.

    Rows are dealt out by ranges of group and order and written once, so that a range is the same for all readers.
    Each range adds up its own rows; one row per range and group gives what the ranges before add.
    """
    by, order = list(by), list(order)
    parts = written(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_s_{c}") for c in columns))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # over ranges, not rows
    earlier = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_part", *(F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in columns), *(F.sum(f"_s_{c}").over(group).alias(f"all_{c}") for c in columns)
    )
    inside = W.partitionBy("_part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = parts.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_b_{c}") for c in columns))
    out = local.join(offsets, [*by, "_part"])
    return out.select(*rows.columns, *((F.col(f"_b_{c}") + F.col(f"_o_{c}")).alias(f"before_{c}") for c in columns), *(f"all_{c}" for c in columns))


def counted(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """A row per distinct value: ``_n`` rows have it, ``before__n`` smaller ones of ``all__n`` come before."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return cumulative(counts, by, [value], ["_n"])


def quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, quantiles): exact linear quantiles, as an array in the order of ``at``; null values don't count."""
    rows = counted(df, value, by)
    v = F.col(value).cast("double")

    def holds(index: Column) -> Column:
        return F.max(F.when((F.col("before__n") <= index) & (index < F.col("before__n") + F.col("_n")), v))

    ends = []
    for q in at:
        place = F.lit(float(q)) * (F.col("all__n") - 1)
        ends.append((holds(F.floor(place)), holds(F.ceil(place)), F.max(place - F.floor(place))))
    return rows.groupBy(*by).agg(F.array(*(lo + (hi - lo) * part for lo, hi, part in ends)).alias("quantiles"))
