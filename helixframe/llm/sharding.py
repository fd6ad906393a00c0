"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import unclaimed

#: Hex digits of the hash that parts a shard into sub-groups (16 for each digit), so that no task sorts a whole shard.
BUCKET_DIGITS = 3


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that only key and shard decide: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard (index into ``weights``) with the highest weighted score -w / ln(u) for this key.

    A shard with twice the weight gets twice the keys.  Adding a shard moves only the keys that the new shard wins;
    removing one moves only its own.  A null key counts as the empty key.  A shard of weight 0 gets nothing.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("some shard must have a positive weight")
    key = F.coalesce(key.cast("string"), F.lit(""))
    even = len({w for w in weights}) == 1
    # With equal weights the highest draw wins, and no logarithm is needed.
    score = (lambda s, w: _draw(key, s)) if even else (lambda s, w: F.lit(-float(w)) / F.log(_draw(key, s)))
    each = [F.struct(score(s, w).alias("score"), F.lit(-s).alias("low")) for s, w in enumerate(weights) if w > 0]
    best = each[0] if len(each) == 1 else F.greatest(*each)
    return (-best["low"]).cast("int")


def assign_shards(
    df: DataFrame,
    key: str = "doc_id",
    weights: Sequence[float] = (1.0,) * 24,
    shard: str = "shard",
    slot: str = "slot",
    ties: Sequence[str] = (),
) -> DataFrame:
    """Adds the shard of each row and a slot: 0, 1, 2... without gaps within the shard.

    Rows are numbered inside (shard, bucket) groups, in the order of key and ``ties``; a bucket is a hash of these
    columns, so rows of one key are spread over buckets where ``ties`` differ.  A table of shards x 4096 counts, whose
    size doesn't depend on the data, gives the offsets.  Rows that agree in key and ties can't be told apart: they have
    neighbouring slots, in no order.  A null key counts as the empty one; long texts aren't read; an empty table gives
    an empty one.  Input columns called like the new ones are replaced; all others stay, whatever their names.
    """
    from pyspark.sql import Window as W

    bucket, n, first, place = unclaimed([*df.columns, shard, slot], "bucket", "n", "from", "place")
    order = [F.col(key), *map(F.col, ties)]
    placed = df.drop(shard, slot).withColumn(shard, rendezvous_shard(F.col(key), weights))
    told = F.concat_ws("|", *(c.cast("string") for c in order))
    placed = placed.withColumn(bucket, F.substring(F.md5(told.cast("binary")), 1, BUCKET_DIGITS))
    counts = placed.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias(n))
    before = W.partitionBy(shard).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(shard, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    inside = W.partitionBy(shard, bucket).orderBy(*order)
    numbered = placed.withColumn(place, F.row_number().over(inside) - 1)
    # At most len(weights) * 4096 rows: safe to broadcast at any data size.
    return (
        numbered.join(F.broadcast(offsets), [shard, bucket])
        .withColumn(slot, (F.col(first) + F.col(place)).cast("long"))
        .drop(bucket, first, place)
    )
