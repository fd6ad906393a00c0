"""Ranks, scaling, quantile normalisation and batch correction of long (sample, gene, value) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranks import counted, quantiles
from .scans import stepped_means


def average_rank(df: DataFrame, value: str, by: list[str], out: str = "rank") -> DataFrame:
    """Average rank of ``value`` within ``by``: equal values are counted first, and counts are added up by ranges.

    Rows are written once, as ranks come back by value: a mean computed anew may differ in its last bit and be lost.
    """
    df = written(df, "unranked")
    ranks = counted(df, value, by).select(*by, value, (F.col("before__n") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value])


def log_normalise(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.log2(F.col(value) + 1))


def standard_scale(assay: DataFrame) -> DataFrame:
    """Population standard deviation; a gene without spread is only centred."""
    moments = assay.groupBy("gene").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return assay.join(moments, "gene").withColumn("value", (F.col("value") - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")


def quantile_normalise(assay: DataFrame) -> DataFrame:
    """Each value becomes the mean, over genes, of the values with its (smallest) rank in its gene."""
    assay = written(assay, "assay")  # means come back by value, so they are computed once
    values = counted(assay, "value", ["gene"])
    told = values.select("gene", "value", F.col("before__n").alias("_i")).join(stepped_means(values, "value"), "_i")
    return assay.join(told, ["gene", "value"]).select("sample_id", "gene", F.col("_q").alias("value"))


def quantile_normalise_to(source: DataFrame, reference: DataFrame) -> DataFrame:
    """Source values take the reference's quantile of their rank; over genes that both have."""
    common = source.select("gene").distinct().join(reference.select("gene").distinct(), "gene")
    values = counted(reference.join(common, "gene", "left_semi"), "value", ["gene"])
    size = values.agg((F.max("all__n") - 1).alias("_last"))
    own = written(source.join(common, "gene", "left_semi"), "own")  # as above
    ranked = written(counted(own, "value", ["gene"]).join(F.broadcast(size)).select("gene", "value", F.least("before__n", "_last").alias("_i")), "ranks")
    means = stepped_means(values, "value", ranked)
    return own.join(ranked.join(means, "_i"), ["gene", "value"]).select("sample_id", "gene", F.col("_q").alias("value"))


def combat(rows: DataFrame, batch: str = "batch", parametric: bool = True) -> DataFrame:
    """Batch correction of (sample_id, gene, value, batch): location shrunk towards its mean over genes, scale not.

    With one batch the values stay.  A row without a batch, or a sample in two batches, is an error: batch labels then
    don't fit the rows.
    """
    known = F.when(F.col(batch).isNull(), F.raise_error(F.lit("each row needs a batch"))).otherwise(F.col(batch))
    rows = rows.withColumn(batch, known)
    gene = rows.groupBy("gene").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s")).withColumn("_s", F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s")))
    z = rows.join(gene, "gene").withColumn("_z", (F.col("value") - F.col("_m")) / F.col("_s"))
    cell = z.groupBy("gene", batch).agg(F.avg("_z").alias("_g"), F.var_pop("_z").alias("_d"), F.count(F.lit(1)).alias("_n"))
    cell = cell.withColumn("_d", F.when(F.col("_d") == 0, 1.0).otherwise(F.col("_d")))
    prior = cell.groupBy(batch).agg(F.avg("_g").alias("_gb"), F.var_pop("_g").alias("_t"))
    shrunk = (F.col("_t") * F.col("_g") + F.col("_gb") / F.col("_n")) / (F.col("_t") + 1 / F.col("_n"))
    star = F.when(F.col("_t") > 0, shrunk).otherwise(F.col("_g")) if parametric else F.col("_g")
    effect = cell.join(F.broadcast(prior), batch).select("gene", batch, star.alias("_star"), "_d")
    one = rows.agg((F.count_distinct(batch) < 2).alias("_one"))
    fixed = (F.col("_z") - F.col("_star")) / F.sqrt("_d") * F.col("_s") + F.col("_m")
    return z.join(effect, ["gene", batch]).join(F.broadcast(one)).select("sample_id", "gene", batch, F.when(F.col("_one"), F.col("value")).otherwise(fixed).alias("value"))


def align_features(source: DataFrame, reference: DataFrame, k: int = 500) -> DataFrame:
    """Genes whose rank of means agrees best, among those with comparable spread: (gene, rank_difference, std_ratio)."""

    def moments(df: DataFrame, s: str) -> DataFrame:
        m = df.groupBy("gene").agg(F.avg("value").alias(f"m{s}"), F.stddev_samp("value").alias(f"s{s}"))
        return m

    both = moments(source, "1").join(moments(reference, "2"), "gene").withColumn("_all", F.lit(1))
    ranked = average_rank(average_rank(both, "m1", ["_all"], "r1"), "m2", ["_all"], "r2")
    ratio = F.col("s1") / F.when(F.col("s2") == 0, 1.0).otherwise(F.col("s2"))
    out = ranked.select("gene", F.abs(F.col("r1") - F.col("r2")).alias("rank_difference"), ratio.alias("std_ratio"))
    return out.where("std_ratio >= 0.2 AND std_ratio <= 5").orderBy("rank_difference", "gene").limit(k)


def adapt(source: DataFrame, reference: DataFrame, k: int = 500) -> DataFrame:
    """Alignment, quantile normalisation to the reference, then batch correction; unchanged if no gene aligns."""
    genes = [r["gene"] for r in align_features(source, reference, k).select("gene").collect()]  # k at most
    if not genes:
        return source.withColumn("batch", F.lit("source")).unionByName(reference.withColumn("batch", F.lit("reference")))
    s, r = source.where(F.col("gene").isin(genes)), reference.where(F.col("gene").isin(genes))
    both = quantile_normalise_to(s, r).withColumn("batch", F.lit("source")).unionByName(r.select("sample_id", "gene", "value").withColumn("batch", F.lit("reference")))
    return combat(both)


def quantile_cut(df: DataFrame, value: str, q: int, by: list[str] | None = None, out: str = "bin", duplicates: str = "raise") -> DataFrame:
    """Bins by linear quantiles, right-closed, the lowest included.  Equal edges: an error, or dropped."""
    keys = by or []
    edges = quantiles(df, value, [i / q for i in range(q + 1)], keys).withColumnRenamed("quantiles", "_e")
    distinct = F.array_distinct("_e")
    if duplicates == "raise":
        distinct = F.when(F.size(distinct) < q + 1, F.raise_error(F.lit("bin edges must be unique"))).otherwise(F.col("_e"))
    edges = edges.withColumn("_e", distinct)
    joined = df.join(edges, keys) if keys else df.join(F.broadcast(edges))
    below = F.size(F.filter("_e", lambda e: e < F.col(value)))
    return joined.withColumn(out, F.greatest(below - 1, F.lit(0))).drop("_e")
