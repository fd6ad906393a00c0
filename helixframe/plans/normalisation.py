"""Queries of ranks, scaling and batch correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normalisation as N
from .base import query


def _by_gene(df):
    return df.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"), F.round(F.max("value"), 4).alias("max"))


BY_GENE = "SELECT gene, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(max(value), 4) AS max FROM out GROUP BY 1"


@query("p10_log_normalise", f"WITH out AS (SELECT gene, log2(value + 1) AS value FROM assay) {BY_GENE}")
def p10(v):
    return _by_gene(N.log_normalise(v.assay))


@query("w1_quantile_normalise", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY value, sample_id) AS i, rank() OVER (PARTITION BY gene ORDER BY value) AS r FROM assay), q AS (SELECT i, avg(value) AS q FROM r GROUP BY 1), out AS (SELECT gene, q AS value FROM r JOIN q ON r.r = q.i) {BY_GENE}")
def w1(v):
    return _by_gene(N.quantile_normalise(v.assay))


W2 = "c AS (SELECT gene FROM assay_a INTERSECT SELECT gene FROM assay_r), ref AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY value, sample_id) - 1 AS i FROM assay_r WHERE gene IN (SELECT gene FROM c)), q AS (SELECT i, avg(value) AS q FROM ref GROUP BY 1), src AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) - 1 AS r FROM assay_a WHERE gene IN (SELECT gene FROM c))"


@query("w2_quantile_to_reference", f"WITH {W2}, out AS (SELECT gene, q AS value FROM src JOIN q ON least(src.r, (SELECT max(i) FROM ref)) = q.i) {BY_GENE}")
def w2(v):
    return _by_gene(N.quantile_normalise_to(v.assay_a, v.assay_r))


COMBAT = "g AS (SELECT gene, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS s FROM b GROUP BY 1), z AS (SELECT b.*, m, s, (value - m) / s AS z FROM b JOIN g USING (gene)), e AS (SELECT gene, batch, avg(z) AS gh, CASE WHEN var_pop(z) = 0 THEN 1 ELSE var_pop(z) END AS d, count(*) AS n FROM z GROUP BY 1, 2), p AS (SELECT batch, avg(gh) AS gb, var_pop(gh) AS t FROM e GROUP BY 1), f AS (SELECT gene, e.batch, d, CASE WHEN t > 0 THEN (t * gh + gb / n) / (t + 1.0 / n) ELSE gh END AS star FROM e JOIN p USING (batch)), out AS (SELECT z.gene, (z - star) / sqrt(d) * s + m AS value FROM z JOIN f ON z.gene = f.gene AND z.batch = f.batch)"


@query("w3_combat", f"WITH b AS (SELECT *, 'A' AS batch FROM assay_a UNION ALL SELECT *, 'R' FROM assay_r), {COMBAT} {BY_GENE}")
def w3(v):
    return _by_gene(N.combat(v.assay_a.withColumn("batch", F.lit("A")).unionByName(v.assay_r.withColumn("batch", F.lit("R")))))


ALIGN = "m1 AS (SELECT gene, avg(value) AS m1, stddev_samp(value) AS s1 FROM assay_a GROUP BY 1), m2 AS (SELECT gene, avg(value) AS m2, stddev_samp(value) AS s2 FROM assay_r GROUP BY 1), r AS (SELECT gene, s1 / (CASE WHEN s2 = 0 THEN 1 ELSE s2 END) AS std_ratio, abs(rank() OVER (ORDER BY m1) + (count(*) OVER (PARTITION BY m1) - 1) / 2.0 - rank() OVER (ORDER BY m2) - (count(*) OVER (PARTITION BY m2) - 1) / 2.0) AS rank_difference FROM m1 JOIN m2 USING (gene)), al AS (SELECT gene, rank_difference, std_ratio FROM r WHERE std_ratio >= 0.2 AND std_ratio <= 5 ORDER BY rank_difference, gene LIMIT 25)"


@query("w4_align_features", f"WITH {ALIGN} SELECT gene, CAST(rank_difference AS DOUBLE) AS rank_difference, round(std_ratio, 5) AS std_ratio FROM al")
def w4(v):
    return N.align_features(v.assay_a, v.assay_r, 25).select("gene", "rank_difference", F.round("std_ratio", 5).alias("std_ratio"))


@query("w5_adapt", f"WITH {ALIGN}, ref AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY value, sample_id) - 1 AS i FROM assay_r WHERE gene IN (SELECT gene FROM al)), q AS (SELECT i, avg(value) AS q FROM ref GROUP BY 1), src AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) - 1 AS r FROM assay_a WHERE gene IN (SELECT gene FROM al)), b AS (SELECT sample_id, gene, q AS value, 'source' AS batch FROM src JOIN q ON least(src.r, (SELECT max(i) FROM ref)) = q.i UNION ALL SELECT sample_id, gene, value, 'reference' FROM ref), {COMBAT} {BY_GENE}")
def w5(v):
    return _by_gene(N.adapt(v.assay_a, v.assay_r, 25))


@query("w6_standard_scale", f"WITH g AS (SELECT gene, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS s FROM assay GROUP BY 1), out AS (SELECT gene, (value - m) / s + 5 AS value FROM assay JOIN g USING (gene)) {BY_GENE}")
def w6(v):
    return _by_gene(N.standard_scale(v.assay).withColumn("value", F.col("value") + 5))


@query("w7_quantile_cut", "WITH e AS (SELECT quantile_cont(expr, 0.25) AS a, quantile_cont(expr, 0.5) AS b, quantile_cont(expr, 0.75) AS c FROM clinical) SELECT CASE WHEN expr <= a THEN 0 WHEN expr <= b THEN 1 WHEN expr <= c THEN 2 ELSE 3 END AS bin, count(*) AS n, round(max(expr), 2) AS top FROM clinical, e GROUP BY 1")
def w7(v):
    return N.quantile_cut(v.clinical, "expr", 4).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("expr"), 2).alias("top"))
