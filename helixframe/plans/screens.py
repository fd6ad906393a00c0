"""Queries of screens and embedding sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as K
from ..operators import screens as S
from .base import query
from .metrics import embeddings

PAIRS = "sy AS (SELECT gene_a AS gene, gene_b AS partner FROM sl_dim UNION SELECT gene_b, gene_a FROM sl_dim), tg AS (SELECT DISTINCT gene_a AS gene FROM sl_dim), a AS (SELECT sample_id, gene AS target, {0} AS x FROM {1} WHERE gene IN (SELECT gene FROM tg)), b AS (SELECT sample_id, gene, {0} AS y FROM {1} WHERE gene NOT IN (SELECT gene FROM tg)), c AS (SELECT target, b.gene, corr(x, y) AS correlation, count(*) AS n FROM a JOIN b ON a.sample_id = b.sample_id GROUP BY 1, 2)"
OUT = "SELECT target, c.gene, round(correlation, 5) AS correlation, n, sy.gene IS NOT NULL AS known_sl FROM c LEFT JOIN sy ON sy.gene = target AND sy.partner = c.gene WHERE n >= 3 AND round(correlation, 9) < -0.2 ORDER BY correlation"


def screen(v, method):
    out = S.lethality_screen(v.assay, v.sl_dim.select(F.col("gene_a").alias("gene")).distinct(), K.symmetric(v.sl_dim), -0.2, method)
    return out.withColumn("correlation", F.round("correlation", 5)).orderBy("correlation", "target", "gene")


@query("j9_m11_spearman_screen", f"WITH rk AS (SELECT sample_id, gene, CAST(rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS DOUBLE) AS r FROM assay), {PAIRS.format('r', 'rk')} {OUT}")
def m11(v):
    return screen(v, "spearman")


@query("m11_t2_pearson_screen", f"WITH {PAIRS.format('value', 'assay')} {OUT}")
def m11b(v):
    return screen(v, "pearson")


#: Two-sided tail of Student's t, by Simpson's rule over the angle whose tangent is t over the root of d.
T_TAIL = "(SELECT 2 * exp(lgamma((d + 1) / 2) - lgamma(d / 2)) / sqrt(pi()) * w / 6000 * sum((CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(sin(w * i / 2000), d - 1)) FROM range(0, 2001) r(i))"


@query("m11_screen_p", f"WITH rk AS (SELECT sample_id, gene, CAST(rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS DOUBLE) AS r FROM assay), {PAIRS.format('r', 'rk')}, tt AS (SELECT target, gene, CAST(n - 2 AS DOUBLE) AS d, pi() / 2 - atan(abs(c) / sqrt(greatest(1 - c * c, 1e-300))) AS w FROM (SELECT target, gene, n, correlation AS c FROM c WHERE n >= 3 AND round(correlation, 9) < -0.2)) SELECT target, gene, round({T_TAIL}, 6) AS p FROM tt")
def m11p(v):
    out = S.lethality_screen(v.assay, v.sl_dim.select(F.col("gene_a").alias("gene")).distinct(), K.symmetric(v.sl_dim), -0.2, with_p=True)
    return out.select("target", "gene", F.round("p", 6).alias("p"))


SUM = "em AS (SELECT concat('G', CAST(label AS VARCHAR)) AS gene, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), di AS (SELECT gene, dim, avg(x) AS e FROM em GROUP BY 1, 2), z AS (SELECT sample_id, dim, sum({0} * CAST(e AS DOUBLE)) AS z FROM assay JOIN di ON assay.gene = di.gene {1} GROUP BY 1, 2), nn AS (SELECT sample_id, sqrt(sum(z * z)) AS n FROM z GROUP BY 1) SELECT z.sample_id, CAST(dim AS INTEGER) AS dim, round(z / CASE WHEN n < 1e-10 THEN 1 ELSE n END, 6) AS z FROM z JOIN nn ON z.sample_id = nn.sample_id"


@query("f14_embedding_sum", f"WITH {SUM.format('value', '')}")
def f14(v):
    return S.embedding_sum(v.assay, embeddings(v)).withColumn("z", F.round("z", 6))


@query("f15_weighted_sum", f"WITH wt AS (SELECT gene, avg(score) + 3 AS weight FROM cna GROUP BY 1), {SUM.format('value * weight', 'JOIN wt ON wt.gene = assay.gene')}")
def f15(v):
    weights = v.cna.groupBy("gene").agg((F.avg("score") + 3).alias("weight"))
    return S.embedding_sum(v.assay, embeddings(v), weights).withColumn("z", F.round("z", 6))
