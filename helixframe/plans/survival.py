"""Queries of survival analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import survival as S
from .base import query

ARMS = "arms AS (SELECT *, CASE WHEN expr <= (SELECT median(expr) FROM clinical) THEN 'low' ELSE 'high' END AS arm FROM clinical)"
CURVE = f"{ARMS}, c AS (SELECT arm, time, sum(event) AS n_events, count(*) AS k FROM arms GROUP BY 1, 2), r AS (SELECT *, sum(k) OVER (PARTITION BY arm ORDER BY time DESC) AS n_at_risk FROM c), s AS (SELECT arm, time, n_at_risk, n_events, CASE WHEN max(CASE WHEN n_events >= n_at_risk THEN 1 ELSE 0 END) OVER (PARTITION BY arm ORDER BY time) = 1 THEN 0.0 ELSE exp(sum(CASE WHEN n_events < n_at_risk THEN ln(1 - CAST(n_events AS DOUBLE) / n_at_risk) ELSE 0 END) OVER (PARTITION BY arm ORDER BY time)) END AS survival FROM r)"


@query("w7a_split_arms", f"WITH {ARMS} SELECT arm, count(*) AS n, sum(event) AS events FROM arms GROUP BY 1")
def w7a(v):
    return S.split_arms(v.clinical, "expr").groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"))


@query("w8_kaplan_meier", f"WITH {CURVE} SELECT arm, round(time, 4) AS time, CAST(n_at_risk AS BIGINT) AS n_at_risk, CAST(n_events AS BIGINT) AS n_events, round(CAST(survival AS DOUBLE), 6) AS survival FROM s")
def w8(v):
    return S.kaplan_meier(S.split_arms(v.clinical, "expr")).select("arm", F.round("time", 4).alias("time"), "n_at_risk", "n_events", F.round("survival", 6).alias("survival"))


@query("w9_median_survival", f"WITH {CURVE} SELECT arm, round(coalesce(min(CASE WHEN survival <= 0.5 + 1e-12 THEN time END), CAST('inf' AS DOUBLE)), 4) AS median FROM s GROUP BY 1")
def w9(v):
    return S.median_survival(S.kaplan_meier(S.split_arms(v.clinical, "expr"))).select("arm", F.round("median", 4).alias("median"))


LOG_RANK = f"WITH {ARMS}, c AS (SELECT time, count(*) AS n, count(*) FILTER (arm = 'low') AS n1, sum(event) AS d, sum(CASE WHEN arm = 'low' THEN event ELSE 0 END) AS d1 FROM arms GROUP BY 1), r AS (SELECT d, d1, CAST(sum(n) OVER (ORDER BY time DESC) AS DOUBLE) AS n, CAST(sum(n1) OVER (ORDER BY time DESC) AS DOUBLE) AS n1 FROM c), t AS (SELECT sum(d1) AS observed, sum(d * n1 / n) AS expected, sum(CASE WHEN n > 1 THEN d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS variance FROM r WHERE d > 0)"


@query("w10_log_rank", f"{LOG_RANK} SELECT CAST(observed AS BIGINT) AS observed, round(expected, 4) AS expected, round(variance, 4) AS variance, round((observed - expected) * (observed - expected) / variance, 5) AS chi2 FROM t")
def w10(v):
    out = S.log_rank(S.split_arms(v.clinical, "expr"))
    return out.select(F.col("observed").cast("long").alias("observed"), F.round("expected", 4).alias("expected"), F.round("variance", 4).alias("variance"), F.round("chi2", 5).alias("chi2"))


TAIL = "greatest(0, 0.5 - (SELECT z / 6000 / sqrt(2 * pi()) * sum((CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z * i / 2000, 2) / 2)) FROM range(0, 2001) r(i)))"


@query("w10_log_rank_p", f"{LOG_RANK}, zz AS (SELECT abs(observed - expected) / sqrt(variance) AS z FROM t) SELECT round(2 * {TAIL}, 6) AS p FROM zz")
def w10p(v):
    return S.log_rank(S.split_arms(v.clinical, "expr")).select(F.round("p", 6).alias("p"))
