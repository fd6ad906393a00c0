"""Queries of metrics, folds and trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import metrics as M
from ..operators import normalisation as N
from .base import query
from .survival import TAIL


def rounded(df, digits=5, keep=()):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def embeddings(v):
    """The variant with the smallest number is a gene's reference."""
    return v.embeddings.select(F.concat(F.lit("G"), F.col("label").cast("string")).alias("gene"), F.col("vec_id").alias("variant_no"), "embedding")


EMB = "emb AS (SELECT concat('G', CAST(label AS VARCHAR)) AS gene, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS variant_no, embedding FROM embeddings), refs AS (SELECT gene, embedding AS r FROM emb WHERE variant_no = 0), dr AS (SELECT emb.gene, greatest(0, 1 - list_sum(list_transform(range(1, 65), lambda i: CAST(r[i] AS DOUBLE) * embedding[i])) / (sqrt(list_sum(list_transform(r, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))))) AS d FROM emb JOIN refs ON emb.gene = refs.gene WHERE variant_no > 0)"


@query("a24_f13_drift_statistics", f"WITH {EMB} SELECT gene, count(*) AS n, round(avg(d), 4) AS mean, round(stddev_pop(d), 4) AS std, round(max(d), 4) AS max, round(min(d), 4) AS min FROM dr GROUP BY 1")
def a24(v):
    return rounded(M.drift_statistics(embeddings(v)), 4)


@query("a25_cohort_instability", f"WITH {EMB}, s AS (SELECT gene, avg(d) AS mean FROM dr GROUP BY 1) SELECT round(avg(mean), 4) AS mean, round(stddev_pop(mean), 4) AS std, round(max(mean), 4) AS max, round(min(mean), 4) AS min, round(max(mean) - min(mean), 4) AS range, round(CASE WHEN stddev_pop(mean) < 1e-12 THEN 0 ELSE avg(mean) / stddev_pop(mean) END, 2) AS snr FROM s")
def a25(v):
    out = M.cohort_instability(M.drift_statistics(embeddings(v)))
    return rounded(out, 4).withColumn("snr", F.round("snr", 2))


def attribution(v):
    value = (F.col("l_discount") - 0.05) * F.col("l_quantity")
    return v.lineitem.groupBy(F.col("l_suppkey").alias("sample_id"), F.concat(F.lit("G"), (F.col("l_partkey") % 40).cast("string")).alias("feature"), F.col("l_returnflag").alias("class")).agg(F.avg(value).alias("value"))


ATT = "att AS (SELECT l_suppkey AS sample_id, concat('G', CAST(l_partkey % 40 AS VARCHAR)) AS feature, l_returnflag AS class, avg((l_discount - 0.05) * l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3), one AS (SELECT sample_id, feature, avg(abs(value)) AS a FROM att GROUP BY 1, 2), imp AS (SELECT *, row_number() OVER (ORDER BY mean_abs DESC, feature) AS rank FROM (SELECT feature, avg(a) AS mean_abs, stddev_pop(a) AS std_abs FROM one GROUP BY 1) ORDER BY mean_abs DESC, feature LIMIT 15)"


@query("a27_attribution_importance", f"WITH {ATT} SELECT feature, round(mean_abs, 6) AS mean_abs, round(std_abs, 6) AS std_abs, rank FROM imp")
def a27(v):
    return rounded(M.attribution_importance(attribution(v), 15), 6)


@query("a28_pathway_attribution", f"WITH {ATT} SELECT pathway, round(sum(mean_abs), 6) AS total, count(*) AS n_genes, string_agg(feature, ',' ORDER BY mean_abs DESC, feature) AS genes FROM imp JOIN pathway_dim ON feature = gene GROUP BY 1")
def a28(v):
    return rounded(M.pathway_attribution(M.attribution_importance(attribution(v), 15), v.pathway_dim), 6)


@query("t5_t5a_top_attributions", f"WITH {ATT}, s AS (SELECT sample_id, feature, avg(value) AS value FROM att GROUP BY 1, 2) SELECT sample_id, feature, round(value, 6) AS value, rank, CASE WHEN value >= 0 THEN 'increases' ELSE 'decreases' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY abs(value) DESC, feature) AS rank FROM s) WHERE rank <= 3")
def t5(v):
    return rounded(M.top_attributions(attribution(v).groupBy("sample_id", "feature").agg(F.avg("value").alias("value")), 3), 6)


ENS = "ens AS (SELECT id, k, avg(p) AS mean, stddev_pop(p) AS std, quantile_cont(p, 0.025) AS low, quantile_cont(p, 0.975) AS high FROM member_proba GROUP BY 1, 2)"


@query("a29_ensemble_prediction", f"WITH {ENS} SELECT id, CAST(k AS INTEGER) AS k, round(mean, 5) AS mean, round(std, 5) AS std, round(low, 5) AS low, round(high, 5) AS high FROM ens")
def a29(v):
    return rounded(M.ensemble_prediction(v.member_proba), 5)


@query("a30_ensemble_decision", f"WITH {ENS}, d AS (SELECT id, -sum(mean * ln(mean + 1e-10)) / ln(3) AS entropy, max(mean) AS p FROM ens GROUP BY 1) SELECT d.id, round(entropy, 5) AS entropy, round(1 - entropy, 5) AS confidence, CAST((SELECT min(k) FROM ens e WHERE e.id = d.id AND e.mean = d.p) AS INTEGER) AS k, round(p, 5) AS p, CASE WHEN 1 - entropy >= 0.8 AND p >= 0.7 THEN 'HIGH' WHEN 1 - entropy >= 0.6 AND p >= 0.5 THEN 'MODERATE' WHEN 1 - entropy >= 0.5 THEN 'LOW' ELSE 'UNCERTAIN' END AS decision FROM d")
def a30(v):
    return rounded(M.ensemble_decision(M.ensemble_prediction(v.member_proba), 3), 5)


CAL = "cal AS (SELECT CAST(b AS INTEGER) AS bin, round(avg(p), 4) AS mean_p, round(avg(y), 4) AS fraction, count(*) AS count FROM predictions, (SELECT unnest(range(10)) AS b) WHERE p >= b / 10.0::DOUBLE AND p < (b + 1) / 10.0::DOUBLE GROUP BY 1)"


@query("a31_calibration_curve", f"WITH {CAL} SELECT * FROM cal")
def a31(v):
    return M.calibration_curve(v.predictions)


@query("a32_calibration_error", f"WITH {CAL} SELECT round(sum(count * abs(mean_p - fraction)) / sum(count), 5) AS ece FROM cal")
def a32(v):
    return rounded(M.calibration_error(M.calibration_curve(v.predictions)))


def folded(v):
    rows = v.predictions.withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
    return rows.withColumn("fold", (F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 4), 16, 10).cast("long") % 5).cast("int"))


FOLDED = "folded AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS yhat, CAST(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 4))::BIGINT % 5 AS INTEGER) AS fold FROM predictions)"
CLS = f"{FOLDED}, u AS (SELECT fold, c, count(*) FILTER (y = c) AS s, count(*) FILTER (y = c AND yhat = c) AS tp, count(*) FILTER (yhat = c) AS pr FROM folded, (SELECT unnest([0, 1]) AS c) GROUP BY 1, 2), w AS (SELECT *, CASE WHEN pr > 0 THEN CAST(tp AS DOUBLE) / pr ELSE 0 END AS p, CASE WHEN s > 0 THEN CAST(tp AS DOUBLE) / s ELSE 0 END AS r FROM u), met AS (SELECT fold, CAST(sum(tp) AS DOUBLE) / sum(s) AS accuracy, sum(p * s) / sum(s) AS precision, sum(r * s) / sum(s) AS recall, sum(s * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(s) AS f1, sum(s * CASE WHEN 4 * p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END) / sum(s) AS f2 FROM w GROUP BY 1)"


@query("a33_classification_metrics", f"WITH {CLS} SELECT fold, round(accuracy, 5) AS accuracy, round(precision, 5) AS precision, round(recall, 5) AS recall, round(f1, 5) AS f1, round(f2, 5) AS f2 FROM met")
def a33(v):
    return rounded(M.classification_metrics(folded(v), ["fold"]))


@query("a34_roc_auc", f"WITH {FOLDED}, r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS rk FROM folded) SELECT fold, round(CAST((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS DOUBLE), 5) AS auc FROM r GROUP BY 1")
def a34(v):
    return rounded(M.roc_auc(folded(v), ["fold"]))


@query("a34_one_vs_rest_auc", f"WITH {ENS}, x AS (SELECT k, mean, CASE WHEN id % 3 = k THEN 1 ELSE 0 END AS y FROM ens), r AS (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY round(mean, 6)) + (count(*) OVER (PARTITION BY k, round(mean, 6)) - 1) / 2.0 AS rk FROM x), a AS (SELECT k, CAST((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS DOUBLE) AS auc, avg(y) AS w FROM r GROUP BY 1) SELECT round(sum(auc * w) / sum(w), 5) AS auc FROM a")
def a34b(v):
    rows = M.ensemble_prediction(v.member_proba).select("id", "k", F.round("mean", 6).alias("p"))
    return rounded(M.one_vs_rest_auc(rows, v.predictions.select("id", (F.col("id") % 3).alias("c"))))


@query("a35_class_accuracy", f"WITH {FOLDED} SELECT y, round(avg(CASE WHEN y = yhat THEN 1 ELSE 0 END), 5) AS accuracy FROM folded GROUP BY 1")
def a35(v):
    return folded(v).groupBy("y").agg(F.round(F.avg((F.col("y") == F.col("yhat")).cast("int")), 5).alias("accuracy"))


@query("a36_a37_fold_summary", f"WITH {CLS} SELECT round(avg(accuracy), 5) AS accuracy_mean, round(stddev_pop(accuracy), 5) AS accuracy_std, round(avg(f1), 5) AS f1_mean, round(stddev_pop(f1), 5) AS f1_std, round(stddev_samp(accuracy) / greatest(avg(accuracy), 1e-10), 5) AS stability FROM met")
def a36(v):
    met = M.classification_metrics(folded(v), ["fold"])
    return rounded(M.fold_summary(met, ["accuracy", "f1"]).join(M.stability(met, "accuracy")))


@query("a38_mutual_information", "WITH e AS (SELECT list_distinct([quantile_cont(expr, 0.0), quantile_cont(expr, 0.1), quantile_cont(expr, 0.2), quantile_cont(expr, 0.3), quantile_cont(expr, 0.4), quantile_cont(expr, 0.5), quantile_cont(expr, 0.6), quantile_cont(expr, 0.7), quantile_cont(expr, 0.8), quantile_cont(expr, 0.9), quantile_cont(expr, 1.0)]) AS e FROM clinical), b AS (SELECT cancer_type, greatest(len(list_filter(e, lambda x: x < expr)) - 1, 0) AS bin FROM clinical, e), c AS (SELECT cancer_type, bin, count(*) AS n FROM b GROUP BY 1, 2), t AS (SELECT n, sum(n) OVER (PARTITION BY cancer_type) AS na, sum(n) OVER (PARTITION BY bin) AS nb, sum(n) OVER () AS total FROM c) SELECT round(sum(CAST(n AS DOUBLE) / total * ln(CAST(n AS DOUBLE) * total / (CAST(na AS DOUBLE) * nb))), 6) AS mi FROM t")
def a38(v):
    return rounded(M.mutual_information(v.clinical, "cancer_type", "expr"), 6)


@query("a39_synergy", "WITH m AS (SELECT l_returnflag AS f, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1), b AS (SELECT avg(l_extendedprice) AS base FROM lineitem) SELECT round((SELECT x FROM m WHERE f = 'R') - base - ((SELECT x FROM m WHERE f = 'A') - base + (SELECT x FROM m WHERE f = 'N') - base), 4) AS synergy FROM b")
def a39(v):
    pick = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice")))
    row = v.lineitem.agg(pick("R").alias("ab"), pick("A").alias("a"), pick("N").alias("b"), F.avg("l_extendedprice").alias("base"))
    return row.select(F.round(F.expr("ab - base - ((a - base) + (b - base))"), 4).alias("synergy"))


@query("a40_a49_sweep", "SELECT event_type AS parameter, user_id % 5 AS setting, count(*) AS n, round(avg(value), 5) AS mean_reward, round(stddev_pop(value), 5) AS std_reward, count(*) FILTER (value > 50) AS n_on, count(*) FILTER (value <= 50) AS n_off FROM events GROUP BY 1, 2")
def a40(v):
    on = F.sum(F.when(F.col("value") > 50, 1).otherwise(0))
    return v.events.groupBy(F.col("event_type").alias("parameter"), (F.col("user_id") % 5).alias("setting")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean_reward"), F.round(F.stddev_pop("value"), 5).alias("std_reward"), on.alias("n_on"), (F.count(F.lit(1)) - on).alias("n_off"))


def trajectory(v):
    return v.events.select(F.col("user_id").alias("subject"), F.col("event_type").alias("regimen"), "ts", "value")


BEST = "best AS (SELECT user_id AS subject, event_type AS regimen, arg_min(value, struct_pack(a := ts, b := value)) AS initial, arg_max(value, struct_pack(a := ts, b := value)) AS final, min(value) AS nadir, min(struct_pack(a := value, b := ts)).b AS best_ts FROM events GROUP BY 1, 2), ch AS (SELECT *, (nadir - initial) / greatest(initial, 1.0) * 100 AS change FROM best)"


@query("a41_p11_best_response", f"WITH {BEST} SELECT subject, regimen, best_ts, round(nadir, 4) AS nadir, round(initial, 4) AS initial, round(final, 4) AS final, round(change, 4) AS change, CASE WHEN change <= -99 THEN 'CR' WHEN change <= -30 THEN 'PR' WHEN change >= 20 THEN 'PD' ELSE 'SD' END AS response FROM ch")
def a41(v):
    out = M.best_response(trajectory(v), ["subject", "regimen"])
    return rounded(out.withColumn("response", C.response_class(F.col("change"))), 4)


@query("a42_response_percent", "WITH f AS (SELECT user_id, min(struct_pack(a := ts, b := value)).b AS f FROM events GROUP BY 1) SELECT e.user_id AS subject, count(*) AS n, round(sum(round((f - value) / f * 100, 2)), 1) AS total FROM events e JOIN f ON e.user_id = f.user_id WHERE f > 0 GROUP BY 1")
def a42(v):
    return M.response_total(M.response_percent(trajectory(v), ["subject"]), ["subject"])


@query("a43_regimen_comparison", f"WITH {BEST} SELECT regimen, round(min(change), 4) AS best_change, round(avg(change), 4) AS mean_change, count(*) FILTER (change <= -30) AS responders, count(*) AS n FROM ch GROUP BY 1 ORDER BY 2")
def a43(v):
    rows = M.best_response(trajectory(v), ["subject", "regimen"])
    return rows.groupBy("regimen").agg(F.round(F.min("change"), 4).alias("best_change"), F.round(F.avg("change"), 4).alias("mean_change"), F.sum((F.col("change") <= -30).cast("int")).alias("responders"), F.count(F.lit(1)).alias("n")).orderBy("best_change")


SER = "ser AS (SELECT user_id AS subject, epoch(ts) / 86400.0::DOUBLE AS t, value AS c FROM events)"


def series(v):
    return v.events.select(F.col("user_id").alias("subject"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400.0).alias("t"), F.col("value").alias("c"))


@query("a44_exposure", f"WITH {SER}, l AS (SELECT subject, max(t) - 1 AS f FROM ser GROUP BY 1), r AS (SELECT ser.*, CASE WHEN c <= 0 THEN 0 ELSE 0.9 * pow(c, 1.2) / (pow(40.0, 1.2) + pow(c, 1.2)) END AS e FROM ser JOIN l ON ser.subject = l.subject AND t >= f) SELECT subject, round(max(c), 4) AS cmax, round(min(c), 4) AS cmin, round(avg(c), 4) AS cavg, round(avg(c) * 24, 3) AS auc24, round(arg_max(e, c), 5) AS effect_peak, round(arg_min(e, c), 5) AS effect_trough FROM r GROUP BY 1")
def a44(v):
    out = M.exposure(series(v), C.emax_effect(F.col("c"), F.lit(0.9), F.lit(40.0), F.lit(1.2)))
    return out.select("subject", *(F.round(c, 4).alias(c) for c in ("cmax", "cmin", "cavg")), F.round("auc24", 3).alias("auc24"), F.round("effect_peak", 5).alias("effect_peak"), F.round("effect_trough", 5).alias("effect_trough"))


@query("a45_daily_mean", f"WITH {SER} SELECT subject, CAST(floor(t) AS BIGINT) AS day, round(avg(c), 5) AS mean FROM ser GROUP BY 1, 2")
def a45(v):
    return series(v).groupBy("subject", F.floor("t").alias("day")).agg(F.round(F.avg("c"), 5).alias("mean"))


@query("w14_hysteresis", "WITH s AS (SELECT user_id, coalesce(last_value(CASE WHEN value < 20 THEN 0 WHEN value > 60 THEN 1 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS o FROM events) SELECT user_id AS subject, CAST(sum(o) AS BIGINT) AS n_on, count(*) AS n FROM s GROUP BY 1")
def w14(v):
    rows = v.events.select(F.col("user_id").alias("subject"), "ts", F.col("event_id").alias("ord"), "value")
    return M.hysteresis(rows, 20, 60).groupBy("subject").agg(F.sum("on").cast("long").alias("n_on"), F.count(F.lit(1)).alias("n"))


@query("w15_returns_to_go", "WITH e AS (SELECT l_orderkey AS episode, l_linenumber AS t, sum(l_quantity) AS r FROM lineitem GROUP BY 1, 2), g AS (SELECT episode, t, sum(r * pow(0.9, t)) OVER (PARTITION BY episode ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow(0.9, t) AS g FROM e) SELECT t, round(avg(g), 4) AS g, count(*) AS n FROM g GROUP BY 1")
def w15(v):
    rows = v.lineitem.groupBy(F.col("l_orderkey").alias("episode"), F.col("l_linenumber").alias("t")).agg(F.sum("l_quantity").alias("r"))
    return M.returns_to_go(rows, 0.9).groupBy("t").agg(F.round(F.avg("g"), 4).alias("g"), F.count(F.lit(1)).alias("n"))


@query("w16_wilcoxon", f"WITH d AS (SELECT round(l_discount - l_tax, 4) AS d FROM lineitem WHERE round(l_discount - l_tax, 4) <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM d), s AS (SELECT count(*) AS n, CAST(sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS DOUBLE) AS w_plus FROM r), zz AS (SELECT *, (w_plus - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24) AS z1, least(abs((w_plus - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24)), 9) AS z FROM s) SELECT n, w_plus, round(z1, 4) AS z, round(CASE WHEN z1 >= 0 THEN {TAIL} ELSE 1 - {TAIL} END, 6) AS p FROM zz")
def w16(v):
    rows = v.lineitem.select(F.round(F.col("l_discount") - F.col("l_tax"), 4).alias("a"), F.lit(0.0).alias("b"))
    return M.wilcoxon(rows).withColumns({"z": F.round("z", 4), "p": F.round("p", 6)})


#: 2^n sign patterns of a few differences, one of a nation each.
PAIRS = "c AS (SELECT c_nationkey AS k, round(avg(c_acctbal), 4) AS a FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, round(avg(s_acctbal), 4) AS b FROM supplier GROUP BY 1), d AS (SELECT round(a - b, 4) AS d FROM c JOIN s ON c.k = s.k WHERE round(a - b, 4) <> 0)"


@query("w16_exact_signed_ranks", f"WITH RECURSIVE {PAIRS}, r AS (SELECT d, row_number() OVER (ORDER BY abs(d)) AS rk FROM d), t AS (SELECT count(*) AS n, CAST(sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS DOUBLE) AS w_plus FROM r), sums AS (SELECT 0::BIGINT AS step, 0::BIGINT AS s, 1::BIGINT AS ways UNION ALL SELECT step + 1, s + x * (step + 1), CAST(sum(ways) AS BIGINT) FROM sums, (VALUES (0), (1)) b(x) WHERE step < (SELECT n FROM t) GROUP BY 1, 2) SELECT n, w_plus, round((w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 4) AS z, round(CAST((SELECT sum(ways) FROM sums WHERE step = n AND s >= w_plus) AS DOUBLE) / pow(2, n), 9) AS p FROM t")
def w16_exact(v):
    c = v.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg("c_acctbal"), 4).cast("double").alias("a"))
    s = v.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal"), 4).cast("double").alias("b"))
    pairs = c.join(s, "k").select(F.round(F.col("a") - F.col("b"), 4).alias("a"), F.lit(0.0).alias("b"))
    return M.wilcoxon(pairs).withColumns({"z": F.round("z", 4), "p": F.round("p", 9)})


@query("w18_stratified_folds", "WITH f AS (SELECT r, y, (row_number() OVER (PARTITION BY r, y ORDER BY md5(concat(CAST(r AS VARCHAR), '|', CAST(id AS VARCHAR))), id) - 1) % 5 AS fold, id FROM predictions, (SELECT unnest(range(3)) AS r)) SELECT CAST(r AS INTEGER) AS repeat, y, CAST(fold AS INTEGER) AS fold, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM f GROUP BY 1, 2, 3")
def w18(v):
    return M.repeated_folds(v.predictions, 5, 3).groupBy("repeat", "y", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


H = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("w19_hold_out", f"SELECT {H.format("concat('0|', CAST(id AS VARCHAR))")} >= 0.7 AS is_test, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM predictions GROUP BY 1")
def w19(v):
    return M.hold_out(v.predictions).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("w20_subsample", f"SELECT CAST(d AS INTEGER) AS draw, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM predictions, (SELECT unnest(range(4)) AS d) WHERE {H.format("concat(CAST(d AS VARCHAR), '|', CAST(id AS VARCHAR))")} < 0.7 GROUP BY 1")
def w20(v):
    return M.subsample(v.predictions, 4).groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


_STEPS = [0.449328964117222, 0.808792135411, 0.952577403928511, 0.990920142199848, 0.998588689854115, 0.999815697478798, 0.999979298495422, 0.999997995754464]


@query("w21_bootstrap", f"WITH e AS (SELECT CAST(d AS INTEGER) AS draw, id, y, {H.format("concat('b|', CAST(d AS VARCHAR), '|', CAST(id AS VARCHAR))")} AS h FROM predictions, (SELECT unnest(range(4)) AS d)), c AS (SELECT *, {' + '.join(f'CASE WHEN h >= {s}::DOUBLE THEN 1 ELSE 0 END' for s in _STEPS)} AS times FROM e), m AS (SELECT *, sum(times) OVER (PARTITION BY draw, y) AS t, row_number() OVER (PARTITION BY draw, y ORDER BY h, id) AS r FROM c) SELECT draw, y, CAST(sum(CASE WHEN t = 0 AND r = 1 THEN 1 ELSE times END) AS BIGINT) AS n FROM m WHERE (CASE WHEN t = 0 AND r = 1 THEN 1 ELSE times END) > 0 GROUP BY 1, 2")
def w21(v):
    return M.bootstrap_weights(v.predictions, 4).groupBy("draw", "y").agg(F.sum("times").alias("n"))


@query("t6_best_worst", "SELECT arg_max(p_brand, m) AS best, arg_min(p_brand, m) AS worst FROM (SELECT p_brand, round(avg(p_retailprice), 6) AS m FROM part GROUP BY 1)")
def t6(v):
    rows = v.part.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("m"))
    return rows.agg(F.max_by("p_brand", "m").alias("best"), F.min_by("p_brand", "m").alias("worst"))


@query("w17_spearman", "WITH w AS (SELECT sample_id, avg(CASE WHEN gene = 'G1' THEN value END) AS a, avg(CASE WHEN gene = 'G2' THEN value END) AS b FROM assay GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM w WHERE a IS NOT NULL AND b IS NOT NULL) SELECT round(corr(CAST(ra AS DOUBLE), CAST(rb AS DOUBLE)), 6) AS rho FROM r")
def w17(v):
    pick = lambda g: F.avg(F.when(F.col("gene") == g, F.col("value")))
    wide = v.assay.groupBy("sample_id").agg(pick("G1").alias("a"), pick("G2").alias("b")).dropna().withColumn("_all", F.lit(1))
    ranked = N.average_rank(N.average_rank(wide, "a", ["_all"], "ra"), "b", ["_all"], "rb")
    return ranked.agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))
