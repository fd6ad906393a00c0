"""Queries of the cohort operators (P, J, A1-A23, U, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from .base import query

IMPACT_SQL = "CASE WHEN variant_class IN ('Nonsense_Mutation','Splice_Site') THEN 'HIGH' WHEN variant_class = 'Missense_Mutation' THEN 'MODERATE' WHEN variant_class IN ('Silent','RNA') THEN 'LOW' ELSE 'MODIFIER' END"
VAF_SQL = "CASE WHEN t_alt_count + t_ref_count > 0 THEN CAST(t_alt_count AS DOUBLE) / (t_alt_count + t_ref_count) ELSE 0.0 END"


@query("p1_drug_sensitivity", "SELECT drug, tissue, count(*) AS n, round(avg(ln_ic50), 6) AS mean_ln_ic50 FROM dose_response WHERE regexp_matches(lower(drug), 'brand#1') AND regexp_matches(lower(tissue), 'a|r') GROUP BY 1, 2")
def p1(v):
    return C.drug_sensitivity(v.dose_response, "brand#1", "a|r").groupBy("drug", "tissue").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ln_ic50"), 6).alias("mean_ln_ic50"))


@query("p2_p3_resistant_sensitive", "SELECT cell_line, count(*) FILTER (ln_ic50 > 2.0) AS n_resistant, count(*) FILTER (ln_ic50 < -1.0) AS n_sensitive FROM dose_response WHERE ln_ic50 > 2.0 OR ln_ic50 < -1.0 GROUP BY 1")
def p23(v):
    both = C.resistant(v.dose_response).withColumn("r", F.lit(1)).unionByName(C.sensitive(v.dose_response).withColumn("r", F.lit(0)))
    return both.groupBy("cell_line").agg(F.sum("r").alias("n_resistant"), F.sum(1 - F.col("r")).alias("n_sensitive"))


@query("p4_patient_subset", "SELECT count(*) AS n_clinical, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT patient_id FROM clinical WHERE cancer_type = '1-URGENT')) AS n_rows FROM clinical WHERE cancer_type = '1-URGENT'")
def p4(v):
    rows = v.lineitem.select(F.col("l_orderkey").alias("patient_id"))
    out = C.patient_subset({"clinical": v.clinical.select("patient_id"), "rows": rows}, v.clinical, "1-URGENT")
    return out["clinical"].agg(F.count(F.lit(1)).alias("n_clinical")).join(out["rows"].agg(F.count(F.lit(1)).alias("n_rows")))


@query("p5_gene_symbols", "SELECT gene, count(*) AS n FROM (SELECT upper(p_name) AS gene FROM part UNION ALL SELECT p_brand FROM part) WHERE regexp_matches(gene, '^[A-Z][A-Z0-9/-]*$') OR NOT (SELECT bool_or(regexp_matches(gene, '^[A-Z][A-Z0-9/-]*$')) FROM (SELECT upper(p_name) AS gene FROM part UNION ALL SELECT p_brand FROM part)) GROUP BY 1")
def p5(v):
    names = v.part.select(F.upper("p_name").alias("gene")).union(v.part.select("p_brand"))
    return C.gene_symbols(names).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query("p6_coverage_filter", "SELECT gene, count(*) AS n, round(avg(value), 4) AS mean FROM assay WHERE gene IN (SELECT gene FROM assay GROUP BY gene HAVING sum(CASE WHEN value <> 0 THEN 1 ELSE 0 END) >= 10) GROUP BY 1")
def p6(v):
    return C.covered_genes(v.assay).groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("p7_survival_columns", "SELECT cancer_type, round(sum(time), 3) AS time, sum(event) AS event FROM clinical GROUP BY 1")
def p7(v):
    return v.clinical.select("time", "event", "cancer_type").groupBy("cancer_type").agg(F.round(F.sum("time"), 3).alias("time"), F.sum("event").alias("event"))


@query("p8_p9_a3_mutation_features", f"SELECT gene, count(*) AS mut_count, sum(CASE WHEN {IMPACT_SQL} = 'HIGH' THEN 1 ELSE 0 END) AS high_count, coalesce(round(avg({VAF_SQL}), 6), 0.0) AS mean_vaf FROM variants GROUP BY 1")
def a3(v):
    return C.mutation_features(v.variants)


@query("p9_impact_counts", f"SELECT {IMPACT_SQL} AS impact, count(*) AS n, round(sum({VAF_SQL}), 4) AS vaf FROM variants GROUP BY 1")
def p9(v):
    return v.variants.groupBy(C.impact(F.col("variant_class")).alias("impact")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(C.allele_fraction(F.col("t_alt_count"), F.col("t_ref_count"))), 4).alias("vaf"))


@query("p12_decision_quality", "SELECT CASE WHEN c >= 0.8 AND p >= 0.7 THEN 'HIGH' WHEN c >= 0.6 AND p >= 0.5 THEN 'MODERATE' WHEN c >= 0.5 THEN 'LOW' ELSE 'UNCERTAIN' END AS quality, CASE WHEN p >= 0.75 THEN 'HIGH' WHEN p >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS priority, count(*) AS n FROM (SELECT p, abs(2 * p - 1) AS c FROM predictions) GROUP BY 1, 2")
def p12(v):
    c = F.abs(2 * F.col("p") - 1)
    return v.predictions.groupBy(C.decision_quality(c, F.col("p")).alias("quality"), C.priority(F.col("p")).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("p15_active_days", "SELECT user_id, count(DISTINCT day) AS n_active FROM (SELECT user_id, datediff('day', min(CAST(ts AS DATE)) OVER (PARTITION BY user_id), CAST(ts AS DATE)) AS day FROM events) WHERE day >= 1 AND day - 1 < 20 AND (day - 1) % 7 < 5 GROUP BY 1")
def p15(v):
    start = v.events.groupBy("user_id").agg(F.min(F.to_date("ts")).alias("start"))
    day = F.datediff(F.to_date("ts"), F.col("start"))
    days = v.events.join(start, "user_id").select("user_id", day.alias("day"))
    return days.where(C.active_day(F.col("day"), F.lit(1), F.lit(20), F.lit(5), F.lit(2))).groupBy("user_id").agg(F.count_distinct("day").alias("n_active"))


@query("p16_emax_effect", "SELECT l_returnflag AS flag, round(avg(CASE WHEN l_quantity - 5 <= 0 THEN 0.0 ELSE 0.9 * pow(l_quantity - 5, 1.5) / (pow(10 + length(p_brand), 1.5) + pow(l_quantity - 5, 1.5)) END), 6) AS effect FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def p16(v):
    rows = v.lineitem.join(v.part, F.col("l_partkey") == F.col("p_partkey"))
    effect = C.emax_effect(F.col("l_quantity") - 5, F.lit(0.9), (10 + F.length("p_brand")).cast("double"), F.lit(1.5))
    return rows.groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.avg(effect), 6).alias("effect"))


@query("j1_j2_u1_training_matrix", "SELECT label, gene, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT cell_line, 1 AS label FROM dose_response WHERE ln_ic50 < -1.0 UNION ALL SELECT cell_line, 0 FROM dose_response WHERE ln_ic50 > 2.0) JOIN assay ON cell_line = sample_id GROUP BY 1, 2")
def j1(v):
    # Equal (cell line, label) rows are counted before the join and weigh in after it.
    labelled = C.sensitive(v.dose_response).select("cell_line", F.lit(1).alias("label")).unionByName(C.resistant(v.dose_response).select("cell_line", F.lit(0).alias("label")))
    counted = labelled.groupBy("cell_line", "label").agg(F.count(F.lit(1)).alias("k"))
    rows = counted.join(v.assay, F.col("cell_line") == F.col("sample_id"))
    return rows.groupBy("label", "gene").agg(F.sum("k").alias("n"), F.round(F.sum(F.col("value") * F.col("k")) / F.sum("k"), 4).alias("mean"))


@query("j3_left_features", f"WITH m AS (SELECT gene, count(*) AS mut_count FROM variants GROUP BY 1), g AS (SELECT DISTINCT p_brand AS gene FROM part UNION SELECT DISTINCT gene FROM assay) SELECT g.gene, mut_count FROM g LEFT JOIN m ON g.gene = m.gene")
def j3(v):
    genes = v.part.select(F.col("p_brand").alias("gene")).union(v.assay.select("gene")).distinct()
    return genes.join(C.mutation_features(v.variants).select("gene", "mut_count"), "gene", "left")


@query("j4_common_patients", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id FROM events INTERSECT SELECT DISTINCT o_custkey FROM orders)")
def j4(v):
    return v.events.select("user_id").distinct().join(v.orders.select(F.col("o_custkey").alias("user_id")).distinct(), "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("j5_j6_j7_lookup_defaults", "SELECT g.gene, coalesce(d.drug, '—') AS drug, coalesce(d.status, 'No known drug') AS status, coalesce(r.mechanism, 'None catalogued') AS mechanism, coalesce(r.risk, CAST(0 AS DOUBLE)) AS risk FROM (SELECT DISTINCT gene FROM variants) g LEFT JOIN drug_dim d ON upper(g.gene) = d.gene LEFT JOIN (SELECT gene, min_by(mechanism, ord) AS mechanism, CAST(least(1.0, round(0.2 * count(*), 4)) AS DOUBLE) AS risk FROM resistance_dim GROUP BY 1) r ON g.gene = r.gene")
def j5(v):
    genes = v.variants.select("gene").distinct()
    drugs = C.with_default(genes.withColumn("gene", F.upper("gene")), v.drug_dim.drop("ord"), "gene", {"drug": "—", "status": "No known drug"})
    risk = v.resistance_dim.groupBy("gene").agg(F.min_by("mechanism", "ord").alias("mechanism"), F.least(F.lit(1.0), F.round(0.2 * F.count(F.lit(1)), 4)).alias("risk"))
    return C.with_default(drugs, risk, "gene", {"mechanism": "None catalogued", "risk": 0.0})


@query("j8_symmetric_pairs", "SELECT gene, count(*) AS n, string_agg(partner, ',' ORDER BY partner) AS partners FROM (SELECT gene_a AS gene, gene_b AS partner FROM sl_dim UNION SELECT gene_b, gene_a FROM sl_dim) GROUP BY 1")
def j8(v):
    return C.symmetric(v.sl_dim).groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("partner")), ",").alias("partners"))


@query("j10_gene_overlap", "SELECT count(*) AS n FROM (SELECT gene FROM assay_a INTERSECT SELECT gene FROM assay_r)")
def j10(v):
    return v.assay_a.select("gene").intersect(v.assay_r.select("gene")).agg(F.count(F.lit(1)).alias("n"))


@query("j11_g6_drug_pathways", "SELECT drug, count(DISTINCT d.gene) AS n_targets, count(DISTINCT pathway) AS n_pathways, CAST(least(1.0, round(0.3 * count(DISTINCT d.gene) + 0.1 * count(DISTINCT pathway), 4)) AS DOUBLE) AS poly_score FROM drug_gene d LEFT JOIN gene_pathway g ON d.gene = g.gene GROUP BY 1")
def j11(v):
    hop = v.drug_gene.join(v.gene_pathway, "gene", "left").groupBy("drug").agg(F.count_distinct("gene").alias("n_targets"), F.count_distinct("pathway").alias("n_pathways"))
    return hop.withColumn("poly_score", F.least(F.lit(1.0), F.round(0.3 * F.col("n_targets") + 0.1 * F.col("n_pathways"), 4)))


@query("a1_mutation_counts", "SELECT gene, count(*) AS n_mutations FROM variants GROUP BY 1 ORDER BY 2 DESC")
def a1(v):
    return C.mutation_counts(v.variants).orderBy(F.desc("n_mutations"), "gene")


@query("a2_mutation_burden", "SELECT sample_id, count(*) AS tmb FROM variants GROUP BY 1")
def a2(v):
    return C.mutation_burden(v.variants)


@query("a4_cna_summary", "SELECT gene, sum(CASE WHEN score >= 2 THEN 1 ELSE 0 END) AS amplifications, sum(CASE WHEN score <= -2 THEN 1 ELSE 0 END) AS deletions, round(CAST(sum(CASE WHEN score >= 2 THEN 1 ELSE 0 END) AS DOUBLE) / count(score), 6) AS amp_freq, round(CAST(sum(CASE WHEN score <= -2 THEN 1 ELSE 0 END) AS DOUBLE) / count(score), 6) AS del_freq FROM cna GROUP BY 1")
def a4(v):
    return C.cna_summary(v.cna)


@query("a5_methylation_summary", "SELECT probe AS gene, round(avg(beta), 6) AS meth_mean, round(var_samp(beta), 6) AS meth_var FROM methylation GROUP BY 1")
def a5(v):
    return C.methylation_summary(v.methylation)


@query("a6_differential_methylation", "WITH g AS (SELECT probe, label, avg(beta) AS m FROM methylation JOIN labels_s USING (sample_id) GROUP BY 1, 2) SELECT probe, round(avg(m), 5) AS mean, round(var_samp(m), 5) AS var, round(max(m) - min(m), 5) AS delta FROM g GROUP BY 1")
def a6(v):
    return C.differential_methylation(v.methylation, v.labels_s)


@query("a7_omics_features", f"WITH m AS (SELECT gene, count(*) AS mut_count, sum(CASE WHEN {IMPACT_SQL} = 'HIGH' THEN 1 ELSE 0 END) AS high_count, round(avg({VAF_SQL}), 6) AS mean_vaf FROM variants GROUP BY 1), c AS (SELECT gene, sum(CASE WHEN score >= 2 THEN 1 ELSE 0 END) AS amplifications, sum(CASE WHEN score <= -2 THEN 1 ELSE 0 END) AS deletions, round(CAST(sum(CASE WHEN score >= 2 THEN 1 ELSE 0 END) AS DOUBLE) / count(score), 6) AS amp_freq, round(CAST(sum(CASE WHEN score <= -2 THEN 1 ELSE 0 END) AS DOUBLE) / count(score), 6) AS del_freq FROM cna GROUP BY 1), t AS (SELECT probe AS gene, round(avg(beta), 6) AS meth_mean, round(var_samp(beta), 6) AS meth_var FROM methylation GROUP BY 1) SELECT g.gene, coalesce(mut_count, 0) AS mut_count, coalesce(high_count, 0) AS high_count, coalesce(mean_vaf, 0.0) AS mean_vaf, coalesce(amplifications, 0) AS amplifications, coalesce(deletions, 0) AS deletions, coalesce(amp_freq, 0.0) AS amp_freq, coalesce(del_freq, 0.0) AS del_freq, meth_mean, meth_var FROM (SELECT DISTINCT gene FROM drug_dim UNION SELECT DISTINCT p_brand FROM part) g LEFT JOIN m USING (gene) LEFT JOIN c USING (gene) LEFT JOIN t USING (gene)")
def a7(v):
    genes = v.drug_dim.select("gene").union(v.part.select("p_brand")).distinct()
    return C.omics_features(genes, v.variants, v.cna, v.methylation)


def _groups(v):
    return v.customer.select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("grp"))


@query("a8_a9_mutation_enrichment", "WITH g AS (SELECT c_custkey AS sample_id, c_mktsegment AS grp FROM customer), s AS (SELECT grp, count(DISTINCT sample_id) AS n_patients FROM g GROUP BY 1) SELECT gene, k.grp, round(CAST(k AS DOUBLE) / n_patients, 4) AS frequency, n_patients FROM (SELECT gene, grp, count(DISTINCT v.sample_id) AS k FROM variants v JOIN g ON v.sample_id = g.sample_id GROUP BY 1, 2) k JOIN s ON k.grp = s.grp")
def a9(v):
    return C.mutation_enrichment(v.variants, _groups(v))


@query("a9_cube", "WITH g AS (SELECT c_custkey AS sample_id, c_mktsegment AS grp FROM customer) SELECT gene, grp, count(DISTINCT v.sample_id) AS n_mutated FROM variants v JOIN g ON v.sample_id = g.sample_id GROUP BY CUBE (gene, grp)")
def a9c(v):
    return C.mutation_enrichment(v.variants, _groups(v), cube=True)


@query("a10_a11_driver_profile", "WITH n AS (SELECT count(*) AS n FROM customer), f AS (SELECT gene, round(CAST(count(DISTINCT sample_id) AS DOUBLE) / any_value(n), 6) AS frequency FROM variants, n GROUP BY 1) SELECT d.gene, coalesce(frequency, 0.0) AS frequency FROM (SELECT DISTINCT gene FROM pathway_dim UNION SELECT DISTINCT p_brand FROM part) d LEFT JOIN f ON d.gene = f.gene")
def a11(v):
    drivers = v.pathway_dim.select("gene").union(v.part.select("p_brand")).distinct()
    return C.driver_profile(drivers, v.variants, v.customer.agg(F.count(F.lit(1)).alias("n")))


@query("a12_cohort_summary", "SELECT count(*) AS n, count(DISTINCT cancer_type) AS n_types, round(avg(time), 4) AS mean_time, round(median(time), 4) AS median_time, round(avg(event), 6) AS event_rate, round(median(expr), 2) AS median_expr FROM clinical")
def a12(v):
    return v.clinical.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cancer_type").alias("n_types"), F.round(F.avg("time"), 4).alias("mean_time"), F.round(F.median("time"), 4).alias("median_time"), F.round(F.avg("event"), 6).alias("event_rate"), F.round(F.median("expr"), 2).alias("median_expr"))


@query("a13_survival_by_mutation", "SELECT n_mut, n_wt, round(m, 1) AS median_mut, round(w, 1) AS median_wt, round(m / greatest(w, 0.1), 3) AS ratio FROM (SELECT count(*) FILTER (grp = 0) AS n_mut, count(*) FILTER (grp <> 0) AS n_wt, median(time) FILTER (grp = 0) AS m, median(time) FILTER (grp <> 0) AS w FROM clinical)")
def a13(v):
    return C.survival_by_mutation(v.clinical, F.col("grp") == 0)


@query("a14_median_label", "SELECT cancer_type, sum(CASE WHEN time < (SELECT median(time) FROM clinical) THEN 1 ELSE 0 END) AS n_short, count(*) AS n FROM clinical GROUP BY 1")
def a14(v):
    return C.median_label(v.clinical).groupBy("cancer_type").agg(F.sum("label").alias("n_short"), F.count(F.lit(1)).alias("n"))


@query("a15_row_features", "WITH m AS (SELECT sample_id, avg(value) AS mu, stddev_pop(value) AS sd FROM assay GROUP BY 1), c AS (SELECT a.sample_id, avg(pow(value - mu, 3)) AS m3, avg(pow(value - mu, 4)) AS m4, max(value) AS mx, min(value) AS mn, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM assay a JOIN m ON a.sample_id = m.sample_id GROUP BY 1) SELECT c.sample_id, round(mu, 4) AS mean, round(sd, 4) AS std, round(CASE WHEN sd < 1e-12 THEN 0 ELSE m3 / pow(sd, 3) END, 4) AS skew, round(CASE WHEN sd < 1e-12 THEN -3 ELSE m4 / pow(sd, 4) - 3 END, 4) AS kurt, round(mx, 4) AS max, round(mn, 4) AS min, round((CASE WHEN sd < 1e-12 THEN 1 ELSE sd END) / (CASE WHEN abs(mu) < 1e-12 THEN 1 ELSE abs(mu) END), 4) AS cv, round(mx - mn, 4) AS range, round(q2, 4) AS median, round(q3 - q1, 4) AS iqr FROM c JOIN m ON c.sample_id = m.sample_id")
def a15(v):
    return C.row_features(v.assay)


@query("a16_class_weights", "SELECT cancer_type AS label, round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS weight FROM clinical GROUP BY 1")
def a16(v):
    return C.class_weights(v.clinical.select(F.col("cancer_type").alias("label")))


def _nations(v):
    return v.customer.select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").cast("string").alias("label"))


NATIONS_SQL = "SELECT c_custkey AS sample_id, CAST(c_nationkey AS VARCHAR) AS label, count(*) OVER (PARTITION BY c_nationkey) AS n, count(*) OVER () / 25.0 AS cut FROM customer"


@query("a17_a18_merge_rare", "WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS label, count(*) AS n FROM customer GROUP BY 1), m AS (SELECT CASE WHEN n < 60 THEN 'OTHER' ELSE label END AS label, sum(n) AS n FROM c GROUP BY 1) SELECT label, CAST(n AS BIGINT) AS n FROM m WHERE label <> 'OTHER' OR n >= 60")
def a17(v):
    return C.merge_rare(_nations(v), 60, drop_small_rest=True).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("a19_large_classes", "SELECT CAST(c_nationkey AS VARCHAR) AS label, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 55")
def a19(v):
    return C.large_classes(_nations(v), 55).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("a20_variance_filter", "WITH s AS (SELECT gene, var_samp(value) AS v FROM assay GROUP BY 1) SELECT gene, count(*) AS n FROM assay WHERE gene IN (SELECT gene FROM s WHERE v >= (SELECT quantile_cont(v, 0.25) FROM s)) GROUP BY 1")
def a20(v):
    return C.variance_filter(v.assay).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query("a21_top_variance", "WITH s AS (SELECT gene, var_samp(value) AS v FROM assay GROUP BY 1) SELECT gene FROM (SELECT gene FROM s ORDER BY v DESC, gene LIMIT 10) UNION SELECT gene FROM s WHERE gene IN (SELECT gene FROM pathway_dim)")
def a21(v):
    return C.top_variance_genes(v.assay, 10, v.pathway_dim.select("gene"))


@query("a22_pathway_summary", "SELECT pathway, count(DISTINCT p.gene) AS n_genes, string_agg(DISTINCT p.gene, ',' ORDER BY p.gene) AS genes FROM pathway_dim p WHERE gene IN (SELECT gene FROM variants) GROUP BY 1")
def a22(v):
    return C.pathway_summary(v.variants, v.pathway_dim)


@query("u2_merge_cohorts", "WITH t AS (SELECT *, 'A' AS cohort FROM assay_a UNION ALL SELECT *, 'R' FROM assay_r) SELECT cohort, gene, count(*) AS n, round(avg(value), 4) AS mean FROM t WHERE gene IN (SELECT gene FROM t GROUP BY gene HAVING count(DISTINCT cohort) = 2) GROUP BY 1, 2")
def u2(v):
    return C.merge_cohorts({"A": v.assay_a, "R": v.assay_r}).groupBy("cohort", "gene").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("u3_a26_driver_enrichment", "WITH g AS (SELECT DISTINCT gene FROM assay), h AS (SELECT gene FROM g WHERE gene IN (SELECT gene FROM drug_dim)) SELECT (SELECT count(*) FROM h) AS n_hits, round(CAST((SELECT count(*) FROM h) AS DOUBLE) / (SELECT count(*) FROM g), 6) AS enrichment, (SELECT string_agg(gene, ',' ORDER BY gene) FROM h) AS hits")
def u3(v):
    genes = v.assay.select("gene").distinct()
    flagged = genes.join(v.drug_dim.select("gene").distinct().withColumn("hit", F.lit(True)), "gene", "left")
    hits = F.collect_set(F.when(F.col("hit"), F.col("gene")))
    return flagged.agg(F.count("hit").alias("n_hits"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("enrichment"), F.array_join(F.array_sort(hits), ",").alias("hits"))


@query("u5_exclusion", "SELECT gene FROM (SELECT DISTINCT gene FROM assay) EXCEPT SELECT gene FROM drug_dim")
def u5(v):
    return v.assay.select("gene").distinct().join(v.drug_dim, "gene", "left_anti")


@query("s11_multi_targets", "WITH e AS (SELECT trim(unnest(string_split(p_name, ' '))) AS target, p_brand AS drug, (l_quantity - 25) / 8 AS v FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT target, count(DISTINCT drug) AS n_drugs, round(avg(v), 5) AS mean_v FROM e WHERE target IS NOT NULL GROUP BY 1")
def s11(v):
    rows = v.lineitem.join(v.part, F.col("l_partkey") == F.col("p_partkey"))
    each = rows.select(F.explode(F.transform(F.split("p_name", " "), F.trim)).alias("target"), F.col("p_brand").alias("drug"), ((F.col("l_quantity") - 25) / 8).alias("v")).dropna()
    return each.groupBy("target").agg(F.count_distinct("drug").alias("n_drugs"), F.round(F.avg("v"), 5).alias("mean_v"))


@query("s12_majority_label", "WITH c AS (SELECT cell_line, tissue, count(*) AS n FROM dose_response GROUP BY 1, 2) SELECT cell_line, tissue AS label FROM (SELECT *, row_number() OVER (PARTITION BY cell_line ORDER BY n DESC, tissue) AS r FROM c) WHERE r = 1")
def s12(v):
    counts = v.dose_response.groupBy("cell_line", "tissue").agg(F.count(F.lit(1)).alias("n"))
    return C.first_per_key(counts, ["cell_line"], [F.desc("n"), F.col("tissue")]).select("cell_line", F.col("tissue").alias("label"))
