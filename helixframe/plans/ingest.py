"""Queries of readers and writers (S1-S17, A46).  Files are written from the tables first, then read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import readers as R
from ..sources.scratch import shared_folder
from .base import query


def _path(v, name):
    return f"{shared_folder(v.spark)}/files-{uuid.uuid4().hex[:10]}/{name}"


@query("s1_s10_read_maf", "SELECT gene AS Hugo_Symbol, variant_class AS Variant_Classification, count(*) AS n, CAST(sum(t_alt_count) AS BIGINT) AS alt, count(*) FILTER (t_ref_count = 100) AS n_ref FROM variants GROUP BY 1, 2")
def s1(v):
    path = _path(v, "maf")
    named = {"gene": "Hugo_Symbol", "variant_class": "Variant_Classification", "sample_id": "Tumor_Sample_Barcode", "t_alt_count": "t_alt_count", "t_ref_count": "t_ref_count", "ord": "Extra"}
    R.rename_mutations(v.variants, named).write.csv(path, sep="\t", header=True)
    rows = R.read_maf(v.spark, path)
    return rows.groupBy("Hugo_Symbol", "Variant_Classification").agg(F.count(F.lit(1)).alias("n"), F.sum("t_alt_count").alias("alt"), F.sum((F.col("t_ref_count") == 100).cast("int")).alias("n_ref"))


@query("s2_read_cna", "SELECT gene, s AS sample_id, CAST(avg(score) AS DOUBLE) AS score FROM (SELECT gene, concat('S', CAST(sample_id % 5 AS VARCHAR)) AS s, score FROM cna) GROUP BY 1, 2")
def s2(v):
    path = _path(v, "cna")
    names = [f"S{i}" for i in range(5)]
    wide = v.cna.withColumn("s", F.concat(F.lit("S"), (F.col("sample_id") % 5).cast("string"))).groupBy("gene").pivot("s", names).agg(F.avg("score"))
    wide.write.csv(path, sep="\t", header=True)
    return R.read_cna(v.spark, path)


@query("s3_read_methylation", "SELECT probe, s AS sample_id, round(avg(beta), 5) AS beta FROM (SELECT probe, concat('S', CAST(sample_id % 5 AS VARCHAR)) AS s, beta FROM methylation) GROUP BY 1, 2")
def s3(v):
    path = _path(v, "methylation")
    v.methylation.withColumn("s", F.concat(F.lit("S"), (F.col("sample_id") % 5).cast("string"))).groupBy("probe").pivot("s", [f"S{i}" for i in range(5)]).agg(F.avg("beta")).write.csv(path, sep="\t", header=True)
    return R.read_methylation(v.spark, path).withColumn("beta", F.round("beta", 5))


@query("s4_read_cohort", "SELECT label, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM labels_s JOIN supplier ON sample_id = s_suppkey GROUP BY 1")
def s4(v):
    data, labels = _path(v, "data"), _path(v, "labels")
    v.supplier.select(F.monotonically_increasing_id().alias("Unnamed: 0"), F.col("s_suppkey").alias("sample_id"), "s_acctbal").write.csv(data, header=True)
    v.labels_s.select("sample_id", F.lit("x").alias("other"), F.col("label").alias("Class")).write.csv(labels, header=True)
    return R.read_cohort(v.spark, data, labels).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("s5_read_dose_response", "SELECT drug AS DRUG_NAME, count(*) AS n, round(avg(ln_ic50), 5) AS mean, count(*) FILTER (false) AS n_auc FROM dose_response GROUP BY 1")
def s5(v):
    path = _path(v, "dose")
    v.dose_response.select(F.col("cell_line").cast("string").alias("CELL_LINE_NAME"), F.col("drug").alias("DRUG_NAME"), F.col("ln_ic50").alias("LN_IC50"), F.lit(float("nan")).alias("AUC")).write.parquet(path)
    return R.read_dose_response(v.spark, path).groupBy("DRUG_NAME").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("LN_IC50"), 5).alias("mean"), F.count("AUC").alias("n_auc"))


@query("s6_table_cache", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def s6(v):
    cache = R.TableCache(v.spark, _path(v, "cache"))
    cache.save("flags", v.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n")))
    if not cache.has("flags") or cache.has("other"):
        raise RuntimeError("the cache lost a table")
    return cache.load("flags")


@query("s7_read_patients", "SELECT CAST(sample_id AS VARCHAR) AS patient_id, count(*) AS n_mutations, count(DISTINCT gene) AS n_genes FROM variants GROUP BY 1")
def s7(v):
    from ..operators.companion import explode_profiles

    path = _path(v, "patients")
    mutations = F.collect_list(F.struct("gene", F.col("variant_class").alias("variant"), F.lit(None).cast("double").alias("vaf")))
    v.variants.groupBy(F.col("sample_id").cast("string").alias("patient_id")).agg(mutations.alias("mutations")).withColumn("cna", F.create_map(F.lit("MYC"), F.lit(0.8))).groupBy(F.pmod(F.xxhash64("patient_id"), F.lit(8)).alias("part")).agg(F.to_json(F.collect_list(F.struct("patient_id", "mutations", "cna")), {"pretty": "true"}).alias("value")).write.partitionBy("part").text(path)
    variants, _ = explode_profiles(R.read_patients(v.spark, path))
    return variants.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_mutations"), F.count_distinct("gene").alias("n_genes"))


@query("s8_pivot_values", "SELECT user_id AS sample_id, coalesce(arg_min(value, event_id) FILTER (event_type = 'click'), 0.0::DOUBLE) AS click, coalesce(arg_min(value, event_id) FILTER (event_type = 'view'), 0.0::DOUBLE) AS view FROM events GROUP BY 1")
def s8(v):
    rows = v.events.select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("gene"), "value", F.col("event_id").alias("ord"))
    return R.pivot_values(rows, ["click", "view"])


@query("s9_pivot_clinical", "SELECT o_orderkey AS patient_id, o_totalprice AS price, CASE WHEN o_orderstatus = 'F' THEN 'DECEASED' ELSE 'LIVING' END AS status FROM orders")
def s9(v):
    o = v.orders
    rows = o.select(F.col("o_orderkey").alias("patient_id"), F.lit("PRICE").alias("attribute"), F.col("o_totalprice").cast("string").alias("value"))
    rows = rows.union(o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("OS_STATUS"), F.lit("DECEASED")))
    return R.pivot_clinical(rows, {"PRICE": "price"}, {"OS_STATUS": "status"})


@query("s13_write_read_csv", "SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def s13(v):
    path = _path(v, "csv")
    R.write_table(v.part.select("p_brand", "p_retailprice"), path)
    rows = v.spark.read.csv(path, header=True, schema="p_brand string, p_retailprice double")
    return rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


def _page():
    """Documents come in pages, as from the services: one page has the rows of 10,000 part keys at most."""
    return F.floor(F.col("p_partkey") / 10_000).alias("page")


@query("s15_flatten_targets", "SELECT p_brand AS gene, count(*) AS n, round(max(p_size / 50.0::DOUBLE), 4) AS overall, count(DISTINCT p_type) AS n_diseases FROM part GROUP BY 1")
def s15(v):
    rows = F.collect_list(F.struct((F.col("p_size") / 50.0).alias("score"), F.struct(F.col("p_type").alias("name")).alias("disease")))
    tract = F.array(F.struct(F.lit("small molecule").alias("label"), F.lit(True).alias("value")))
    docs = v.part.groupBy(F.col("p_brand").alias("approvedSymbol"), _page()).agg(F.struct(rows.alias("rows")).alias("associatedDiseases")).drop("page").withColumn("tractability", tract)
    flat = R.flatten_targets(docs.select(F.to_json(F.struct("*")).alias("json")))
    return flat.groupBy("gene").agg(F.count("disease").alias("n"), F.round(F.max("overall"), 4).alias("overall"), F.count_distinct("disease").alias("n_diseases"))


@query("s16_flatten_civic", "SELECT p_brand AS gene, p_type AS variant, count(*) AS n, min(p_name) AS first FROM part GROUP BY 1, 2")
def s16(v):
    item = F.struct(F.lit("B").alias("evidenceLevel"), F.lit("Sensitivity").alias("significance"), F.array(F.struct(F.col("p_name").alias("name"))).alias("therapies"))
    variants = v.part.groupBy("p_brand", "p_type", _page()).agg(F.collect_list(item).alias("items")).select("p_brand", "page", F.struct(F.col("p_type").alias("name"), F.struct(F.col("items").alias("nodes")).alias("evidenceItems")).alias("v"))
    genes = variants.groupBy("p_brand", "page").agg(F.collect_list("v").alias("vs"))
    node = F.struct(F.col("p_brand").alias("name"), F.struct(F.col("vs").alias("nodes")).alias("variants"))
    docs = genes.select(F.to_json(F.struct(F.array(node, node).alias("nodes"))).alias("json"))
    return R.flatten_civic(docs).groupBy("gene", "variant").agg(F.count(F.lit(1)).alias("n"), F.min(F.get("therapies", F.lit(0))).alias("first"))


@query("s17_flatten_trials", "SELECT CAST(o_orderkey AS VARCHAR) AS nct_id, '' AS title, o_orderstatus AS status, 1 AS n_phases, 0 AS n_conditions, o_orderpriority AS phase FROM orders")
def s17(v):
    section = F.struct(F.struct(F.col("o_orderkey").cast("string").alias("nctId")).alias("identificationModule"), F.struct(F.col("o_orderstatus").alias("overallStatus")).alias("statusModule"), F.struct(F.array("o_orderpriority").alias("phases")).alias("designModule"))
    flat = R.flatten_trials(v.orders.select(F.to_json(F.struct(section.alias("protocolSection"))).alias("json")))
    return flat.select("nct_id", "title", "status", F.size("phases").alias("n_phases"), F.size("conditions").alias("n_conditions"), F.get("phases", F.lit(0)).alias("phase"))


@query("a46_evidence_score", "WITH g AS (SELECT DISTINCT gene FROM assay), o AS (SELECT gene, round(avg(p_size) / 50.0::DOUBLE, 2) AS overall FROM (SELECT concat('G', CAST(p_partkey % 25 AS VARCHAR)) AS gene, p_size FROM part) GROUP BY 1), c AS (SELECT gene, count(*) AS n_items FROM drug_dim GROUP BY 1), t AS (SELECT gene, count(*) AS n_trials FROM resistance_dim GROUP BY 1) SELECT g.gene, coalesce(overall, 0.0::DOUBLE) AS overall, coalesce(n_items, 0) AS n_items, coalesce(n_trials, 0) AS n_trials, round(0.4::DOUBLE * coalesce(overall, 0) + 0.3::DOUBLE * least(coalesce(n_items, 0) / 10.0::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * least(coalesce(n_trials, 0) / 10.0::DOUBLE, 1.0::DOUBLE), 4) AS evidence FROM g LEFT JOIN o USING (gene) LEFT JOIN c USING (gene) LEFT JOIN t USING (gene)")
def a46(v):
    targets = v.part.groupBy(F.concat(F.lit("G"), (F.col("p_partkey") % 25).cast("string")).alias("gene")).agg(F.round(F.avg("p_size") / 50.0, 2).alias("overall"))
    count = lambda df, name: df.groupBy("gene").agg(F.count(F.lit(1)).alias(name))
    return R.evidence_score(v.assay.select("gene").distinct(), targets, count(v.drug_dim, "n_items"), count(v.resistance_dim, "n_trials"))
