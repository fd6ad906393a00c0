"""Filters, joins and summaries of cohort tables: dose response, variants, expression, copy number, clinical data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import quantiles

GENE_SYMBOL = "^[A-Z][A-Z0-9/-]*$"
# Variant classes by impact.
HIGH_IMPACT = ("Nonsense_Mutation", "Frame_Shift_Del", "Frame_Shift_Ins", "Splice_Site", "Translation_Start_Site", "Nonstop_Mutation")
MODERATE_IMPACT = ("Missense_Mutation", "In_Frame_Del", "In_Frame_Ins")
LOW_IMPACT = ("Silent", "RNA", "Intron", "3'UTR", "5'UTR", "IGR", "3'Flank", "5'Flank")


# Column expressions


def impact(variant_class: Column) -> Column:
    return F.when(variant_class.isin(*HIGH_IMPACT), "HIGH").when(variant_class.isin(*MODERATE_IMPACT), "MODERATE").when(variant_class.isin(*LOW_IMPACT), "LOW").otherwise("MODIFIER")


def allele_fraction(alt: Column, ref: Column) -> Column:
    """alt / (alt + ref); unreadable counts are 0, and so is the fraction without reads."""
    a, r = F.coalesce(alt.try_cast("double"), F.lit(0.0)), F.coalesce(ref.try_cast("double"), F.lit(0.0))
    return F.when(a + r > 0, a / (a + r)).otherwise(0.0)


def response_class(change: Column) -> Column:
    return F.when(change <= -99, "CR").when(change <= -30, "PR").when(change >= 20, "PD").otherwise("SD")


def decision_quality(confidence: Column, p: Column, threshold: float = 0.5) -> Column:
    return F.when((confidence >= 0.8) & (p >= 0.7), "HIGH").when((confidence >= 0.6) & (p >= 0.5), "MODERATE").when(confidence >= threshold, "LOW").otherwise("UNCERTAIN")


def priority(score: Column) -> Column:
    return F.when(score >= 0.75, "HIGH").when(score >= 0.5, "MEDIUM").otherwise("LOW")


def active_day(day: Column, start: Column, duration: Column, on: Column, off: Column) -> Column:
    """A dosing day: not before the start, within the duration, in the on phase of on/off cycles (on 0: always)."""
    since = day - start
    return (since >= 0) & (since < duration) & ((on <= 0) | (F.pmod(since, F.greatest(on + off, F.lit(1))) < on))


def emax_effect(c: Column, emax: Column, ec50: Column, hill: Column) -> Column:
    return F.when(c <= 0, 0.0).otherwise(emax * F.pow(c, hill) / (F.pow(ec50, hill) + F.pow(c, hill)))


# Filters


def drug_sensitivity(df: DataFrame, drug: str, tissue: str | None = None) -> DataFrame:
    found = F.coalesce(F.col("drug").rlike(f"(?i){drug}"), F.lit(False))
    if tissue is not None:
        found &= F.coalesce(F.col("tissue").rlike(f"(?i){tissue}"), F.lit(False))
    return df.where(found)


def resistant(df: DataFrame, above: float = 2.0) -> DataFrame:
    return df.where(F.col("ln_ic50") > above)


def sensitive(df: DataFrame, below: float = -1.0) -> DataFrame:
    return df.where(F.col("ln_ic50") < below)


def patient_subset(tables: dict[str, DataFrame], patients: DataFrame, cancer_type: str, key: str = "patient_id") -> dict[str, DataFrame]:
    chosen = patients.where(F.col("cancer_type") == cancer_type).select(key)
    return {name: df.join(chosen, key, "left_semi") for name, df in tables.items()}


def gene_symbols(df: DataFrame, gene: str = "gene", pattern: str = GENE_SYMBOL) -> DataFrame:
    """Rows whose gene looks like a symbol; all rows if none does."""
    ok = F.coalesce(F.col(gene).rlike(pattern), F.lit(False))
    some = df.agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("_some"))
    return df.join(F.broadcast(some)).where(ok | ~F.col("_some")).drop("_some")


def covered_genes(df: DataFrame, least: int = 10, gene: str = "gene", value: str = "value") -> DataFrame:
    genes = df.groupBy(gene).agg(F.sum(F.when(F.col(value) != 0, 1).otherwise(0)).alias("n")).where(F.col("n") >= least)
    return gene_symbols(df.join(genes.select(gene), gene, "left_semi"), gene)


# Joins and sets


def training_matrix(dose: DataFrame, expression: DataFrame) -> DataFrame:
    """Cell lines labelled 1 (sensitive) or 0 (resistant), with the expression of those that have any."""
    labelled = sensitive(dose).select("cell_line", F.lit(1).alias("label")).unionByName(resistant(dose).select("cell_line", F.lit(0).alias("label")))
    return labelled.join(expression, labelled["cell_line"] == expression["sample_id"]).drop("sample_id")


def with_default(df: DataFrame, dim: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join of a dimension; ``defaults`` where it has no row."""
    joined = df.join(dim, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def symmetric(pairs: DataFrame, a: str = "gene_a", b: str = "gene_b") -> DataFrame:
    same = pairs.select(F.col(a).alias("gene"), F.col(b).alias("partner"))
    return same.unionByName(pairs.select(F.col(b).alias("gene"), F.col(a).alias("partner"))).distinct()


def merge_cohorts(cohorts: dict[str, DataFrame], gene: str = "gene") -> DataFrame:
    """Rows of all cohorts over the genes that each of them has, tagged by cohort."""
    tagged = None
    for name, df in cohorts.items():
        one = df.withColumn("cohort", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    common = tagged.groupBy(gene).agg(F.count_distinct("cohort").alias("n")).where(F.col("n") == len(cohorts)).select(gene)
    return tagged.join(common, gene, "left_semi")


# Aggregations


def mutation_counts(variants: DataFrame) -> DataFrame:
    return variants.groupBy("gene").agg(F.count(F.lit(1)).alias("n_mutations"))


def mutation_burden(variants: DataFrame) -> DataFrame:
    return variants.groupBy("sample_id").agg(F.count(F.lit(1)).alias("tmb"))


def mutation_features(variants: DataFrame) -> DataFrame:
    vaf = allele_fraction(F.col("t_alt_count"), F.col("t_ref_count"))
    return variants.groupBy("gene").agg(
        F.count(F.lit(1)).alias("mut_count"), F.sum(F.when(impact(F.col("variant_class")) == "HIGH", 1).otherwise(0)).alias("high_count"), F.coalesce(F.round(F.avg(vaf), 6), F.lit(0.0)).alias("mean_vaf")
    )


def cna_summary(cna: DataFrame) -> DataFrame:
    amp, dele = F.sum(F.when(F.col("score") >= 2, 1).otherwise(0)), F.sum(F.when(F.col("score") <= -2, 1).otherwise(0))
    n = F.count("score")
    return cna.groupBy("gene").agg(amp.alias("amplifications"), dele.alias("deletions"), F.round(amp / n, 6).alias("amp_freq"), F.round(dele / n, 6).alias("del_freq"))


def methylation_summary(methylation: DataFrame) -> DataFrame:
    return methylation.groupBy(F.col("probe").alias("gene")).agg(F.round(F.avg("beta"), 6).alias("meth_mean"), F.round(F.var_samp("beta"), 6).alias("meth_var"))


def differential_methylation(methylation: DataFrame, labels: DataFrame) -> DataFrame:
    by_group = methylation.join(labels, "sample_id").groupBy("probe", "label").agg(F.avg("beta").alias("m"))
    return by_group.groupBy("probe").agg(F.round(F.avg("m"), 5).alias("mean"), F.round(F.var_samp("m"), 5).alias("var"), F.round(F.max("m") - F.min("m"), 5).alias("delta"))


def omics_features(genes: DataFrame, variants: DataFrame, cna: DataFrame, methylation: DataFrame) -> DataFrame:
    out = genes.join(mutation_features(variants), "gene", "left").join(cna_summary(cna), "gene", "left").join(methylation_summary(methylation), "gene", "left")
    return out.fillna(0, ["mut_count", "high_count", "mean_vaf", "amplifications", "deletions", "amp_freq", "del_freq"])


def mutation_enrichment(variants: DataFrame, groups: DataFrame, cube: bool = False) -> DataFrame:
    """Share of each group's samples that carry a mutation of the gene; ``cube`` adds the margins."""
    sizes = groups.groupBy("grp").agg(F.count_distinct("sample_id").alias("n_patients"))
    carried = variants.select("sample_id", "gene").distinct().join(groups, "sample_id")
    if cube:
        return carried.cube("gene", "grp").agg(F.count_distinct("sample_id").alias("n_mutated"))
    counts = carried.groupBy("gene", "grp").agg(F.count_distinct("sample_id").alias("k"))
    return counts.join(sizes, "grp").select("gene", "grp", F.round(F.col("k") / F.col("n_patients"), 4).alias("frequency"), "n_patients")


def mutation_frequency(variants: DataFrame, n_patients: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct carriers of each gene over all patients (``n_patients``: one row, column n)."""
    carriers = F.approx_count_distinct("sample_id") if approx else F.count_distinct("sample_id")
    return variants.groupBy("gene").agg(carriers.alias("k")).join(F.broadcast(n_patients)).select("gene", F.round(F.col("k") / F.col("n"), 6).alias("frequency"))


def driver_profile(drivers: DataFrame, variants: DataFrame, n_patients: DataFrame) -> DataFrame:
    return drivers.join(mutation_frequency(variants, n_patients), "gene", "left").fillna(0.0, ["frequency"])


def survival_by_mutation(clinical: DataFrame, mutated: Column) -> DataFrame:
    """One row: patients and exact median time of each arm, and the ratio of the medians."""
    arms = clinical.select(F.coalesce(mutated, F.lit(False)).alias("_arm"), "time").where("time IS NOT NULL")
    mid = quantiles(arms, "time", [0.5], ["_arm"]).select("_arm", F.col("quantiles")[0].alias("_m"))
    both = arms.groupBy("_arm").agg(F.count(F.lit(1)).alias("_n")).join(mid, "_arm")
    pick = lambda c, arm: F.max(F.when(F.col("_arm") == arm, F.col(c)))
    out = both.agg(F.coalesce(pick("_n", True), F.lit(0)).alias("n_mut"), F.coalesce(pick("_n", False), F.lit(0)).alias("n_wt"), pick("_m", True).alias("m"), pick("_m", False).alias("w"))
    return out.select("n_mut", "n_wt", F.round("m", 1).alias("median_mut"), F.round("w", 1).alias("median_wt"), F.round(F.col("m") / F.greatest(F.col("w"), F.lit(0.1)), 3).alias("ratio"))


def median_label(clinical: DataFrame) -> DataFrame:
    mid = quantiles(clinical, "time", [0.5]).select(F.col("quantiles")[0].alias("_m"))
    return clinical.join(F.broadcast(mid)).withColumn("label", (F.col("time") < F.col("_m")).cast("int")).drop("_m")


def row_features(assay: DataFrame) -> DataFrame:
    """Distribution of each sample's values: population moments, linear percentiles."""
    pct = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    flat = F.stddev_pop("value") < 1e-12
    mean, std = F.avg("value"), F.stddev_pop("value")
    spread = F.when(flat, 1.0).otherwise(std)
    out = assay.groupBy("sample_id").agg(
        mean.alias("mean"), std.alias("std"), F.when(flat, 0.0).otherwise(F.skewness("value")).alias("skew"), F.when(flat, -3.0).otherwise(F.kurtosis("value")).alias("kurt"),
        F.max("value").alias("max"), F.min("value").alias("min"), pct.alias("_q"), (spread / F.when(F.abs(mean) < 1e-12, 1.0).otherwise(F.abs(mean))).alias("cv"),
    )
    return out.select(
        "sample_id", *(F.round(c, 4).alias(c) for c in ("mean", "std", "skew", "kurt", "max", "min", "cv")),
        F.round(F.col("max") - F.col("min"), 4).alias("range"), F.round(F.col("_q")[1], 4).alias("median"), F.round(F.col("_q")[2] - F.col("_q")[0], 4).alias("iqr"),
    )


def class_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    total = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.join(F.broadcast(total)).select(label, F.round(F.col("n") / (F.col("k") * F.col("n_c")), 6).alias("weight"))


def with_class_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``n_class``: counted once per class and joined back, so that no task holds a class."""
    return df.join(df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class")), label)


def merge_rare(df: DataFrame, least: int, label: str = "label", drop_small_rest: bool = False) -> DataFrame:
    """Classes under ``least`` rows become OTHER; with ``drop_small_rest`` OTHER goes if it is small itself."""
    out = with_class_sizes(df, label).withColumn(label, F.when(F.col("n_class") < least, "OTHER").otherwise(F.col(label))).drop("n_class")
    if drop_small_rest:
        out = with_class_sizes(out, label).where((F.col(label) != "OTHER") | (F.col("n_class") >= least)).drop("n_class")
    return out


def large_classes(df: DataFrame, folds: int, label: str = "label") -> DataFrame:
    return with_class_sizes(df, label).where(F.col("n_class") >= folds).drop("n_class")


def variance_filter(assay: DataFrame, q: float = 0.25) -> DataFrame:
    var = assay.groupBy("gene").agg(F.var_samp("value").alias("v"))
    cut = var.agg(F.percentile("v", F.lit(q)).alias("cut"))
    return assay.join(var.join(F.broadcast(cut)).where("v >= cut").select("gene"), "gene", "left_semi")


def top_variance_genes(assay: DataFrame, n: int, drivers: DataFrame) -> DataFrame:
    """The n most variable genes and the drivers that are measured."""
    var = assay.groupBy("gene").agg(F.var_samp("value").alias("v"))
    top = var.orderBy(F.desc("v"), "gene").limit(n).select("gene")
    return top.union(var.join(drivers, "gene", "left_semi").select("gene")).distinct()


def pathway_summary(genes: DataFrame, pathways: DataFrame) -> DataFrame:
    return genes.select("gene").distinct().join(pathways, "gene").groupBy("pathway").agg(F.count_distinct("gene").alias("n_genes"), F.array_join(F.array_sort(F.collect_set("gene")), ",").alias("genes"))


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
