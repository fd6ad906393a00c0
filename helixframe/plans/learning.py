"""Queries of classifiers (M1-M10, M12 with a fitted model): rows without SQL, but for label codes."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import boosting, companion, components
from ..operators import cohort as C
from ..operators import learning as L
from ..operators import metrics as M
from ..sources.scratch import written
from .base import query
from .metrics import embeddings, rounded

GENES = [f"G{i}" for i in range(40)]


def rows(v, assay=None):
    return written(L.training_rows(L.wide(assay or v.assay, GENES), v.labels_s), "rows")


@query("m1a_label_codes", "SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code, label AS decoded, count(*) AS n FROM labels_s GROUP BY 1")
def m1a(v):
    coded = L.encoded(v.labels_s)
    names = [r["label"] for r in coded.select("label", "code").distinct().orderBy("code").collect()]  # a row per class
    return L.decoded(coded.withColumn("prediction", F.col("code").cast("double")), names).groupBy("label", "code", "decoded").agg(F.count(F.lit(1)).alias("n"))


@query("m1_m2_w13_importances")
def m1(v):
    return L.importances(L.forest().fit(rows(v)), GENES, v.spark, 10)


@query("m1b_estimator_pipeline")
def m1b(v):
    """Training accuracy of assembly and forest as one estimator, over genes and row features."""
    data, extra = rows(v), C.row_features(v.assay)
    names = [c for c in extra.columns if c != "sample_id"]
    both = written(data.join(extra.select("sample_id", array_to_vector(F.array(*names)).alias("extra")), "sample_id"), "both")
    fitted = L.estimator_pipeline(["features", "extra"], L.forest()).fit(both)
    right = (F.col("prediction") == F.col("label")).cast("int")
    return fitted.transform(both).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 4).alias("accuracy"))


@query("m9_row_features")
def m9(v):
    assay = written(v.assay, "assay")
    data, full = rows(v, assay), written(L.with_row_features(assay, v.labels_s, GENES), "full")
    out = L.compared({"genes and rows": (full, L.forest()), "genes": (data, L.forest())}, "genes and rows", *L.plan_of(data))
    return rounded(out.join(F.broadcast(L.row_feature_use(assay, v.labels_s, GENES, full))))


@query("m3_cross_validation")
def m3(v):
    data = rows(v)
    folds, repeats = L.plan_of(data)
    scores = L.fold_metrics(L.cross_validated(data, L.forest(), folds, repeats))
    return rounded(M.fold_summary(scores, ["accuracy", "precision", "recall", "f1", "f2"])).withColumns({"folds": F.lit(folds), "repeats": F.lit(repeats)})


@query("m1_early_stopping")
def m1_early(v):
    """How many rounds each class's ensemble kept, of 12, and the loss over all rows."""
    data = rows(v)
    model = L.boosted(12).fit(data)
    loss = model.log_loss(data)
    kept = [(int(c), r, loss) for c, r in zip(model.classes, model.rounds, strict=True)]
    return rounded(v.spark.createDataFrame(kept, "code int, rounds int, log_loss double"))


@query("m4_search")
def m4(v):
    """Nine points of nine parameters, on a ninth, a third and all of the rows."""
    return rounded(boosting.searched(rows(v), boosting.random_points(9)))


@query("m5_baselines")
def m5(v):
    data = rows(v)
    return rounded(L.compared({n: (data, m) for n, m in L.baselines().items()}, "forest", *L.plan_of(data)))


@query("m6_ablation")
def m6(v):
    full, half = rows(v), written(L.training_rows(L.wide(v.assay, GENES[:20]), v.labels_s), "half")
    even = full.withColumn("weight", F.lit(1.0))
    return rounded(L.compared({"full": (full, L.forest()), "half the genes": (half, L.forest()), "no class weights": (even, L.forest()), "shallow": (full, L.forest(depth=2))}, "full", *L.plan_of(full)))


@query("m7_bootstrap_ensemble")
def m7(v):
    return rounded(M.ensemble_decision(M.ensemble_prediction(L.bootstrap_ensemble(rows(v))), 5))


@query("m8_principal_components")
def m8(v):
    """The first two components of all genes (their sign is free), with the shares of all variance."""
    scores, variances = components.principal_components(v.assay, 2)
    return scores.select("sample_id", *(F.round(F.abs(F.col("components")[i]), 4).alias(f"pc{i + 1}") for i in range(2)), *(F.lit(round(s, 6)).alias(f"share{i + 1}") for i, (_, s) in enumerate(variances)))


@query("m9a_fusion_weights")
def m9a(v):
    emb = written(embeddings(v), "embeddings")
    genes = v.assay.select("gene").distinct()
    model = L.forest().fit(rows(v))
    weights = {
        "importance": L.importances(model, GENES, v.spark, len(GENES)).select("gene", F.col("importance").alias("weight")),
        "uniform": genes.withColumn("weight", F.lit(1.0 / len(GENES))),
        "random": genes.withColumn("weight", M.hashed("w", F.col("gene"))),
    }
    arms = {n: (written(L.fused_rows(v.assay, GENES, emb, v.labels_s, w), "fused"), L.forest()) for n, w in weights.items()}
    return rounded(L.compared(arms, "importance", 5))


@query("m9b_parameter_sweep")
def m9b(v):
    data = rows(v)
    arms = {f"depth={d}": (data, L.forest(depth=d)) for d in (2, 4, 6)}
    arms |= {f"trees={t}": (data, L.forest(trees=t)) for t in (10, 40)}
    arms |= {f"rate={r}": (data, L.boosted(rate=r)) for r in (0.1, 0.5)}
    out = L.compared(arms, "depth=4", 3)
    return rounded(out.withColumns({"parameter": F.substring_index("variant", "=", 1), "setting": F.substring_index("variant", "=", -1).cast("double")}).drop("variant"))


@query("m9b_synergy")
def m9b_synergy(v):
    emb, ones = written(embeddings(v), "embeddings"), v.assay.select("gene").distinct().withColumn("weight", F.lit(1.0))
    full = L.with_row_features(v.assay, v.labels_s, GENES)
    fused = L.fused_rows(v.assay, GENES, emb, v.labels_s, ones)
    join = full.withColumnRenamed("features", "_r").join(L.embedded_rows(v.assay, emb, v.labels_s).select("sample_id", F.col("features").alias("_z")), "sample_id")
    both = L.estimator_pipeline(["_r", "_z"], L.forest()).getStages()[0].transform(join).withColumnRenamed("all", "features")
    arms = {"neither": rows(v), "row features": written(full, "full"), "embedding": written(fused, "fused"), "both": written(both.select("sample_id", "features", "label", "weight", "id"), "both")}
    return rounded(L.synergy(L.compared({n: (r, L.forest()) for n, r in arms.items()}, "neither", 5), "neither", "row features", "embedding", "both"))


@query("m10_hold_out")
def m10(v):
    return rounded(M.classification_metrics(L.held_out(rows(v), L.forest()), ["fold"])).drop("fold")


@query("a37_refit_stability")
def a37(v):
    """How far accuracy and F1 move when the forest is fitted anew on 70 % of the samples."""
    return rounded(L.refit_stability(rows(v), L.forest()))


@query("m12_fitted_fusion")
def m12(v):
    """The flagship: fit, projection, cross-validation, ranking, and annotations of the ranked genes."""
    ranked = L.fitted_fusion(v.assay, v.labels_s, embeddings(v), M.drift_statistics(embeddings(v)))
    told = companion.annotations(ranked, v.drug_dim, v.pathway_dim, C.symmetric(v.sl_dim), v.resistance_dim)
    return rounded(told).orderBy(F.desc("fusion_index"), "gene")
