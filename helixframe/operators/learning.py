"""Classifiers on Spark ML: fits, folds, baselines, ablations, ensembles, projections.

Wide vectors are made for a listed set of genes only.  A model is any ``pyspark.ml`` estimator with the columns
features, label and weight.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from . import cohort, components, metrics
from .boosting import PARALLEL, ClassBoosting


#: Cells of a task and of a file of training rows (a file is below Spark's least split, so that none is cut), and fits
#: that run at a time while a task or two hold all rows.
CELLS, FILE_CELLS, AT_ONCE = 4_000_000, 400_000, 12


def forest(trees: int = 20, depth: int = 4, seed: int = 1) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)


def boosted(rounds: int = 10, depth: int = 3, rate: float = 0.3, seed: int = 1) -> ClassBoosting:
    return ClassBoosting(rounds, depth, rate, seed=seed)


def baselines() -> dict[str, object]:
    return {
        "logistic": LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=30, regParam=0.01),
        "forest": forest(),
        "svm": OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01), featuresCol="features", labelCol="label", weightCol="weight", parallelism=4),
        "boosted": boosted(),
    }


def encoded(labels: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``code``: the place of the label in alphabetical order."""
    model = StringIndexer(inputCol=label, outputCol="_code", stringOrderType="alphabetAsc").fit(labels)
    return model.transform(labels).withColumn("code", F.col("_code").cast("int")).drop("_code")


def decoded(codes: DataFrame, names: list[str], code: str = "prediction") -> DataFrame:
    return IndexToString(inputCol=code, outputCol="decoded", labels=names).transform(codes)


def wide(assay: DataFrame, genes: list[str]) -> DataFrame:
    """(sample_id, x): values of the listed genes in their order, 0 where there is none.

    A dictionary table numbers the genes; each sample's (number, mean) pairs become one vector.
    """
    places = assay.sparkSession.createDataFrame(list(zip(genes, range(len(genes)), strict=True)), "gene string, at int")
    means = assay.join(F.broadcast(places), "gene").groupBy("sample_id", "at").agg(F.avg("value").alias("v"))
    maps = means.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("_m"))
    return maps.select("sample_id", F.transform(F.sequence(F.lit(0), F.lit(len(genes) - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0))).alias("x"))


def training_rows(features: DataFrame, labels: DataFrame) -> DataFrame:
    """sample_id, features (of the array x), label (code), weight (balanced), id."""
    coded = encoded(labels)
    weighted = coded.join(F.broadcast(cohort.class_weights(coded)), "label").select("sample_id", F.col("code").cast("double").alias("label"), "weight")
    return features.join(weighted, "sample_id").select("sample_id", array_to_vector("x").alias("features"), "label", "weight", F.col("sample_id").alias("id"))


def with_row_features(assay: DataFrame, labels: DataFrame, genes: list[str]) -> DataFrame:
    """Genes and the distribution features of each sample in one vector."""
    rows = cohort.row_features(assay)
    more = rows.select("sample_id", F.array(*(F.col(c) for c in rows.columns if c != "sample_id")).alias("_r"))
    return training_rows(wide(assay, genes).join(more, "sample_id").select("sample_id", F.concat("x", "_r").alias("x")), labels)


def estimator_pipeline(columns: list[str], model: object) -> Pipeline:
    """Assembly of vectors or numbers, and classifier, as one estimator."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="all"), model.copy({model.featuresCol: "all"})])


def importances(model: object, names: list[str], spark, k: int) -> DataFrame:
    """(gene, importance, rank) of a fitted tree ensemble; the features are a listed set."""
    values = sorted(zip(names, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]
    return spark.createDataFrame([(g, v, i + 1) for i, (g, v) in enumerate(values)], "gene string, importance double, rank int")


def plan_of(rows: DataFrame) -> tuple[int, int]:
    """Folds and repeats: five folds, three times from 200 rows on."""
    return 5, 3 if rows.count() >= 200 else 1


@dataclass
class Folds:
    """Training rows with ``_fold0``, ``_fold1``, ... (a column per repeat), and the fits that may run at a time.

    Fits read ``rows``, in few tasks; ``spread`` are the same rows in as many tasks as Spark makes of them, for passes
    that are made once.
    """

    rows: DataFrame
    spread: DataFrame
    folds: int
    repeats: int
    at_once: int


def with_folds(rows: DataFrame, folds: int = 5, repeats: int = 1) -> Folds:
    """Folds of rows that are written once for all fits, and read by as few tasks as hold them.

    Fits are thousands of short jobs, so that fits beside each other, not tasks of one fit, keep small tables' machines
    busy; the more tasks a fit has, the fewer fits run, as each holds its rows.
    """
    out = rows.withColumnRenamed("label", "y")
    for r in range(repeats):
        out = metrics.stratified_folds(out, folds, seed=str(r)).withColumnRenamed("fold", f"_fold{r}")
    size = rows.agg(F.count(F.lit(1)), F.max(F.size(vector_to_array("features")))).first()
    cells = size[0] * (size[1] or 1)
    tasks = max(1, -(-cells // CELLS))
    laid = out.withColumnRenamed("y", "label").repartition(max(1, -(-cells // FILE_CELLS)), "id").sortWithinPartitions("id")
    split = written(laid, "split")
    return Folds(split.coalesce(tasks), split, folds, repeats, max(PARALLEL, min(AT_ONCE, 2 * AT_ONCE // tasks)))


def predicted(split: Folds, model: object, pool: ThreadPoolExecutor) -> DataFrame:
    """Predictions of held-out folds: (repeat, fold, id, y, yhat)."""

    def one(place: tuple[int, int]) -> DataFrame:
        repeat, fold = place
        aside = F.col(f"_fold{repeat}") == fold
        fitted = model.fit(split.rows.where(~aside))
        told = fitted.transform(split.spread.where(aside))
        return told.select(F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), "id", F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("yhat"))

    return reduce(DataFrame.unionByName, pool.map(one, itertools.product(range(split.repeats), range(split.folds))))


def cross_validated(rows: DataFrame, model: object, folds: int = 5, repeats: int = 1) -> DataFrame:
    """Predictions of held-out folds: (repeat, fold, id, y, yhat)."""
    split = with_folds(rows, folds, repeats)
    with ThreadPoolExecutor(split.at_once) as pool:
        return predicted(split, model, pool)


def fold_metrics(predictions: DataFrame) -> DataFrame:
    return metrics.classification_metrics(predictions, ["repeat", "fold"])


def compared(variants: dict[str, tuple[DataFrame, object]], base: str, folds: int = 5, repeats: int = 1) -> DataFrame:
    """Per variant (rows and model): mean and spread of its metrics over the same folds, the differences in F1 and
    accuracy to ``base``, and z and p (exact for so few folds) of the paired signed-rank tests that ``base`` is better.

    Variants of the same rows whose models have the same ``key`` are fitted once.  All variants and both measures are
    tested in one plan, by groups.
    """
    splits = {id(rows): rows for rows, _ in variants.values()}
    splits = {key: with_folds(rows, folds, repeats) for key, rows in splits.items()}

    alike: dict[tuple, list[str]] = {}
    for name, (rows, model) in variants.items():
        alike.setdefault((id(rows), getattr(model, "key", id(model))), []).append(name)

    def run(names: list[str]) -> DataFrame:
        rows, model = variants[names[0]]
        told = fold_metrics(predicted(splits[id(rows)], model, fits))
        return written(told.withColumn("variant", F.explode(F.array(*map(F.lit, names)))), "folds")

    with ThreadPoolExecutor(min(s.at_once for s in splits.values())) as fits, ThreadPoolExecutor(len(alike)) as pool:
        runs = written(reduce(DataFrame.unionByName, pool.map(run, alike.values())), "runs")
    best = runs.where(F.col("variant") == base).select("repeat", "fold", F.col("f1").alias("_f1"), F.col("accuracy").alias("_accuracy"))
    pairs = runs.join(F.broadcast(best), ["repeat", "fold"], "left")
    means = pairs.groupBy("variant").agg(
        *(f(c).alias(f"{c}{s}") for c in ("accuracy", "f1") for f, s in ((F.avg, ""), (F.stddev_pop, "_std"))), F.count(F.lit(1)).alias("n_folds"),
        *(F.avg(F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in ("f1", "accuracy")),
    )
    both = pairs.select("variant", F.inline(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(f"_{c}").alias("a"), F.col(c).alias("b")) for c in ("f1", "accuracy")))))
    tests = metrics.wilcoxon(both, by=["variant", "measure"]).groupBy("variant")
    tests = tests.agg(*(F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}{end}") for m, end in (("f1", ""), ("accuracy", "_accuracy")) for c in ("z", "p")))
    columns = ["variant", "accuracy", "accuracy_std", "f1", "f1_std", "n_folds", "delta_f1", "z", "p", "delta_accuracy", "z_accuracy", "p_accuracy"]
    return means.join(F.broadcast(tests), "variant", "left").select(*columns)


def synergy(compared_: DataFrame, neither: str, a: str, b: str, both: str) -> DataFrame:
    """One row: gains in F1 of both components and of each alone over neither, and what both give beyond their sum."""
    pick = lambda v: F.max(F.when(F.col("variant") == v, F.col("f1")))
    row = compared_.agg(*(pick(v).alias(c) for v, c in ((neither, "n"), (a, "a"), (b, "b"), (both, "ab"))))
    return row.select((F.col("ab") - F.col("n")).alias("gain_both"), (F.col("a") - F.col("n")).alias("gain_a"), (F.col("b") - F.col("n")).alias("gain_b"), (F.col("ab") - F.col("a") - F.col("b") + F.col("n")).alias("synergy"))


def row_feature_use(assay: DataFrame, labels: DataFrame, genes: list[str], full: DataFrame | None = None) -> DataFrame:
    """One row: mean mutual information of the row features with the label, and the share of them that a forest over
    genes and row features (``full``, if they are there) uses."""
    features = cohort.row_features(assay)
    names = [c for c in features.columns if c != "sample_id"]
    told = written(features.join(labels.select("sample_id", "label"), "sample_id"), "features")
    with ThreadPoolExecutor(PARALLEL) as pool:
        info = reduce(DataFrame.unionByName, pool.map(lambda c: metrics.mutual_information(told.where(F.col(c).isNotNull()), "label", c), names))
    model = forest().fit(written(with_row_features(assay, labels, genes), "full") if full is None else full)
    used = sum(1 for x in model.featureImportances.toArray()[len(genes) :] if x > 0) / len(names)
    return info.agg(F.avg("mi").alias("information")).withColumn("used", F.lit(float(used)))


def bootstrap_ensemble(rows: DataFrame, members: int = 3, model: Callable[[int], object] = lambda i: forest(seed=i)) -> DataFrame:
    """Member probabilities (id, m, k, p) of models fitted on resamples, whose counts weigh the rows."""
    drawn = metrics.bootstrap_weights(rows.withColumnRenamed("label", "y"), members).withColumnRenamed("y", "label")
    out = None
    for m in range(members):
        sample = drawn.where(F.col("draw") == m).withColumn("weight", F.col("weight") * F.col("times"))
        p = model(m).fit(sample).transform(rows).select("id", F.posexplode(vector_to_array("probability")).alias("k", "p")).withColumn("m", F.lit(m))
        out = p if out is None else out.unionByName(p)
    return out


def principal_components(rows: DataFrame, k: int = 2, features: str = "features") -> tuple[DataFrame, list[tuple[float, float]]]:
    """((sample_id, components), [(variance, share)]) of feature vectors; see ``components``."""
    long = rows.select("sample_id", F.posexplode(vector_to_array(features)).alias("dim", "value"))
    return components.principal_components(long, k, gene="dim")


def held_out(rows: DataFrame, model: object) -> DataFrame:
    """(y, yhat) of a hashed hold-out."""
    split = metrics.hold_out(rows)
    return model.fit(split.where("NOT is_test")).transform(split.where("is_test")).select(F.lit(0).alias("fold"), F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("yhat"))


def refit_stability(rows: DataFrame, model: object, draws: int = 5, fraction: float = 0.7) -> DataFrame:
    """One row: mean accuracy and F1 of models fitted on ``draws`` hashed subsamples, each judged by the rows it hasn't
    seen, and the stability coefficients of both (spread over mean)."""
    drawn = written(metrics.subsample(rows, draws, fraction).select("draw", "id"), "draws")

    def one(d: int) -> DataFrame:
        mine = drawn.where(F.col("draw") == d).select("id")
        got = model.fit(rows.join(mine, "id", "left_semi")).transform(rows.join(mine, "id", "left_anti"))
        return got.select(F.lit(d).alias("draw"), F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("yhat"))

    with ThreadPoolExecutor(PARALLEL) as pool:
        judged = reduce(DataFrame.unionByName, pool.map(one, range(draws)))
    each = written(metrics.classification_metrics(judged, ["draw"]), "stability")
    parts = [metrics.stability(each, c).select(F.col("stability").alias(f"{c}_stability")) for c in ("accuracy", "f1")]
    means = each.agg(F.avg("accuracy").alias("accuracy"), F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("draws"))
    return means.join(F.broadcast(parts[0])).join(F.broadcast(parts[1]))


def embedded(assay: DataFrame, embeddings: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(sample_id, z): ``screens.embedding_sum`` as one vector of norm 1 per sample.

    A row per sample and gene goes through one grouping, instead of a row per sample, gene and dimension through three.
    Each task has the genes' mean vectors; dimensions that a gene's vector lacks are 0.
    """
    listed = embeddings if weights is None else embeddings.join(weights.select("gene"), "gene", "left_semi")
    dims = listed.select("gene", F.posexplode("embedding").alias("dim", "e")).groupBy("gene", "dim").agg(F.avg(F.col("e").cast("double")).alias("e"))
    held = dims.groupBy("gene").agg(F.collect_list(F.struct("dim", F.coalesce("e", F.lit(0.0)).alias("e"))).alias("v")).orderBy("gene").collect()
    matrix = np.zeros((len(held), max((d for r in held for d, _ in r["v"]), default=-1) + 1))
    for i, r in enumerate(held):
        for d, e in r["v"]:
            matrix[i, d] = e
    places = assay.sparkSession.createDataFrame([(r["gene"], i) for i, r in enumerate(held)], "gene string, at int")
    rows = assay if weights is None else assay.join(F.broadcast(weights.select("gene", F.col("weight").alias("_w"))), "gene").withColumn("value", F.col("value") * F.col("_w"))
    told = rows.join(F.broadcast(places), "gene").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v")))).alias("_m"))
    flat = told.select("sample_id", F.col("_m.at").alias("at"), F.col("_m.v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 1_000_000 // max(*matrix.shape, 1))
        for batch in (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step)):
            at, v = batch["at"], batch["v"]
            x = np.zeros((batch.num_rows, len(matrix)))
            np.add.at(x, (np.repeat(np.arange(batch.num_rows), at.value_lengths().to_numpy()), at.flatten().to_numpy()), v.flatten().to_numpy())
            z = x @ matrix
            norm = np.sqrt((z * z).sum(1))
            z /= np.where(norm < 1e-10, 1.0, norm)[:, None]
            offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            yield pa.RecordBatch.from_arrays([batch["sample_id"], pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], ["sample_id", "z"])

    return flat.mapInArrow(run, T.StructType([flat.schema["sample_id"], T.StructField("z", T.ArrayType(T.DoubleType()))]))


def embedded_rows(assay: DataFrame, embeddings: DataFrame, labels: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Training rows whose features are the (weighted) embedding sums."""
    return training_rows(embedded(assay, embeddings, weights).withColumnRenamed("z", "x"), labels)


def fused_rows(assay: DataFrame, genes: list[str], embeddings: DataFrame, labels: DataFrame, weights: DataFrame) -> DataFrame:
    """Training rows of gene values and weighted embedding sums side by side."""
    z = embedded(assay, embeddings, weights)
    return training_rows(wide(assay, genes).join(z, "sample_id").select("sample_id", F.concat("x", "z").alias("x")), labels)


def fitted_fusion(assay: DataFrame, labels: DataFrame, embeddings: DataFrame, drift: DataFrame, k: int = 20, least: int = 5, parts: int = 8) -> DataFrame:
    """The end-to-end ranking: (gene, importance, instability, fusion_index, accuracy, accuracy_std), best first.

    Genes with a symbol's name; rare classes merged; a forest whose ``k`` largest importances choose the targets; the
    importance-weighted embedding sums, projected on their principal components, beside the gene values, cross-validated;
    and importance times instability (``drift``: gene, mean) as the index.
    """
    assay = written(cohort.gene_symbols(assay), "assay")
    labels = cohort.merge_rare(labels, least)
    genes = sorted(r["gene"] for r in assay.select("gene").distinct().collect())  # the columns of the matrix
    rows = written(training_rows(wide(assay, genes), labels), "rows")
    top = written(importances(forest().fit(rows), genes, assay.sparkSession, k), "importances")
    fused = written(embedded_rows(assay, embeddings, labels, top.select("gene", F.col("importance").alias("weight"))), "embedded")
    projected = principal_components(fused, parts)[0].withColumnRenamed("components", "_pc")
    both = written(rows.join(projected, "sample_id").select("sample_id", F.concat(vector_to_array("features"), "_pc").alias("x")), "fused")
    scores = fold_metrics(cross_validated(training_rows(both, labels), forest(), *plan_of(rows)))
    scores = scores.agg(F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("accuracy_std"))
    ranked = top.join(drift.select("gene", F.col("mean").alias("instability")), "gene", "left").fillna(0.0, ["instability"])
    ranked = ranked.withColumn("fusion_index", F.round(F.col("importance") * F.col("instability") * 1000, 4)).join(F.broadcast(scores))
    return ranked.drop("rank").orderBy(F.desc("fusion_index"), "gene")
