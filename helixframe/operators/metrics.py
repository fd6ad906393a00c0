"""Metrics over prediction, attribution, run-log and trajectory tables; folds, splits and resamples by hashed keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cohort import decision_quality
from .normalisation import quantile_cut
from .ranks import cumulative
from .scans import carried, discounted, previous
from .survival import normal_tail


def drift(reference: Column, mutant: Column) -> Column:
    """max(0, 1 - cosine)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), 1 - dot(reference, mutant) / F.greatest(F.sqrt(dot(reference, reference)) * F.sqrt(dot(mutant, mutant)), F.lit(1e-300)))


def drift_statistics(embeddings: DataFrame) -> DataFrame:
    """Per gene, over its mutants against the reference, the variant with the smallest ``variant_no``."""
    reference = embeddings.groupBy("gene").agg(F.min("variant_no").alias("_first"), F.min_by("embedding", "variant_no").alias("_ref"))
    mutants = embeddings.join(reference, "gene").where(F.col("variant_no") > F.col("_first"))
    each = mutants.select("gene", drift(F.col("_ref"), F.col("embedding")).alias("d"))
    return each.groupBy("gene").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.max("d").alias("max"), F.min("d").alias("min"))


def cohort_instability(stats: DataFrame) -> DataFrame:
    mean, std = F.avg("mean"), F.stddev_pop("mean")
    return stats.agg(mean.alias("mean"), std.alias("std"), F.max("mean").alias("max"), F.min("mean").alias("min"), (F.max("mean") - F.min("mean")).alias("range"), F.when(std < 1e-12, 0.0).otherwise(mean / std).alias("snr"))


def attribution_importance(attribution: DataFrame, k: int) -> DataFrame:
    """Mean and spread of the absolute attribution (averaged over classes) per feature; the k largest, ranked."""
    one = attribution.groupBy("sample_id", "feature").agg(F.avg(F.abs("value")).alias("a"))
    top = one.groupBy("feature").agg(F.avg("a").alias("mean_abs"), F.stddev_pop("a").alias("std_abs")).orderBy(F.desc("mean_abs"), "feature").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mean_abs"), "feature")))  # k rows


def pathway_attribution(importance: DataFrame, pathways: DataFrame) -> DataFrame:
    genes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("mean_abs")).alias("v"), F.col("feature").alias("g")))), lambda x: x["g"]), ",")
    return importance.join(pathways, importance["feature"] == pathways["gene"]).groupBy("pathway").agg(F.sum("mean_abs").alias("total"), F.count(F.lit(1)).alias("n_genes"), genes.alias("genes"))


def top_attributions(attribution: DataFrame, k: int) -> DataFrame:
    """The k largest of each sample, with rank and direction.

    Sizes are compared at twelve decimals of the sample's largest, so that equal means whose sums of doubles ran in
    different orders stand in the order of their features.
    """
    size, sample = F.abs("value"), W.partitionBy("sample_id")
    largest = F.max(F.when(size < float("inf"), size)).over(sample)
    rows = attribution.withColumn("_size", F.when(largest > 0, F.round(size / largest, 12)).otherwise(size))
    rows = rows.withColumn("rank", F.row_number().over(sample.orderBy(F.desc("_size"), "feature"))).where(F.col("rank") <= k)
    up = (F.col("value") >= 0) | (F.col("_size") == 0)
    return rows.withColumn("direction", F.when(up, "increases").otherwise("decreases")).drop("_size")


def ensemble_prediction(members: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per id and class: mean, population spread and percentile interval over the members."""
    interval = F.percentile("p", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    out = members.groupBy("id", "k").agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), interval.alias("_i"))
    return out.select("id", "k", "mean", "std", F.col("_i")[0].alias("low"), F.col("_i")[1].alias("high"))


def ensemble_decision(prediction: DataFrame, n_classes: int, threshold: float = 0.5) -> DataFrame:
    """Normalised entropy, confidence, most likely class (the first among equals) and decision quality."""
    h = -F.sum(F.col("mean") * F.log(F.col("mean") + 1e-10)) / math.log(n_classes)
    best = F.max(F.struct(F.col("mean"), (-F.col("k")).alias("m")))
    out = prediction.groupBy("id").agg(h.alias("entropy"), best.alias("_b")).select("id", "entropy", (1 - F.col("entropy")).alias("confidence"), (-F.col("_b.m")).alias("k"), F.col("_b.mean").alias("p"))
    return out.withColumn("decision", decision_quality(F.col("confidence"), F.col("p"), threshold))


def calibration_curve(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins [low, high): a probability of 1 is in none; empty bins have no row."""
    edges = F.array(*(F.lit(i / bins) for i in range(bins + 1)))
    place = F.size(F.filter(edges, lambda e: e <= F.col("p"))) - 1
    rows = predictions.withColumn("bin", place).where((F.col("bin") >= 0) & (F.col("bin") < bins))
    return rows.groupBy("bin").agg(F.round(F.avg("p"), 4).alias("mean_p"), F.round(F.avg("y"), 4).alias("fraction"), F.count(F.lit(1)).alias("count"))


def calibration_error(curve: DataFrame) -> DataFrame:
    return curve.agg((F.sum(F.col("count") * F.abs(F.col("mean_p") - F.col("fraction"))) / F.sum("count")).alias("ece"))


def classification_metrics(rows: DataFrame, by: list[str], truth: str = "y", predicted: str = "yhat") -> DataFrame:
    """Accuracy and weighted precision, recall, F1 and F2; a division by zero is 0.

    Each cell of truth and prediction is exploded into its two classes, so that predictions are made once: a union reads
    them twice where they need no shuffle that it could share.
    """
    cells = rows.groupBy(*by, truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("long")
    hit = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(none)
    each = cells.select(*by, F.inline(F.array(F.struct(F.col(truth).alias("c"), F.col("n").alias("support"), hit.alias("tp"), none.alias("pred")), F.struct(F.col(predicted).alias("c"), none.alias("support"), none.alias("tp"), F.col("n").alias("pred")))))
    per = each.groupBy(*by, "c").agg(F.sum("support").alias("s"), F.sum("tp").alias("tp"), F.sum("pred").alias("pr"))
    p, r = F.when(F.col("pr") > 0, F.col("tp") / F.col("pr")).otherwise(0.0), F.when(F.col("s") > 0, F.col("tp") / F.col("s")).otherwise(0.0)
    per = per.withColumns({"p": p, "r": r})
    f = lambda b: F.when(b * b * F.col("p") + F.col("r") > 0, (1 + b * b) * F.col("p") * F.col("r") / (b * b * F.col("p") + F.col("r"))).otherwise(0.0)
    mean = lambda c: F.sum(c * F.col("s")) / F.sum("s")
    return per.groupBy(*by).agg((F.sum("tp") / F.sum("s")).alias("accuracy"), mean(F.col("p")).alias("precision"), mean(F.col("r")).alias("recall"), mean(f(1)).alias("f1"), mean(f(2)).alias("f2"))


def roc_auc(rows: DataFrame, by: list[str], positive: str = "y", score: str = "p") -> DataFrame:
    """Rank statistic: share of (1, 0) pairs in order, ties half.  Null when a side is empty."""
    # Counts of each distinct score are all that the statistic needs.
    cells = rows.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(positive).alias("_p"))
    ranked = cumulative(cells, by, [score], ["_n"]).withColumn("_rank", F.col("before__n") + (F.col("_n") + 1) / 2)
    n1, n = F.sum("_p"), F.sum("_n")
    u = F.sum(F.col("_p") * F.col("_rank")) - n1 * (n1 + 1) / 2
    return ranked.groupBy(*by).agg(F.when((n1 > 0) & (n > n1), u / (n1 * (n - n1))).alias("auc"))


def one_vs_rest_auc(members: DataFrame, truth: DataFrame, score: str = "p") -> DataFrame:
    """Weighted by prevalence over the classes ``k`` of (id, k, score); ``truth`` is (id, c)."""
    rows = members.join(truth, "id").withColumn("y", (F.col("k") == F.col("c")).cast("int"))
    per = roc_auc(rows, ["k"], score=score).join(rows.groupBy("k").agg(F.avg("y").alias("w")), "k").where("auc IS NOT NULL")
    return per.agg((F.sum(F.col("auc") * F.col("w")) / F.sum("w")).alias("auc"))


def fold_summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    return metrics.agg(*(F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(f"{c}_mean") for c in columns), *(F.stddev_pop(F.nanvl(c, F.lit(None).cast("double"))).alias(f"{c}_std") for c in columns))


def stability(metrics: DataFrame, column: str) -> DataFrame:
    return metrics.agg((F.stddev_samp(column) / F.greatest(F.avg(column), F.lit(1e-10))).alias("stability"))


def mutual_information(rows: DataFrame, label: str, column: str, bins: int = 10) -> DataFrame:
    """In nats, between a label and the quantile bins of a column."""
    cells = quantile_cut(rows, column, bins, duplicates="drop").groupBy(label, "bin").agg(F.count(F.lit(1)).alias("n"))
    a, b, n = cells.groupBy(label).agg(F.sum("n").alias("na")), cells.groupBy("bin").agg(F.sum("n").alias("nb")), cells.agg(F.sum("n").alias("total"))
    joint = cells.join(a, label).join(b, "bin").join(F.broadcast(n))
    return joint.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))


def best_response(trajectory: DataFrame, by: list[str]) -> DataFrame:
    """Per subject: the lowest value (the earliest among equals), its time, and the change from the first value in %."""
    order = F.struct("ts", "value")
    out = trajectory.groupBy(*by).agg(F.min(order)["value"].alias("initial"), F.max(order)["value"].alias("final"), F.min(F.struct("value", "ts")).alias("_n"))
    change = (F.col("_n.value") - F.col("initial")) / F.greatest(F.col("initial"), F.lit(1.0)) * 100
    return out.select(*by, F.col("_n.ts").alias("best_ts"), F.col("_n.value").alias("nadir"), "initial", "final", change.alias("change"))


def response_percent(trajectory: DataFrame, by: list[str]) -> DataFrame:
    """Percent of the first value that is gone at each row, to two places; null where the first value isn't above 0."""
    first = trajectory.groupBy(*by).agg(F.min(F.struct("ts", "value"))["value"].alias("_first"))
    share = F.when(F.col("_first") > 0, (F.col("_first") - F.col("value")) / F.col("_first"))
    return trajectory.join(first, by).withColumn("response", _rounded(share * 100, 2)).drop("_first")


def _rounded(x: Column, digits: int) -> Column:
    """As SQL rounds doubles: a whole number of the digits' unit, without a way over the decimals that print ``x``."""
    return F.round(x * 10**digits) / 10**digits


def response_total(responses: DataFrame, by: list[str], most: int = 100_000) -> DataFrame:
    """(by, n, total): rows and sum of their responses, to one place; groups without a response are left out.

    Sums of responses end in x.x5 often, and the last bits of a sum of doubles then round it; they depend on the order
    of the additions, which is that of time.  Groups of more than ``most`` rows are added up in runs of time, so that no
    task holds a long trajectory.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    sizes = responses.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.min(at).alias("_from"), F.max(at).alias("_to"))
    place = F.floor(F.ceil(F.col("_rows") / most) * (at - F.col("_from")) / (F.col("_to") - F.col("_from")))
    run = F.when((F.col("_rows") > most) & (F.col("_to") > F.col("_from")), F.coalesce(place, F.lit(-1))).otherwise(0)
    runs = responses.join(sizes, by).withColumn("_run", run)

    def added(rows: DataFrame, group: list[str], order: list[str], column: str) -> DataFrame:
        own = W.partitionBy(*group).orderBy(*order)
        told = rows.select(*group, "_n", F.row_number().over(own).alias("_at"), F.sum(column).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_sum"))
        return told.groupBy(*group).agg(F.sum("_n").alias("_n"), F.max_by("_sum", "_at").alias("_sum"))

    each = added(runs.withColumn("_n", F.lit(1)), [*by, "_run"], ["ts", "value"], "response")
    out = added(each, by, ["_run"], "_sum").where("_sum IS NOT NULL")
    return out.select(*by, F.col("_n").alias("n"), _rounded(F.col("_sum"), 1).alias("total"))


def exposure(series: DataFrame, effect: Column) -> DataFrame:
    """Cmax, Cmin, Cavg, AUC24 and the effects at peak and trough over each subject's last day."""
    last = series.groupBy("subject").agg((F.max("t") - 1).alias("_from"))
    rows = series.join(last, "subject").where(F.col("t") >= F.col("_from")).withColumn("_e", effect)
    return rows.groupBy("subject").agg(F.max("c").alias("cmax"), F.min("c").alias("cmin"), F.avg("c").alias("cavg"), (F.avg("c") * 24).alias("auc24"), F.max_by("_e", "c").alias("effect_peak"), F.min_by("_e", "c").alias("effect_trough"))


def hysteresis(series: DataFrame, low: float, high: float, by: str = "subject", order: list[str] = ("ts", "ord"), quiet: float | None = None) -> DataFrame:
    """On (1) until below ``low``, then off (0) until above ``high``; starts on, also after more than ``quiet`` seconds
    without a row.  Rows map the switch to itself or to a constant, and such maps are composed by ranges."""
    signal = F.when(F.col("value") < low, 0).when(F.col("value") > high, 1)
    if quiet is not None:
        at = F.unix_micros(F.col(order[0]).cast("timestamp"))
        gaps = previous(series.withColumn("_at", at), [by], list(order), "_at", "_before")
        series = gaps.withColumn("_again", F.col("_at") - F.col("_before") > quiet * 1_000_000).drop("_at", "_before")
        signal = F.coalesce(signal, F.when(F.col("_again"), 1))
    told = carried(series.withColumn("_signal", signal), [by], list(order), "_signal", "on")
    return told.withColumn("on", F.coalesce("on", F.lit(1))).drop("_signal", "_again")


def returns_to_go(episodes: DataFrame, gamma: float, by: str = "episode", step: str = "t", reward: str = "r") -> DataFrame:
    """Adds ``g``, the discounted return from each step on; episodes of any length, steps are whole numbers."""
    return discounted(episodes, gamma, [by], step, reward, "g")


#: Pairs up to which the signed-rank law is exact, if no two differences tie.
EXACT_PAIRS = 50


def signed_rank_tail(n: Column, w: Column) -> Column:
    """P(W+ >= w) over all 2^n sign patterns of the ranks 1..n: rank by rank, the number of patterns with each sum."""
    zeros = lambda r: F.array_repeat(F.lit(0).cast("long"), r.cast("int"))
    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1).cast("long")), lambda c, r: F.zip_with(F.concat(c, zeros(r)), F.concat(zeros(r), c), lambda a, b: a + b))
    at_least = F.aggregate(F.slice(ways, w.cast("int") + 1, F.size(ways)), F.lit(0).cast("long"), lambda s, x: s + x)
    return at_least / F.pow(F.lit(2.0), n)


def wilcoxon(pairs: DataFrame, a: str = "a", b: str = "b", by: Sequence[str] = ()) -> DataFrame:
    """Signed ranks of a - b: n, W+, the one-sided normal approximation z of "greater", and p.

    p is exact up to ``EXACT_PAIRS`` differences without ties, else that of z.  Distinct absolute differences are
    counted, and the counts added up by ranges.  Without differences z and p are null; a group of ``by`` without any has
    no row.
    """
    d = pairs.select(*by, (F.col(a) - F.col(b)).alias("d")).where("d <> 0")
    cells = d.groupBy(*by, F.abs("d").alias("m")).agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col("d") > 0).cast("long")).alias("_p"))
    ranked = cumulative(cells, by, ["m"], ["_n"]).withColumn("_rank", F.col("before__n") + (F.col("_n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("_p") * F.col("_rank")), F.lit(0.0)).alias("w_plus"), F.max("_n").alias("_most"))
    n = F.col("n").cast("double")
    z = F.when(n > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    few = (F.col("_most") == 1) & (F.col("n") <= EXACT_PAIRS)
    exact = signed_rank_tail(F.when(few, F.col("n")).otherwise(1), F.when(few, F.col("w_plus")).otherwise(0))
    return sums.withColumn("z", z).withColumn("p", F.when(few, exact).otherwise(normal_tail("z"))).drop("_most")


# Folds and samples: a hash of the key takes the place of a random generator.


def hashed(*parts: Column | str) -> Column:
    """A number in [0, 1) from 32 bits of an MD5."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def stratified_folds(rows: DataFrame, k: int, key: str = "id", label: str = "y", seed: str = "0") -> DataFrame:
    """Fold numbers whose sizes differ by one at most within a class."""
    h = F.md5(F.concat(F.lit(seed), F.lit("|"), F.col(key).cast("string")).cast("binary"))
    placed = cumulative(rows.withColumns({"_h": h, "_one": F.lit(1)}), [label], ["_h", key], ["_one"])
    return placed.withColumn("fold", (F.col("before__one") % k).cast("int")).select(*rows.columns, "fold")


def repeated_folds(rows: DataFrame, k: int, repeats: int, key: str = "id", label: str = "y") -> DataFrame:
    out = None
    for r in range(repeats):
        one = stratified_folds(rows, k, key, label, str(r)).withColumn("repeat", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


def hold_out(rows: DataFrame, fraction: float = 0.3, key: str = "id", seed: str = "0") -> DataFrame:
    return rows.withColumn("is_test", hashed(seed, F.col(key)) >= 1 - fraction)


def subsample(rows: DataFrame, draws: int, fraction: float = 0.7, key: str = "id") -> DataFrame:
    each = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return each.where(hashed(F.col("draw"), F.col(key)) < fraction)


def bootstrap_weights(rows: DataFrame, draws: int, fraction: float = 0.8, key: str = "id", label: str = "y") -> DataFrame:
    """How often each row is in each resample with replacement: Poisson(fraction) counts by hash, so that rows are
    drawn where they are; a class that a draw has missed gets its row with the smallest hash."""
    each = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_h", hashed("b", F.col("draw"), F.col(key)))
    steps, total, p = [], 0.0, math.exp(-fraction)
    for n in range(8):
        total += p
        steps.append(total)
        p *= fraction / (n + 1)
    count = sum((F.when(F.col("_h") >= s, 1).otherwise(0) for s in steps[1:]), F.when(F.col("_h") >= steps[0], 1).otherwise(0))
    each = each.withColumn("times", count)
    met = each.groupBy("draw", label).agg(F.sum("times").alias("_t"), F.min(F.struct("_h", key)).alias("_first"))
    fixed = each.join(met, ["draw", label]).withColumn("times", F.when((F.col("_t") == 0) & (F.col(key) == F.col(f"_first.{key}")), 1).otherwise(F.col("times")))
    return fixed.where("times > 0").drop("_h", "_t", "_first")
