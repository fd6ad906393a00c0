"""Correlation screens and weighted embedding sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normalisation import average_rank
from .survival import t_tail


#: Sums over samples, of a target's values x and another gene's values y.
SUMS = ("n", "x", "y", "xx", "yy", "xy")
#: Samples that are multiplied as one block.
SAMPLES = 512


def _products(rows: DataFrame, targets: list[str]) -> DataFrame:
    """(target, gene, n, x, y, xx, yy, xy) for blocks of samples: matrix products over the values that both genes have,
    so that a block gives one row for each pair, not one for each sample."""

    def block(parts: list[pd.DataFrame]) -> pd.DataFrame:
        wide = pd.concat(parts).pivot_table(index="sample_id", columns="gene", values="value")
        left = [g for g in targets if g in wide.columns]
        right = [g for g in wide.columns if g not in own]
        x, y = wide[left].to_numpy(float), wide[right].to_numpy(float)
        mx, my = (~np.isnan(m) * 1.0 for m in (x, y))
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        values = {"n": mx.T @ my, "x": x.T @ my, "y": mx.T @ y, "xx": (x * x).T @ my, "yy": mx.T @ (y * y), "xy": x.T @ y}
        out = pd.DataFrame({"target": np.repeat(np.array(left, object), len(right)), "gene": np.tile(np.array(right, object), len(left)), **{k: v.ravel() for k, v in values.items()}})
        return out[out["n"] > 0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        samples, last = 0, None
        for frame in frames:
            if not len(frame):
                continue
            ids = frame["sample_id"]
            samples += int((ids != ids.shift()).sum()) - int(ids.iloc[0] == last)
            last = ids.iloc[-1]
            held.append(frame)
            if samples > SAMPLES:
                # Rows come sorted, so only the last sample may go on in the next frame.
                both = pd.concat(held)
                open_ = both["sample_id"] == last
                yield block([both[~open_]])
                held, samples = [both[open_]], 1
        if held:
            yield block(held)

    own = frozenset(targets)
    dealt = rows.where(F.col("value").isNotNull()).select("sample_id", "gene", F.col("value").cast("double").alias("value")).repartition("sample_id").sortWithinPartitions("sample_id")
    return dealt.mapInPandas(run, "target string, gene string, " + ", ".join(f"{c} double" for c in SUMS))


def lethality_screen(assay: DataFrame, targets: DataFrame, known: DataFrame, below: float = -0.5, method: str = "spearman", least: int = 3, with_p: bool = False) -> DataFrame:
    """Correlation of each target gene with every other gene over the samples that have both.

    Spearman ranks are taken per gene once.  Targets are an explicit list, so pairs grow as targets x genes; samples are
    multiplied in blocks.
    """
    rows = assay
    if method == "spearman":
        rows = average_rank(assay, "value", ["gene"]).select("sample_id", "gene", F.col("rank").alias("value"))
    names = sorted(r["gene"] for r in targets.select("gene").distinct().collect())  # the explicit list
    sums = _products(rows, names).groupBy("target", "gene").agg(*(F.sum(c).alias(c) for c in SUMS))
    spread = (F.col("n") * F.col("xx") - F.col("x") ** 2) * (F.col("n") * F.col("yy") - F.col("y") ** 2)
    corr = F.when(spread > 0, (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread))
    pairs = sums.select("target", "gene", corr.alias("correlation"), F.col("n").cast("long").alias("n")).where((F.col("n") >= least) & (F.round("correlation", 9) < below))
    flag = known.select(F.col("gene").alias("target"), F.col("partner").alias("gene")).distinct().withColumn("known_sl", F.lit(True))
    out = pairs.join(flag, ["target", "gene"], "left").fillna(False, ["known_sl"])
    if with_p:
        t = F.col("correlation") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("correlation") ** 2, F.lit(1e-300)))
        out = out.withColumn("p", t_tail(t, (F.col("n") - 2).cast("double")))
    return out


def embedding_sum(assay: DataFrame, embeddings: DataFrame, weights: DataFrame | None = None, normalise: bool = True) -> DataFrame:
    """(sample_id, dim, z): sum over genes of value (times weight) times embedding; each sample's vector of norm 1.

    A gene with several vectors takes part with their mean."""
    rows = assay if weights is None else assay.join(weights, "gene").withColumn("value", F.col("value") * F.col("weight"))
    dims = embeddings.select("gene", F.posexplode("embedding").alias("dim", "e")).groupBy("gene", "dim").agg(F.avg(F.col("e").cast("double")).alias("e"))
    z = rows.join(dims, "gene").groupBy("sample_id", "dim").agg(F.sum(F.col("value") * F.col("e").cast("double")).alias("z"))
    if not normalise:
        return z
    norm = z.groupBy("sample_id").agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("_n"))
    return z.join(norm, "sample_id").select("sample_id", "dim", (F.col("z") / F.when(F.col("_n") < 1e-10, 1.0).otherwise(F.col("_n"))).alias("z"))
