"""Kaplan-Meier estimates and the log-rank test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalisation import quantile_cut
from .ranks import cumulative


def split_arms(df: DataFrame, gene: str, time: str = "time", event: str = "event") -> DataFrame:
    """Adds ``arm``: low or high, by the median of ``gene``."""
    missing = [c for c in (gene, time, event) if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return quantile_cut(df, gene, 2).withColumn("arm", F.when(F.col("bin") == 0, "low").otherwise("high")).drop("bin")


def kaplan_meier(df: DataFrame, by: str = "arm", time: str = "time", event: str = "event") -> DataFrame:
    """(by, time, n_at_risk, n_events, survival) at each distinct time; subjects are counted by time first."""
    counts = df.groupBy(by, F.col(time).alias("time")).agg(F.sum(event).alias("n_events"), F.count(F.lit(1)).alias("_n"))
    risk = cumulative(counts, [by], ["time"], ["_n"]).withColumn("n_at_risk", F.col("all__n") - F.col("before__n"))
    # A product as a sum of logarithms; from the first time when all at risk have the event, it is 0.
    gone = F.col("n_events") >= F.col("n_at_risk")
    risk = risk.withColumns({"_step": F.when(gone, 0.0).otherwise(F.log(1 - F.col("n_events") / F.col("n_at_risk"))), "_gone": gone.cast("int")})
    rows = cumulative(risk.select(by, "time", "n_at_risk", "n_events", "_step", "_gone"), [by], ["time"], ["_step", "_gone"])
    alive = F.exp(F.col("before__step") + F.col("_step"))
    return rows.select(by, "time", "n_events", "n_at_risk", F.when(F.col("before__gone") + F.col("_gone") > 0, 0.0).otherwise(alive).alias("survival"))


def median_survival(curve: DataFrame, by: str = "arm") -> DataFrame:
    return curve.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("time"))), F.lit(float("inf"))).alias("median"))


def log_rank(df: DataFrame, by: str = "arm", first: str = "low", time: str = "time", event: str = "event") -> DataFrame:
    """One row: observed and expected events of the first arm, variance, chi2 and p."""
    a = F.when(F.col(by) == first, 1).otherwise(0)
    counts = df.groupBy(F.col(time).alias("time")).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("n1"), F.sum(event).alias("d"), F.sum(F.col(event) * a).alias("d1"))
    risk = cumulative(counts, [], ["time"], ["n", "n1"]).select("d", "d1", (F.col("all_n") - F.col("before_n")).alias("n"), (F.col("all_n1") - F.col("before_n1")).alias("n1")).where("d > 0")
    expected = F.col("d") * F.col("n1") / F.col("n")
    variance = F.when(F.col("n") > 1, expected * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    sums = risk.agg(F.sum("d1").alias("observed"), F.sum(expected).alias("expected"), F.sum(variance).alias("variance"))
    chi2 = F.when(F.col("variance") > 0, F.pow(F.col("observed") - F.col("expected"), F.lit(2)) / F.col("variance")).otherwise(0.0)
    return sums.withColumn("chi2", chi2).withColumn("p", chi2_tail("chi2"))


@F.pandas_udf(T.DoubleType())
def chi2_tail(chi2: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return pd.Series(erfc(np.sqrt(chi2.to_numpy(float) / 2)))


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal distribution."""
    z = z.to_numpy(float)
    half = erfc(np.abs(z) / np.sqrt(2)) / 2
    return pd.Series(np.where(z >= 0, half, 1 - half))


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t."""
    t, d = t.to_numpy(float), df.to_numpy(float)
    ok = (d > 0) & ~np.isnan(t)
    out = np.full(len(t), np.nan)
    out[ok] = _beta(d[ok] / (d[ok] + t[ok] ** 2), d[ok] / 2, np.full(ok.sum(), 0.5))
    return pd.Series(out)


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of numbers >= 0: its power series below 2.5, a continued fraction from there."""
    small = np.minimum(x, 2.5)
    term, total = small.copy(), small.copy()
    for n in range(1, 80):
        term = -term * small * small / n
        total = total + term / (2 * n + 1)
    large = np.maximum(x, 2.5)
    part = large.copy()
    for n in range(120, 0, -1):
        part = large + n / 2 / part
    return np.where(x < 2.5, 1 - 2 / np.sqrt(np.pi) * total, np.exp(-large * large) / (np.sqrt(np.pi) * part))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of few distinct numbers."""
    distinct, at = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in distinct])[at]


def _beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction evaluated from the end."""
    swap = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    inside = (y > 0) & (y < 1)
    z = np.where(inside, y, 0.5)
    fraction = np.ones(len(x))
    for m in range(200, 0, -1):
        fraction = 1 - (p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)) / fraction
        fraction = 1 + m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)) / fraction
    fraction = 1 - (p + q) * z / (p + 1) / fraction
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    value = np.where(inside, front / fraction, y >= 1)
    return np.where(swap, 1 - value, value)
