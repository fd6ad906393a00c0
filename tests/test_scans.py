"""Long sequences, hot values, exact signed ranks and wide projections against plain loops and numpy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import components, scans
from helixframe.operators import metrics as M
from helixframe.operators import normalisation as N


def loop(rewards, gamma):
    out, g, last = {}, 0.0, None
    for t in sorted(rewards, reverse=True):
        g = rewards[t] + (gamma ** (last - t) * g if last is not None else 0.0)
        out[t], last = g, t
    return out


@pytest.mark.parametrize("gamma", [0.0, 0.5, 0.9, 0.9999, 1.0])
def test_returns_equal_a_loop(spark, gamma):
    r = random.Random(1)
    episodes = {e: {t: r.gauss(0, 1) for t in r.sample(range(5, 40 * e * e + 10), 3 * e * e)} for e in range(1, 12)}
    rows = [(e, t, x) for e, own in episodes.items() for t, x in own.items()]
    got = M.returns_to_go(spark.createDataFrame(rows, "episode int, t long, r double"), gamma).collect()
    want = {(e, t): g for e, own in episodes.items() for t, g in loop(own, gamma).items()}
    assert len(got) == len(want) and all(x["g"] == pytest.approx(want[x["episode"], x["t"]], rel=1e-9, abs=1e-9) for x in got)


def test_an_episode_of_a_million_steps(spark):
    n, gamma = 1_000_000, 0.9
    rows = spark.range(n).select(F.lit(1).alias("episode"), F.col("id").alias("t"), (F.sin("id") + 1).alias("r"))
    got = M.returns_to_go(rows, gamma).where("t % 99991 = 0 OR t > 999990").collect()
    g, want = 0.0, {}
    for t in range(n - 1, -1, -1):
        g = math.sin(t) + 1 + gamma * g
        if t % 99991 == 0 or t > 999990:
            want[t] = g
    assert {x["t"]: pytest.approx(x["g"], rel=1e-12) for x in got} == want
    with pytest.raises(ValueError):
        M.returns_to_go(rows, 1.5)


def switched(rows, low, high, quiet=None):
    on, before, out = {}, {}, {}
    for s, ts, o, v in sorted(rows):
        if quiet is not None and s in before and ts - before[s] > quiet:
            on[s] = 1
        before[s] = ts
        on[s] = 0 if v < low else 1 if v > high else on.get(s, 1)
        out[s, o] = on[s]
    return out


@pytest.mark.parametrize("quiet", [None, 40])
def test_switches_of_long_subjects(spark, quiet):
    r = random.Random(2)
    rows = [(min(s, 3), 1_000_000 + r.randint(0, 900), o, r.choice([10.0, 40.0, 40.0, 40.0, 40.0, 70.0])) for o, s in enumerate(r.choices(range(12), k=600))]
    df = spark.createDataFrame(rows, "subject int, s long, ord int, value double").withColumn("ts", F.timestamp_seconds("s"))
    got = M.hysteresis(df.repartition(7), 20, 60, quiet=quiet)
    assert got.columns == [*df.columns, "on"] and {(x["subject"], x["ord"]): x["on"] for x in got.collect()} == switched(rows, 20, 60, quiet)


def test_carried_over_ranges_without_a_value(spark):
    df = spark.range(2000).select(F.lit("a").alias("k"), "id", F.when(F.col("id") == 3, F.lit(5)).alias("c"))
    got = scans.carried(df, ["k"], ["id"], "c", "last").groupBy("last").count().collect()
    assert {(x["last"], x["count"]) for x in got} == {(None, 3), (5, 1997)}
    assert scans.previous(df, ["k"], ["id"], "id", "p").where("p = id - 1").count() == 1999


def test_quantiles_of_a_hot_value(spark):
    n = 10_000_000
    hot = spark.range(n).select(F.col("id").alias("sample_id"), F.lit("zero").alias("gene"), F.lit(0.0).alias("value"))
    ramp = spark.createDataFrame([(i, "ramp", float(i)) for i in range(1000)], "sample_id long, gene string, value double")
    got = {(x["gene"], x["value"]): x["count"] for x in N.quantile_normalise(hot.union(ramp)).groupBy("gene", "value").count().collect()}
    assert got.pop(("zero", 0.0)) == n  # the mean of both genes' smallest values
    assert got == {("ramp", i / 2): 1 for i in range(1000)}


def test_quantiles_equal_numpy(spark):
    r = random.Random(4)
    cells = lambda genes, n, top: [(i, g, float(r.randint(0, top))) for g in genes for i in range(n)]
    source, reference = cells("abc", 40, 12), cells("bcd", 25, 9)
    frame = lambda rows: spark.createDataFrame(rows, "sample_id long, gene string, value double")
    column = lambda rows, g: sorted(v for _, k, v in rows if k == g)
    means = np.mean([column(source, g) for g in "abc"], axis=0)
    want = {(i, g): means[sum(x < v for x in column(source, g))] for i, g, v in source}
    assert {(x["sample_id"], x["gene"]): pytest.approx(x["value"]) for x in N.quantile_normalise(frame(source)).collect()} == want
    means = np.mean([column(reference, g) for g in "bc"], axis=0)
    want = {(i, g): means[min(24, sum(x < v for x in column(source, g)))] for i, g, v in source if g != "a"}
    assert {(x["sample_id"], x["gene"]): pytest.approx(x["value"]) for x in N.quantile_normalise_to(frame(source), frame(reference)).collect()} == want


def test_rows_need_a_batch(spark):
    rows = spark.createDataFrame([("s", "g", 1.0, None), ("t", "g", 2.0, "b")], "sample_id string, gene string, value double, batch string")
    with pytest.raises(Exception, match="needs a batch"):
        N.combat(rows).collect()


def test_signed_rank_law_equals_all_sign_patterns(spark):
    for d in ([1.0, 2, 3, 4, 5], [-1.0, 2, 3, -4, 5, 6, -7], [0.5, -0.25, 0.125]):
        ranks = {x: i + 1 for i, x in enumerate(sorted(map(abs, d)))}
        w = sum(ranks[x] for x in d if x > 0)
        every = [sum(i + 1 for i, s in enumerate(signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
        row = M.wilcoxon(spark.createDataFrame([(float(x), 0.0) for x in [*d, 0.0]], "a double, b double")).first()
        assert (row["n"], row["w_plus"]) == (len(d), w) and row["p"] == sum(s >= w for s in every) / len(every)
    row = M.wilcoxon(spark.createDataFrame([(float(i), 0.0) for i in range(1, 51)], "a double, b double")).first()
    assert row["p"] == 2.0**-50
    tied = M.wilcoxon(spark.createDataFrame([(1.0, 0.0)] * 5, "a double, b double")).first()
    assert tied["p"] == pytest.approx(0.0216, abs=1e-3)
    assert M.wilcoxon(spark.createDataFrame([(1.0, 1.0)], "a double, b double")).first()["p"] is None


@pytest.mark.parametrize("n,d,k", [(30, 12, 2), (90, 700, 50), (300, 150, 3)])
def test_components_of_a_long_table_equal_numpy(spark, monkeypatch, n, d, k):
    monkeypatch.setattr(components, "BLOCK", 64)
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, d)) * np.linspace(3, 0.5, d) + rng.standard_normal((n, 4)) @ rng.standard_normal((4, d)) * 3 + 5
    cells = [(i, f"g{j}", float(x[i, j])) for i in range(n) for j in range(d) if (i * d + j) % 17]
    for i in range(n):
        for j in range(d):
            if not (i * d + j) % 17:
                x[i, j] = 0.0
    scores, variances = components.principal_components(spark.createDataFrame(cells, "sample_id long, gene string, value double"), k)
    got = {r["sample_id"]: r["components"] for r in scores.collect()}
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    want = np.abs(u[:, :k] * s[:k])
    assert np.allclose(np.abs([got[i] for i in range(n)]), want, atol=1e-5 * want.max())
    assert np.allclose([v for v, _ in variances], s[:k] ** 2 / (n - 1), rtol=1e-9) and np.allclose([p for _, p in variances], s[:k] ** 2 / (s**2).sum(), rtol=1e-9)


def test_components_of_degenerate_tables(spark):
    kind = "sample_id long, gene string, value double"
    assert components.principal_components(spark.createDataFrame([], kind), 2)[0].count() == 0
    scores, variances = components.principal_components(spark.createDataFrame([(i, g, 1.0) for i in range(5) for g in "ab"], kind), 9)
    assert variances == [] and {tuple(r["components"]) for r in scores.collect()} == {()}
    scores, variances = components.principal_components(spark.createDataFrame([(i, g, float(i)) for i in range(5) for g in "ab"] + [(1, "a", None)], kind), 9)
    assert len(variances) == 1 and variances[0][1] == pytest.approx(1)
