"""Exact properties of classifiers' helpers, ranks, tails and graph scores."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from helixframe.operators import learning as L
from helixframe.operators import metrics as M
from helixframe.operators import network as G
from helixframe.operators import ranks
from helixframe.operators import screens
from helixframe.operators import survival as S

GENES = [f"G{i}" for i in range(5)]


@pytest.fixture(scope="module")
def cohort(spark):
    r = random.Random(1)
    labels = [(i, "abc"[i % 3]) for i in range(45)]
    assay = [(i, g, r.gauss(0, 1) + (3 * (i % 3) if g == "G0" else 0)) for i, _ in labels for g in GENES]
    emb = [(g, k, [r.gauss(0, 1) for _ in range(4)]) for g in GENES for k in range(3)]
    return (
        spark.createDataFrame(assay, "sample_id long, gene string, value double"),
        spark.createDataFrame(labels, "sample_id long, label string"),
        spark.createDataFrame(emb, "gene string, variant_no int, embedding array<float>"),
    )


def test_folds_cover_every_row_once_and_metrics_follow(spark, cohort):
    assay, labels, _ = cohort
    rows = L.training_rows(L.wide(assay, GENES), labels)
    assert L.plan_of(rows) == (5, 1)
    out = [r.asDict() for r in L.cross_validated(rows, L.forest(5, 3), 5, 2).collect()]
    assert Counter((r["repeat"], r["id"]) for r in out) == {(k, i): 1 for k in range(2) for i in range(45)}
    sizes = Counter((r["repeat"], r["fold"], r["y"]) for r in out)
    assert set(sizes.values()) == {3}
    got = {(r["repeat"], r["fold"]): (r["accuracy"], r["f1"]) for r in L.fold_metrics(spark.createDataFrame(out)).collect()}
    for key, (accuracy, f1) in got.items():
        own = [(r["y"], r["yhat"]) for r in out if (r["repeat"], r["fold"]) == key]
        assert accuracy == pytest.approx(sum(y == p for y, p in own) / len(own))
        each = 0.0
        for c in {y for y, _ in own}:
            tp, n, p = sum(y == q == c for y, q in own), sum(y == c for y, _ in own), sum(q == c for _, q in own)
            each += n * (2 * tp / (n + p))
        assert f1 == pytest.approx(each / len(own))


def test_comparison_pairs_folds(spark, cohort):
    assay, labels, emb = cohort
    rows = L.training_rows(L.wide(assay, GENES), labels)
    poor = L.training_rows(L.wide(assay, GENES[3:]), labels)
    out = {r["variant"]: r for r in L.compared({"full": (rows, L.forest(5, 3)), "poor": (poor, L.forest(5, 3))}, "full", 5).collect()}
    assert out["full"]["delta_f1"] == 0 and out["full"]["z"] is None and out["poor"]["delta_f1"] < 0 and out["poor"]["p"] == 1 / 32 and out["poor"]["delta_accuracy"] < 0 and out["full"]["n_folds"] == 5
    told = spark.createDataFrame([("n", 0.5), ("a", 0.6), ("b", 0.7), ("ab", 0.9)], "variant string, f1 double")
    assert tuple(round(x, 9) for x in L.synergy(told, "n", "a", "b", "ab").first()) == (0.4, 0.1, 0.2, 0.1)
    use = L.row_feature_use(assay, labels, GENES).first()
    assert use["information"] > 0 and 0 < use["used"] <= 1
    fused = L.fused_rows(assay, GENES, emb, labels, spark.createDataFrame([(g, 1.0) for g in GENES], "gene string, weight double"))
    assert {len(r["f"]) for r in fused.select(vector_to_array("features").alias("f")).collect()} == {9}


def test_models_and_flagship(spark, cohort):
    assay, labels, emb = cohort
    rows = L.training_rows(L.wide(assay, GENES), labels)
    for name, model in L.baselines().items():
        fitted = model.fit(rows).transform(rows)
        assert fitted.where("prediction = label").count() > 25, name
    data = rows.withColumn("more", F.lit(1.0))
    assert L.estimator_pipeline(["features", "more"], L.forest(3, 2)).fit(data).transform(data).count() == 45
    names = ["a", "b", "c"]
    coded = L.decoded(L.encoded(labels).withColumn("prediction", F.col("code").cast("double")), names)
    assert coded.where("decoded <> label").count() == 0
    top = L.fitted_fusion(assay, labels, emb, M.drift_statistics(emb), k=4, parts=2).collect()
    index = [r["fusion_index"] for r in top]
    assert len(top) == 4 and index == sorted(index, reverse=True) and max(top, key=lambda r: r["importance"])["gene"] == "G0"
    assert all(r["fusion_index"] == pytest.approx(r["importance"] * r["instability"] * 1000, abs=1e-3) and 0.5 < r["accuracy"] <= 1 for r in top)


def test_components_equal_numpy(spark, cohort):
    assay, labels, _ = cohort
    rows = L.training_rows(L.wide(assay, GENES), labels)
    got = {r["sample_id"]: r["components"] for r in L.principal_components(rows, 2)[0].collect()}
    data = {r["sample_id"]: r["f"] for r in rows.select("sample_id", vector_to_array("features").alias("f")).collect()}
    x = np.array([data[i] for i in sorted(data)])
    x -= x.mean(0)
    want = x @ np.linalg.svd(x, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs([got[i] for i in sorted(got)]), np.abs(want), atol=1e-8)


def test_tails(spark):
    one = lambda f, *x: spark.range(1).select(f(*(F.lit(float(v)) for v in x)).alias("x")).first()["x"]
    assert one(S.chi2_tail, 3.841458820694124) == pytest.approx(0.05, abs=1e-12) and one(S.chi2_tail, 0) == 1 and one(S.chi2_tail, 60) == pytest.approx(9.485737e-15, rel=1e-5)
    assert one(S.t_tail, 2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10) and one(S.t_tail, -1, 1) == pytest.approx(0.5, abs=1e-10) and one(S.t_tail, 0, 7) == 1
    assert one(S.normal_tail, 1.6448536269514722) == pytest.approx(0.05, abs=1e-12) and one(S.normal_tail, -1.6448536269514722) == pytest.approx(0.95, abs=1e-12)


def test_running_totals_and_quantiles(spark):
    r = random.Random(2)
    data = [(r.choice("xy"), float(r.randint(0, 400))) for _ in range(3000)] + [("x", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    for row in ranks.counted(df, "v", ["k"]).collect():
        own = [v for k, v in data if k == row["k"] and v is not None]
        assert (row["_n"], row["before__n"], row["all__n"]) == (own.count(row["v"]), sum(v < row["v"] for v in own), len(own))
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for row in ranks.quantiles(df, "v", at, ["k"]).collect():
        assert np.allclose(row["quantiles"], np.quantile([v for k, v in data if k == row["k"] and v is not None], at))
    assert ranks.counted(df.limit(0), "v").count() == 0


def test_auc_and_signed_ranks(spark):
    r = random.Random(3)
    data = [(r.randint(0, 1), float(r.randint(0, 20))) for _ in range(300)]
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert M.roc_auc(spark.createDataFrame(data, "y int, p double"), []).first()["auc"] == pytest.approx(want)
    pairs = [(float(r.randint(0, 9)), float(r.randint(0, 9))) for _ in range(200)]
    d = [a - b for a, b in pairs if a != b]
    rank = lambda x: sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2
    row = M.wilcoxon(spark.createDataFrame(pairs, "a double, b double")).first()
    assert (row["n"], row["w_plus"]) == (len(d), sum(rank(x) for x in d if x > 0)) and 0 < row["p"] < 1


def test_betweenness_equals_brute_force(spark):
    edges = [("d1", "g1"), ("d1", "g2"), ("g1", "p1"), ("g2", "p1"), ("g2", "p2"), ("g3", "p2"), ("d2", "g3"), ("g3", "p1")]
    nodes = sorted({x for e in edges for x in e})
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in nodes}

    def paths(s, t):
        level, found = [[s]], []
        while level and not found:
            found = [p for p in level if p[-1] == t]
            level = [[*p, n] for p in level for n in near[p[-1]] if n not in p]
        return found

    want = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        every = paths(s, t)
        for p in every:
            for n in p[1:-1]:
                want[n] += 1 / len(every)
    n = len(nodes)
    frame = spark.createDataFrame([(x, x[0]) for x in nodes], "node string, type string")
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src string, dst string")
    got = {r["node"]: r["betweenness"] for r in G.betweenness(frame, both).collect()}
    assert got == {x: pytest.approx(v / ((n - 1) * (n - 2)), abs=1e-6) for x, v in want.items()}


def test_embedding_sum_takes_means(spark):
    emb = spark.createDataFrame([("g", [1.0, 0.0]), ("g", [3.0, 4.0])], "gene string, embedding array<double>")
    z = screens.embedding_sum(spark.createDataFrame([(1, "g", 2.0)], "sample_id long, gene string, value double"), emb, normalise=False)
    assert {(r["dim"], r["z"]) for r in z.collect()} == {(0, 4.0), (1, 4.0)}
