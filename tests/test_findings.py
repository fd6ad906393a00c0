"""Small cases of mended faults."""

import random
import re

import duckdb
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from helixframe import registry
from helixframe.functions import sequence as Q
from helixframe.operators import companion as P
from helixframe.operators import learning as L
from helixframe.operators import metrics as M
from helixframe.operators import network as G
from helixframe.operators import normalisation as N
from helixframe.operators import ranks as K
from helixframe.operators import screens as S
from helixframe.plans.base import Views
from helixframe.sources import readers as R
from helixframe.streaming import jobs as J


def test_highest_score_is_found_once_per_document(spark):
    """Below the explosion: a disease's row must not carry its whole document."""
    raw = spark.createDataFrame([('{"approvedSymbol":"G","associatedDiseases":{"rows":[{"score":0.2,"disease":{"name":"a"}},{"score":0.7,"disease":{"name":"b"}}]}}',), ('{"approvedSymbol":"H"}',)], "json string")
    flat = R.flatten_targets(raw)
    assert sorted((r["gene"], r["overall"], r["disease"] or "") for r in flat.collect()) == [("G", 0.7, "a"), ("G", 0.7, "b"), ("H", 0.0, "")]
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert "array_max" not in plan[: plan.index("Generate")] and "array_max" in plan


def test_no_response_from_a_first_value_of_zero(spark):
    rows = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 5.0), ("b", 1, 4.0), ("b", 2, 1.0), ("c", 1, -1.0)], "subject string, ts int, value double")
    found = {(r["subject"], r["ts"]): r["response"] for r in M.response_percent(rows, ["subject"]).collect()}
    assert found == {("a", 1): None, ("a", 2): None, ("b", 1): 0.0, ("b", 2): 75.0, ("c", 1): None}


def test_responses_are_added_in_order_of_time(spark, tmp_path):
    """0.1 + 0.35 + 0.2 is below 0.65 as doubles, 0.2 + 0.35 + 0.1 isn't: SQL over rows in order of time tells which."""
    values = {1: [100.0, 99.9, 99.65, 99.8], 2: [100.0, 99.8, 99.65, 99.9], 3: [0.0, 5.0], 4: [4.0, None, 1.0]}
    rows = spark.createDataFrame([(u, t, "x", v) for u, vs in values.items() for t, v in enumerate(vs)], "user_id int, ts long, event_type string, value double")
    rows.withColumn("ts", F.timestamp_seconds("ts")).orderBy("user_id", F.desc("ts")).write.parquet(f"{tmp_path}/events.parquet")
    query = registry.queries()["a42_response_percent"]
    assert {tuple(r) for r in query(spark, str(tmp_path)).collect()} == {(1, 4, 0.6), (2, 4, 0.7), (4, 3, 75.0)}
    sf = "/root/testdata/sf0.01"
    events = duckdb.sql(f"SELECT * FROM '{sf}/events.parquet'")  # noqa: F841  (the SQL's table)
    assert {tuple(r) for r in query(spark, sf).collect()} == set(duckdb.sql(registry.oracles()["a42_response_percent"]).fetchall())


def test_long_trajectories_are_added_in_runs_of_time(spark):
    rows = spark.createDataFrame([("a", None if i == 7 else i, float(i)) for i in range(1, 41)] + [("b", 5, 1.0), ("b", 5, 0.5), ("b", 5, 2.0)], "subject string, ts int, value double")
    told = rows.withColumn("response", F.col("value") * 0.25)
    out = {r["subject"]: (r["n"], r["total"]) for r in M.response_total(told, ["subject"], 2).collect()}
    assert out == {"a": (40, 205.0), "b": (3, 0.9)}


def test_report_lines_of_long_numbers(spark):
    """In the order of SQL's lpad(ord, 5, '0'), which keeps five digits."""
    tiered = spark.createDataFrame([("p", 20000, "A", "x", "I"), ("p", 123456, "B", "x", "I"), ("p", 123457, "A", "x", "I"), ("p", 7, "C", "x", "I")], "patient_id string, ord long, gene string, variant string, tier string")
    none = tiered.limit(0)
    alerts = none.select("patient_id", "gene", F.lit("m").alias("top_mechanism"), F.lit(1).alias("n_mechanisms"))
    plan = none.select("patient_id", F.lit(1).alias("rank"), F.lit("t").alias("therapy"), "gene")
    text = P.report_lines(plan, alerts, tiered).first()["report"]
    assert [line.split(" ")[0] for line in text.split("\n")] == ["C", "A", "B", "A"]


def test_twins_stand_for_all_their_nodes(spark):
    """Counts of distances and betweenness by classes are those of all nodes; work grows with classes, not with nodes."""
    one = [(f"d{i}", g) for i in range(6) for g in ("a", "b")] + [("x", "a"), ("a", "p"), ("b", "q"), ("c", "q"), ("y", "c"), ("z", "c")]
    edges = spark.createDataFrame([e for s, d in one for e in ((s, d), (d, s))], "src string, dst string")
    nodes = edges.select(F.col("src").alias("node"), F.lit("any").alias("type")).distinct().union(spark.createDataFrame([("alone1", "any"), ("alone2", "any")], "node string, type string"))
    members, between, sizes = G.twins(nodes, edges)
    assert sizes.where("node = 'd0'").first()["size"] == 6 and sizes.count() == 8
    plain = G.distances(edges, nodes).groupBy("source", "dist").count().collect()
    assert sorted(map(tuple, G.distance_counts(nodes, edges).collect())) == sorted(map(tuple, plain))
    n = nodes.count()
    shares = {r["node"]: round(r["t"] / ((n - 1) * (n - 2)), 6) for r in G.dependencies(edges, nodes).groupBy("node").agg(F.sum("delta").alias("t")).collect()}
    found = {r["node"]: r["betweenness"] for r in G.betweenness(nodes, edges).collect()}
    assert found == {x: pytest.approx(shares.get(x, 0.0), abs=1e-6) for x in found} and len(found) == n


def test_matches_are_counted_per_gene(spark):
    variants = spark.createDataFrame([("p", "A"), ("p", "A"), ("q", "B")], "patient_id string, gene string")
    cna = spark.createDataFrame([("p", "A", 1.0), ("q", "A", 0.0)], "patient_id string, gene string, cna double")
    drugs = spark.createDataFrame([("A", "y", "s"), ("A", "x", "s"), ("C", "z", "s")], "gene string, drug string, status string")
    counts = P.match_counts(variants, cna, drugs)
    each = P.drug_matches(variants, cna, drugs).groupBy("patient_id", "gene", "alteration").agg(F.count(F.lit(1)), F.min("drug"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, each.collect())) == [("p", "A", "amplification", 2, "x"), ("p", "A", "mutation", 2, "x")]


def test_ranks_of_values_that_differ_when_computed_anew(spark):
    """As means of doubles do, whose sums follow the order of arrival."""
    noise = F.udf(lambda x: x * (1 + __import__("random").random() * 1e-12), "double").asNondeterministic()
    rows = spark.range(80).select("id", F.concat(F.lit("g"), F.col("id") % 8).alias("gene"), (F.col("id") + 1.0).alias("x"))
    assay = lambda: rows.select(F.col("id").alias("sample_id"), "gene", noise("x").alias("value"))
    assert sorted(r["rank"] for r in N.average_rank(assay().drop("gene"), "value", []).collect()) == [i + 1.0 for i in range(80)]
    assert N.align_features(assay(), assay(), 8).count() == 8
    assert N.quantile_normalise(assay()).count() == 80 and N.quantile_normalise_to(assay(), assay()).count() == 80


def test_equal_attributions_stand_in_the_order_of_their_features(spark):
    """Whatever the order of the sums behind them: 0.1 + 0.2 is above 0.3 in doubles."""
    rows = [("s", "b", 0.1 + 0.2), ("s", "a", -0.3), ("s", "c", 0.2), ("t", "a", 3e-20), ("t", "b", -4e-20), ("u", "a", 0.0), ("v", "a", float("inf")), ("v", "b", 1.0), ("v", "c", 2.0)]
    found = M.top_attributions(spark.createDataFrame(rows, "sample_id string, feature string, value double"), 2)
    assert found.columns == ["sample_id", "feature", "value", "rank", "direction"]
    assert sorted((r["sample_id"], r["rank"], r["feature"], r["direction"][0]) for r in found.collect()) == [("s", 1, "a", "d"), ("s", 2, "b", "i"), ("t", 1, "b", "d"), ("t", 2, "a", "i"), ("u", 1, "a", "i"), ("v", 1, "a", "i"), ("v", 2, "c", "i")]


def test_plans_are_made_per_patient(spark):
    """The best reason of each therapy and gene, without a shuffle of recommendations."""
    variants = spark.createDataFrame([("p", i, g, "x") for i, g in enumerate(["A", "A", "B", None] + ["Z"] * 6)] + [("q", 1, "A", "x"), (None, 1, "B", "x")], "patient_id string, ord int, gene string, variant string")
    cna = spark.createDataFrame([("q", "B", 1.0), ("q", "C", -1.0), ("r", "A", None)], "patient_id string, gene string, cna double")
    drugs = spark.createDataFrame([("A", "x", "Approved"), ("A", "x", "Clinical trial"), ("B", "y", "Approved"), ("B", "z", "Other"), ("C", "z", "Clinical trial"), ("C", "v", None)], "gene string, drug string, status string")
    pairs = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "A")], "gene string, partner string")
    resistance = spark.createDataFrame([("B", "x"), ("B", "y"), ("A", None)], "gene string, drug string")
    plan = P.treatment_plan(variants, cna, drugs, pairs, resistance)
    want = {
        "p": [("Immunotherapy", "TMB", 0.8, False, 3), ("x", "B", 0.65, False, 2), ("y, z", "A", 0.65, False, 2), ("x", "A", 0.5, False, 4), ("y", "B", 0.27, True, 1)],
        "q": [("x", "A", 0.9, False, 1), ("y", "B", 0.9, False, 1), ("x", "C", 0.65, False, 2), ("y, z", "A", 0.65, False, 2)],
        None: [("y", "B", 0.9, False, 1), ("x", "B", 0.65, False, 2)],
    }
    assert sorted(map(tuple, plan.collect()), key=str) == sorted(((p, *r, i + 1) for p, rows in want.items() for i, r in enumerate(rows)), key=str)
    assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_guides_are_found_and_scored_in_batches(spark, monkeypatch):
    """As column functions score them and a plain search finds them; no pattern or lambda goes over all letters."""
    monkeypatch.setattr(Q, "LETTERS", 500)
    r = random.Random(5)
    seqs = {f"g{i}": "".join(r.choices(letters, k=n)) for i, (letters, n) in enumerate([("ACGT", 700), ("ACGTN", 300), ("GGT", 90), ("acgtgG", 200), ("CGéX\U0001F9EC", 400), ("CCTTTT", 60), ("A", 30), ("G", 23), ("C", 23), ("G", 22), ("G", 0)])}
    df = spark.createDataFrame([*seqs.items(), ("none", None)], "gene string, seq string").repartition(2)
    want = set()
    for gene, seq in seqs.items():
        s = seq.upper()
        turned = re.sub("[^ACGTN]", "N", s).translate(str.maketrans("ACGT", "TGCA"))[::-1]
        for strand, x in (("+", s), ("-", turned)):
            want |= {(gene, strand, i if strand == "+" else len(x) - i, x[i - 20 : i]) for i in range(20, len(x) - 2) if x[i + 1 : i + 3] == "GG" and "N" not in x[i - 20 : i]}
    found = Q.guides(df)
    assert len(want) > 100 and sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "lambda" not in plan
    scored = Q._scanned(df, True).select("on_target", "off_target", Q.on_target(F.col("spacer")).alias("on"), Q.off_target(F.col("spacer")).alias("off"))
    assert scored.where("on_target <> on OR off_target <> off").count() == 0
    assert Q.guide_library(df).columns == ["gene", "strand", "position", "spacer", "on_target", "off_target", "score", "guide_id", "rank"]


def test_switches_of_a_bucket_are_one_state(spark, tmp_path):
    """A call works on many subjects, with and without a key, over two arrivals."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(3)
    rows = [(r.choice([None, *range(-2000, 2000)]), 1_000_000 + i * 60, i, r.choice([10.0, 40.0, 40.0, 70.0])) for i in range(9000)]
    df = spark.createDataFrame(rows, "subject long, s long, ord long, value double").withColumn("ts", F.timestamp_seconds("s"))
    try:
        for part in ("ord < 4000", "ord >= 4000"):
            df.where(part).select("subject", "ts", "ord", "value").write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(df.select("subject", "ts", "ord", "value").schema).parquet(str(tmp_path / "in"))
            out = J.hysteresis_stream(stream, 20, 60, quiet=7_200_000, late="0 seconds")
            assert "bucket" in out._jdf.queryExecution().analyzed().toString()
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    got = {x["ord"]: (x["subject"], x["on"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    on, seen, want = {}, {}, {}
    for s, t, o, v in rows:
        again = t - seen.get(s, t) > 7200
        on[s] = 0 if v < 20 else 1 if v > 60 or again else on.get(s, 1)
        seen[s], want[o] = t, (s, on[s])
    assert got == want


def test_changes_are_made_once(spark):
    """No test of a change is pushed below the rows that make it from a long text."""
    texts = spark.createDataFrame([("g", "abcdefghijkl"), ("h", "abc")], "gene string, seq string")
    made = texts.select("gene", F.concat(F.lit("p.A"), F.length(F.regexp_replace("seq", "[^a-k]", "")), F.lit("W")).alias("change")).distinct()
    found = Q.mutant_peptides(made, texts)
    assert {r["gene"] for r in found.collect()} == {"g"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[^a-k]") == 1


def test_fits_share_rows_that_few_tasks_read(spark, monkeypatch):
    """Models over the same rows share folds that are written once; a small table is one task, whatever its partitions."""
    data = [(i, i, "abc"[i % 3], [float(i % 3), float(i % 7)]) for i in range(60)]
    rows = spark.createDataFrame(data, "sample_id long, id long, name string, x array<double>").repartition(7)
    rows = rows.select("sample_id", "id", array_to_vector("x").alias("features"), (F.ascii("name") - 97).cast("double").alias("label"), F.lit(1.0).alias("weight"))
    tags = []
    monkeypatch.setattr(L, "written", lambda df, tag, f=L.written: (tags.append(tag), f(df, tag))[1])
    out = L.compared({"a": (rows, L.forest(2, 2)), "b": (rows, L.forest(3, 2))}, "a", 3, 2).collect()
    assert {r["variant"]: r["n_folds"] for r in out} == {"a": 6, "b": 6} and tags.count("split") == 1
    split = L.with_folds(rows, 3, 2)
    assert split.rows.rdd.getNumPartitions() == 1 and split.at_once == L.AT_ONCE
    for r in range(2):
        plain = M.stratified_folds(rows.withColumnRenamed("label", "y"), 3, seed=str(r))
        assert sorted(map(tuple, split.rows.select("id", f"_fold{r}").collect())) == sorted(map(tuple, plain.select("id", "fold").collect()))
    monkeypatch.setattr(L, "CELLS", 20)
    monkeypatch.setattr(L, "FILE_CELLS", 5)
    wide = L.with_folds(rows, 3)
    assert 1 < wide.rows.rdd.getNumPartitions() <= 6 and wide.at_once == L.PARALLEL and wide.rows.count() == 60


def test_row_features_are_used_as_given(spark, monkeypatch):
    """The assay isn't aggregated anew for each pass of the forest."""
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(30)], "sample_id long, label string")
    assay = spark.createDataFrame([(i, g, float((i % 2) * k + i % 5)) for i in range(30) for k, g in enumerate("pq")], "sample_id long, gene string, value double")
    full = L.with_row_features(assay, labels, ["p", "q"])
    seen = []
    monkeypatch.setattr(L, "with_row_features", lambda *a: seen.append(a))
    use = L.row_feature_use(assay, labels, ["p", "q"], full).first()
    assert not seen and use["information"] > 0 and 0 < use["used"] <= 1


def test_embedding_sums_are_one_row_per_sample(spark, monkeypatch):
    """No row per sample, gene and dimension; the flagship projects sums that are written, not made anew for each pass."""
    emb = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 0.0]), ("b", 0, [-1.0, 0.5]), ("c", 0, [0.0, 1.0])], "gene string, variant_no int, embedding array<double>")
    assay = spark.createDataFrame([(1, "a", 2.0), (1, "b", -3.0), (2, "b", 4.0), (2, "b", 1.0), (3, "a", 0.0), (4, "z", 1.0), (5, "a", None), (5, "c", 2.0)], "sample_id long, gene string, value double")
    for weights in (None, spark.createDataFrame([("a", 0.5), ("b", -2.0), ("q", 1.0)], "gene string, weight double")):
        plain = {(r["sample_id"], r["dim"]): r["z"] for r in S.embedding_sum(assay, emb, weights).collect() if r["z"] is not None}
        got = L.embedded(assay, emb, weights)
        found = {(r["sample_id"], d): z for r in got.collect() for d, z in enumerate(r["z"])}
        assert {k: found[k] for k in plain} == pytest.approx(plain) and all(z == 0 for k, z in found.items() if k not in plain)
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert L.embedded(assay, emb.limit(0)).count() == 0
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "sample_id long, label string")
    assay = spark.createDataFrame([(i, g, float((i % 2) * k + i % 5 + 1)) for i in range(40) for k, g in enumerate("abc")], "sample_id long, gene string, value double")
    plans = []
    monkeypatch.setattr(L, "principal_components", lambda rows, k, f=L.principal_components: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), f(rows, k))[1])
    top = L.fitted_fusion(assay, labels, emb, M.drift_statistics(emb), k=3, parts=2).collect()
    assert len(top) == 3 and "Aggregate" not in plans[0] and "Relation" in plans[0]


def test_metrics_make_predictions_once(spark):
    """A union of both classes of each cell read rows of one task twice, and so made their predictions twice."""
    made = spark.sparkContext.accumulator(0)

    def told(i: int) -> int:
        made.add(1)
        return i % 2

    yhat = F.udf(told, "int")(F.col("id"))
    rows = spark.range(12).select(F.lit(0).alias("fold"), (F.col("id") % 3).cast("int").alias("y"), yhat.alias("yhat")).coalesce(1)
    got = M.classification_metrics(rows, ["fold"]).first()
    assert made.value == 12 and got["accuracy"] == pytest.approx(4 / 12) and got["recall"] == pytest.approx(4 / 12)
    assert got["precision"] == pytest.approx((2 / 6 + 2 / 6 + 0) / 3)
    odd = spark.createDataFrame([(0, None, 1), (0, 1, 1), (0, 1, None)], "fold int, y int, yhat int")
    got = M.classification_metrics(odd, ["fold"]).first()
    assert got["accuracy"] == pytest.approx(1 / 3) and got["precision"] == pytest.approx((0.5 * 2 + 0) / 3)


def test_signed_ranks_by_group(spark):
    r = random.Random(4)
    data = [(g, float(r.randint(0, n)), float(r.randint(0, n))) for g, n in (("p", 9), ("q", 1000), ("r", 0)) for _ in range(12)]
    rows = spark.createDataFrame(data, "g string, a double, b double")
    got = {x["g"]: (x["n"], x["w_plus"], x["z"], x["p"]) for x in M.wilcoxon(rows, by=["g"]).collect()}
    assert set(got) == {"p", "q"}
    for g in got:
        one = M.wilcoxon(rows.where(F.col("g") == g)).first()
        assert got[g] == (one["n"], one["w_plus"], one["z"], one["p"])


class _Told:
    """A stand-in for an estimator: predicts the label of all rows but those whose id is below ``wrong``."""

    fits = 0

    def __init__(self, wrong, key=None):
        self.wrong = wrong
        if key is not None:
            self.key = key

    def fit(self, rows):
        type(self).fits += 1
        return self

    def transform(self, rows):
        return rows.withColumn("prediction", F.when(F.col("id") < self.wrong, 1 - F.col("label")).otherwise(F.col("label")))


def test_equal_models_are_fitted_once_and_variants_tested_in_one_plan(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i % 2)) for i in range(30)], "id long, label double").withColumn("features", array_to_vector(F.array("label")))
    tags = []
    monkeypatch.setattr(K, "written", lambda df, tag, f=K.written: (tags.append(tag), f(df, tag))[1])
    variants = {"base": (rows, _Told(0)), "a": (rows, _Told(9, "k")), "b": (rows, _Told(9, "k")), "c": (rows, _Told(15, "l"))}
    out = {r["variant"]: r for r in L.compared(variants, "base", 3).collect()}
    assert _Told.fits == 9 and tags.count("ranges") == 2  # the folds, and the ranks of all variants
    assert out["base"]["delta_f1"] == out["base"]["delta_accuracy"] == 0 and out["base"]["z"] is None and out["base"]["p_accuracy"] is None
    assert out["a"].asDict() == out["b"].asDict() | {"variant": "a"} and {r["n_folds"] for r in out.values()} == {3}
    assert out["a"]["accuracy"] == pytest.approx(0.7) and out["c"]["accuracy"] == pytest.approx(0.5) and out["c"]["delta_accuracy"] == pytest.approx(-0.5)
    met = L.fold_metrics(L.cross_validated(rows, _Told(15), 3)).select(F.lit(1.0).alias("a"), F.col("f1").alias("b"))
    one = M.wilcoxon(met).first()
    assert (out["c"]["z"], out["c"]["p"]) == (one["z"], one["p"])


def test_rate_counts_from_the_second_round_on(spark):
    """Fits with the same key are the same model."""
    data = [(i, float(i % 2), [float(i % 2 + i % 5), float(i % 7)]) for i in range(40)]
    rows = spark.createDataFrame(data, "id long, label double, x array<double>").select("id", "label", array_to_vector("x").alias("features"), F.lit(1.0).alias("weight")).coalesce(1)
    told = lambda m: [r["probability"] for r in m.fit(rows).transform(rows).orderBy("id").collect()]
    slow, fast = L.boosted(1, 2, 0.1), L.boosted(1, 2, 0.5)
    assert slow.key == fast.key and told(slow) == told(fast)
    assert L.boosted(2, 2, 0.1).key != L.boosted(2, 2, 0.5).key and slow.key != L.boosted(1, 3, 0.1).key and slow.key != L.boosted(1, 2, 0.1, seed=2).key


def test_sweep_of_rates_fits_a_model_for_each_rate(spark, monkeypatch):
    """With one round the rate weighs nothing: both settings were one model."""
    arms = {}
    monkeypatch.setattr(L, "compared", lambda variants, *a: arms.update(variants) or spark.createDataFrame([(n,) for n in variants], "variant string"))
    told = registry.queries()["m9b_parameter_sweep"](spark, "/root/testdata/sf0.001").where("parameter = 'rate'")
    models = {float(n.split("=")[1]): m for n, (_, m) in arms.items() if n.startswith("rate=")}
    assert set(models) == {r["setting"] for r in told.collect()} and len({m.key for m in models.values()}) == len(models) > 1
    assert all(m.params["stepSize"] == r and m.params["maxIter"] == L.boosted().params["maxIter"] > 1 for r, m in models.items())


def test_assay_groups_by_the_number_of_a_gene(spark, tmp_path):
    """Names of genes are made per group, not per row of lineitem; null keys stay a group of their own."""
    data = [(1, 3, 2.0), (1, 43, 4.0), (1, 4, 5.0), (2, 39, 1.0), (2, None, 7.0)]
    spark.createDataFrame(data, "l_suppkey long, l_partkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assay = Views(spark, str(tmp_path)).assay
    assert {tuple(r) for r in assay.collect()} == {(1, "G3", 3.0), (1, "G4", 5.0), (2, "G39", 1.0), (2, None, 7.0)}
    plan = assay._jdf.queryExecution().optimizedPlan().toString()
    assert "concat" in plan and "concat" not in plan[plan.index("Aggregate") :].split("\n", 1)[1]
