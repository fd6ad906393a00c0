"""Exact small values."""

import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as Q
from helixframe.operators import cohort as C
from helixframe.operators import companion as P
from helixframe.operators import metrics as M
from helixframe.operators import normalisation as N
from helixframe.operators import survival as S
from helixframe.sources import readers as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("seq,gc", [("GGCC", 1.0), ("AATT", 0.0), ("", 0.0), ("gcat", 0.5)])
def test_gc(spark, seq, gc):
    assert one(spark, Q.gc_content(F.lit(seq))) == gc


def test_protein_change(spark):
    assert tuple(one(spark, Q.parse_protein_change(F.lit("p.V600E")))) == (599, "E")
    assert one(spark, Q.parse_protein_change(F.lit("p.V"))) is None


def test_priority_and_quality(spark):
    assert [one(spark, C.priority(F.lit(x))) for x in (0.8, 0.6, 0.3)] == ["HIGH", "MEDIUM", "LOW"]
    pairs = [(0.95, 0.85), (0.75, 0.55), (0.55, 0.35), (0.30, 0.25)]
    assert [one(spark, C.decision_quality(F.lit(a), F.lit(b))) for a, b in pairs] == ["HIGH", "MODERATE", "LOW", "UNCERTAIN"]


def test_translation_and_strands(spark):
    assert one(spark, Q.translate_dna(F.lit("ATGGCCTAAGGG"))) == "MA"
    assert one(spark, Q.reverse_complement(F.lit("AACGX"))) == "NCGTT"
    assert one(spark, Q.on_target(F.lit("ACGT"))) == 0.0


def test_response_class(spark):
    assert [one(spark, C.response_class(F.lit(x))) for x in (-99, -30, 0, 20)] == ["CR", "PR", "SD", "PD"]


def test_kaplan_meier_reaches_zero(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 0), ("a", 3.0, 1)], "arm string, time double, event int")
    curve = {r["time"]: round(r["survival"], 6) for r in S.kaplan_meier(rows).collect()}
    assert curve == {1.0: 0.666667, 2.0: 0.666667, 3.0: 0.0}
    assert S.median_survival(S.kaplan_meier(rows)).first()["median"] == 3.0
    with pytest.raises(ValueError):
        S.split_arms(rows, "missing")


def test_one_batch_stays(spark):
    rows = spark.createDataFrame([("s1", "g", 1.0, "a"), ("s2", "g", 5.0, "a")], "sample_id string, gene string, value double, batch string")
    assert sorted(r["value"] for r in N.combat(rows).collect()) == [1.0, 5.0]


def test_probability_of_one_is_in_no_bin(spark):
    rows = spark.createDataFrame([(1, 0.3), (0, 0.05), (1, 1.0)], "y int, p double")
    assert {(r["bin"], r["count"]) for r in M.calibration_curve(rows).collect()} == {(3, 1), (0, 1)}


def test_average_rank(spark):
    rows = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 2.0)], "k string, v double")
    assert sorted(r["rank"] for r in N.average_rank(rows, "v", ["k"]).collect()) == [1.0, 2.5, 2.5]


def test_tier_needs_equal_status(spark):
    variants = spark.createDataFrame([("p", 1, g, "v") for g in "abcd"], "patient_id string, ord int, gene string, variant string")
    drugs = spark.createDataFrame([("a", "Approved"), ("b", "Clinical trial"), ("c", "Approved (x)")], "gene string, status string")
    assert {(r["gene"], r["tier"]) for r in P.tiers(variants, drugs).collect()} == {("a", "I"), ("b", "II"), ("c", "III"), ("d", "IV")}


def test_read_maf_skips_comments(spark, tmp_path):
    path = tmp_path / "x.maf"
    path.write_text("#version 2\nHugo_Symbol\tt_alt_count\tOther\nEGFR\t3\tz\n")
    row = R.read_maf(spark, str(path)).first()
    assert (row["Hugo_Symbol"], row["t_alt_count"], row["Variant_Type"]) == ("EGFR", 3, None)


def test_folds_are_even(spark):
    rows = spark.range(23).withColumn("y", F.lit(1))
    sizes = [r["count"] for r in M.stratified_folds(rows, 5).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 23
