"""Early stopping, the search by halving, ensembles, and switches with timers over several batches."""

import math
import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from helixframe.operators import boosting as B
from helixframe.operators import learning as L
from helixframe.operators import metrics as M
from helixframe.streaming import jobs


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = []
    for i in range(160):
        c = i % 3
        data.append((i, float(c if r.random() > 0.15 else r.randrange(3)), 1.0, [r.gauss(2 * (c == 0), 1), r.gauss(2 * (c == 1), 1), r.gauss(0, 1)]))
    df = spark.createDataFrame(data, "id long, label double, weight double, x array<double>")
    return df.withColumn("features", array_to_vector("x")).withColumn("sample_id", F.col("id")).drop("x").cache()


def test_boosting_stops_early_and_its_loss_falls(spark, rows):
    short, long_ = B.ClassBoosting(1, 2).fit(rows), B.ClassBoosting(12, 2, tolerance=0.02).fit(rows)
    assert short.rounds == [1, 1, 1] and all(1 <= n <= 12 for n in long_.rounds) and min(long_.rounds) < 12
    assert long_.log_loss(rows) < short.log_loss(rows) < math.log(3)
    out = long_.transform(rows).select("label", "prediction", "probability").collect()
    assert all(sum(r["probability"]) == pytest.approx(1) and r["prediction"] == max(range(3), key=lambda c: r["probability"][c]) for r in out)
    assert sum(r["label"] == r["prediction"] for r in out) > 110
    loss = -sum(math.log(r["probability"][int(r["label"])]) for r in out) / len(out)
    assert long_.log_loss(rows) == pytest.approx(loss)


def test_random_points_fill_their_ranges():
    points = B.random_points(400)
    assert points == B.random_points(400) and points != B.random_points(400, seed="1") and len(points[0]) == 9
    for name, (kind, low, high, even) in B.SPACE.items():
        values = sorted(p[name] for p in points)
        assert low <= values[0] and values[-1] <= high and all(isinstance(v, kind) for v in values)
        middle = math.sqrt(low * high) if even else (low + high) / 2
        assert 0.35 < sum(v < middle for v in values) / 400 < 0.65
        assert kind is float or len({*values}) > 0.8 * (high - low + 1)


def test_halving_finds_a_planted_optimum_with_a_third_of_the_work():
    points = [{"a": a, "b": b} for a in range(9) for b in range(9)]
    r = random.Random(2)
    noise = {i: r.gauss(0, 1) for i in range(81)}
    score = lambda p, share: -((p["a"] - 6) ** 2 + (p["b"] - 2) ** 2) + noise[p["a"] * 9 + p["b"]] * (1 - share)
    tried = B.halving(points, score)
    last = [x for x in tried if x[2] == 1.0]
    assert points[last[0][1]] == {"a": 6, "b": 2} and len(last) == 1
    assert sum(share for _, _, share, _ in tried) < 81 / 3 and [sum(x[0] == k for x in tried) for k in range(5)] == [81, 27, 9, 3, 1]
    assert B.halving([{"a": 1}], lambda p, share: 0.5) == [(0, 0, 1.0, 0.5)]


def test_search_over_rows(spark, rows):
    points = B.random_points(3, {"depth": (int, 1, 3, False), "rounds": (int, 1, 3, False)})
    out = B.searched(rows, points).collect()
    assert [(r["rung"], r["share"]) for r in out] == [(0, pytest.approx(1 / 3))] * 3 + [(1, 1.0)]
    first = [r for r in out if r["rung"] == 0]
    assert out[3]["point"] == max(first, key=lambda r: (r["f1"], -r["point"]))["point"] and out[3]["f1"] > 0.5
    model = B.ClassBoosting(depth=out[3]["depth"], rounds=out[3]["rounds"])
    test = M.hashed("search", F.col("id")) < 1 / 3
    got = [(r["label"], r["prediction"]) for r in model.fit(rows.where(~test)).transform(rows.where(test)).collect()]
    f1 = 0.0
    for c in {y for y, _ in got}:
        tp, n, p = sum(y == q == c for y, q in got), sum(y == c for y, _ in got), sum(q == c for _, q in got)
        f1 += n * 2 * tp / (n + p) / len(got)
    assert out[3]["f1"] == pytest.approx(f1)


def test_ensembles_decide_by_their_members(spark, rows):
    members = L.bootstrap_ensemble(rows, 3, lambda i: L.forest(5, 3, seed=i))
    each = members.collect()
    assert len(each) == 160 * 3 * 3
    decided = {r["id"]: r for r in M.ensemble_decision(M.ensemble_prediction(members), 3).collect()}
    for i in (0, 50, 159):
        mean = [sum(r["p"] for r in each if r["id"] == i and r["k"] == k) / 3 for k in range(3)]
        assert decided[i]["k"] == mean.index(max(mean)) and decided[i]["p"] == pytest.approx(max(mean))
        assert decided[i]["entropy"] == pytest.approx(-sum(p * math.log(p + 1e-10) for p in mean) / math.log(3))


def test_a_hold_out_is_never_learned_from(spark, rows):
    seen = []

    class Watched:
        def fit(self, df):
            seen.append({r["id"] for r in df.select("id").collect()})
            return L.forest(5, 3).fit(df)

    got = L.held_out(rows, Watched()).count()
    assert got + len(seen[0]) == 160 and 25 < got < 75



def test_stability_over_refits(spark, rows):
    out = L.refit_stability(rows, L.forest(5, 3), draws=3).first()
    accuracy = []
    for d in range(3):
        mine = M.subsample(rows, 3).where(f"draw = {d}").select("id")
        got = L.forest(5, 3).fit(rows.join(mine, "id", "left_semi")).transform(rows.join(mine, "id", "left_anti")).collect()
        accuracy.append(sum(r["label"] == r["prediction"] for r in got) / len(got))
    mean = sum(accuracy) / 3
    assert out["draws"] == 3 and out["accuracy"] == pytest.approx(mean)
    assert out["accuracy_stability"] == pytest.approx(math.sqrt(sum((a - mean) ** 2 for a in accuracy) / 2) / mean)


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_timers_fire_between_batches(spark, rocks, tmp_path):
    """Three batches: a quiet subject starts on again, its state goes when the watermark passes its timer, and rows
    behind the watermark are dropped."""
    hour = 3600
    batches = [
        [(1, 0, 1, 10.0), (1, 600, 2, 40.0), (2, 0, 3, 10.0), (3, 100, 4, 10.0)],
        [(2, 5 * hour, 5, 40.0), (4, 30 * hour, 6, 40.0)],
        [(1, 31 * hour, 7, 40.0), (3, 31 * hour, 8, 40.0), (2, 32 * hour, 9, 10.0), (2, 2 * hour, 10, 70.0)],
        [(2, 33 * hour, 11, 40.0), (4, 70 * hour, 12, 10.0)],
    ]

    for k, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "subject long, s long, ord long, value double").select("subject", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"), "ord", "value")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        out = jobs.hysteresis_stream(stream, 20, 60, quiet=10 * hour * 1000, late="1 hour")
        run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        run.awaitTermination()
    got = {r["ord"]: r["on"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # 10 is late: the watermark stood at 29 h.  7 and 8 come more than 10 h after their subjects were off.
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1, 7: 1, 8: 1, 9: 0, 11: 0, 12: 0}
    on_time = [(s, t, o, v) for b in batches for s, t, o, v in b if o != 10]
    df = spark.createDataFrame(on_time, "subject long, s long, ord long, value double").withColumn("ts", F.timestamp_seconds("s"))
    assert got == {r["ord"]: r["on"] for r in M.hysteresis(df, 20, 60, quiet=10 * hour).collect()}
