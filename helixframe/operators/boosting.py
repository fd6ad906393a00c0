"""Boosting that stops by a hashed hold-out, and a search of its parameters by successive halving."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import metrics

#: Fits that run at a time.
PARALLEL = 4

#: Nine parameters of boosting: kind of number, range, and whether steps are even in the logarithm.
SPACE: dict[str, tuple[type, float, float, bool]] = {
    "rounds": (int, 4, 16, False),
    "depth": (int, 2, 5, False),
    "rate": (float, 0.05, 0.5, True),
    "least_rows": (int, 1, 10, False),
    "least_gain": (float, 0.0, 0.05, False),
    "row_share": (float, 0.6, 1.0, False),
    "column_share": (float, 0.5, 1.0, False),
    "bins": (int, 16, 64, True),
    "least_weight": (float, 0.0, 0.02, False),
}


class ClassBoosting:
    """A boosted ensemble for each class against the rest; each stops by itself when its loss over the rows that a hash
    keeps aside grows again or falls by less than ``tolerance`` of it.

    ``fit`` takes rows with features, label, weight and id; its model's ``transform`` adds ``probability`` (an array, the
    classes' probabilities made to add up to 1) and ``prediction``.  Estimators with the same ``key`` fit the same model:
    the rate weighs the trees after an ensemble's first, so with one round it changes nothing.
    """

    def __init__(self, rounds: int = 12, depth: int = 3, rate: float = 0.3, least_rows: int = 1, least_gain: float = 0.0, row_share: float = 1.0, column_share: float = 1.0, bins: int = 32, least_weight: float = 0.0, aside: float = 0.2, tolerance: float = 0.01, seed: int = 1):
        self.params = {"maxIter": rounds, "maxDepth": depth, "stepSize": rate, "minInstancesPerNode": least_rows, "minInfoGain": least_gain, "subsamplingRate": row_share, "featureSubsetStrategy": str(float(column_share)), "maxBins": bins, "minWeightFractionPerNode": least_weight, "validationTol": tolerance, "seed": seed}
        self.aside = aside
        self.key = (aside, *((k, v) for k, v in self.params.items() if k != "stepSize" or rounds > 1))

    def fit(self, rows: DataFrame) -> BoostedClasses:
        told = rows.select("features", "label", "weight", (metrics.hashed("aside", F.col("id")) < self.aside).alias("_aside"))
        told = written(told, "boosting")
        met = told.groupBy("label").agg(F.min("_aside").alias("a"), F.max("_aside").alias("b")).collect()  # a row per class
        stop = any(r["b"] for r in met) and any(not r["a"] for r in met)

        def one(c: float) -> GBTClassificationModel:
            own = GBTClassifier(featuresCol="features", labelCol="_y", weightCol="weight", predictionCol="_yhat", **self.params).setRawPredictionCol("_raw").setProbabilityCol("_p")
            own = own.setValidationIndicatorCol("_aside") if stop else own
            return own.fit(told.withColumn("_y", (F.col("label") == c).cast("double")))

        classes = sorted(r["label"] for r in met)
        with ThreadPoolExecutor(PARALLEL) as pool:
            return BoostedClasses(classes, list(pool.map(one, classes)))


class BoostedClasses:
    def __init__(self, classes: list[float], models: list[GBTClassificationModel]):
        self.classes, self.models = classes, models

    @property
    def rounds(self) -> list[int]:
        return [m.getNumTrees for m in self.models]

    def transform(self, rows: DataFrame) -> DataFrame:
        out = rows
        for i, model in enumerate(self.models):
            out = model.transform(out).withColumn(f"_p{i}", vector_to_array("_p")[1]).drop("_raw", "_p", "_yhat")
        every = [F.greatest(F.col(f"_p{i}"), F.lit(1e-12)) for i in range(len(self.models))]
        out = out.withColumn("_sum", sum(every, F.lit(0.0))).withColumn("probability", F.array(*(p / F.col("_sum") for p in every)))
        best = F.array_position("probability", F.array_max("probability"))
        names = F.array(*(F.lit(float(c)) for c in self.classes))
        return out.withColumn("prediction", F.element_at(names, best.cast("int"))).drop("_sum", *(f"_p{i}" for i in range(len(self.models))))

    def log_loss(self, rows: DataFrame) -> float:
        """Mean of -ln p of the true class."""
        place = F.array_position(F.array(*(F.lit(float(c)) for c in self.classes)), F.col("label")).cast("int")
        return self.transform(rows).agg(F.avg(-F.log(F.element_at("probability", place)))).first()[0]


def random_points(n: int, space: dict[str, tuple[type, float, float, bool]] = SPACE, seed: str = "0") -> list[dict]:
    """``n`` points of the space, the same for the same seed: a hash of seed, point and parameter takes a random number's place."""
    out = []
    for i in range(n):
        point = {}
        for name, (kind, low, high, even) in space.items():
            u = int(hashlib.md5(f"{seed}|{i}|{name}".encode()).hexdigest()[:8], 16) / 2**32
            if kind is int:
                x = math.exp(math.log(low) + u * (math.log(high + 1) - math.log(low))) if even else low + u * (high + 1 - low)
                point[name] = min(int(x), int(high))
            else:
                point[name] = math.exp(math.log(low) + u * (math.log(high) - math.log(low))) if even else low + u * (high - low)
        out.append(point)
    return out


def halving(points: list[dict], score: Callable[[dict, float], float], eta: int = 3) -> list[tuple[int, int, float, float]]:
    """(rung, point number, share of the rows, score): every point is tried on a small share; the best 1 / ``eta`` of
    them (the earlier of equals) go on to ``eta`` times the share, until the last rung has all rows."""
    alive, out = list(range(len(points))), []
    rungs = max(0, math.ceil(math.log(max(len(points), 1)) / math.log(eta) - 1e-9))
    for rung in range(rungs + 1):
        share = float(eta) ** (rung - rungs)
        with ThreadPoolExecutor(PARALLEL) as pool:
            scores = list(pool.map(lambda i: score(points[i], share), alive))  # noqa: B023
        out += [(rung, i, share, s) for i, s in zip(alive, scores, strict=True)]
        best = sorted(zip(alive, scores, strict=True), key=lambda x: (-x[1], x[0]))
        alive = sorted(i for i, _ in best[: max(1, math.ceil(len(alive) / eta))])
    return out


def searched(rows: DataFrame, points: list[dict], eta: int = 3, model: Callable[..., object] = ClassBoosting) -> DataFrame:
    """(rung, point, share, f1, and the parameters): halving over nested samples, which a hash of the key picks.

    A third of the rows, picked by another hash, is never learned from: all points and rungs are scored by their F1
    there.
    """
    told = written(rows.withColumns({"_test": metrics.hashed("search", F.col("id")) < 1 / 3, "_u": metrics.hashed("halving", F.col("id"))}), "search")
    test = told.where("_test").drop("_test", "_u")

    def score(point: dict, share: float) -> float:
        sample = told.where(~F.col("_test") & (F.col("_u") < share)).drop("_test", "_u")
        if sample.select("label").distinct().count() < 2:
            return 0.0
        got = model(**point).fit(sample).transform(test).select(F.lit(0).alias("fold"), F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("yhat"))
        return metrics.classification_metrics(got, ["fold"]).first()["f1"]

    tried = halving(points, score, eta)
    names = list(points[0])
    kinds = ", ".join(f"{n} {'int' if isinstance(points[0][n], int) else 'double'}" for n in names)
    return rows.sparkSession.createDataFrame([(r, i, s, float(f), *(points[i][n] for n in names)) for r, i, s, f in tried], f"rung int, point int, share double, f1 double, {kinds}")
