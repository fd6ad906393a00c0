"""Toxicity by a factorisation machine over hashed terms."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._words import ALNUM, Words, mixed, sliced

#: Buckets that terms are hashed into.
BUCKETS = 1 << 20
#: Besides each word, the first so many bytes of longer words are terms: languages with many endings have each form of
#: an insult too rarely to learn it, but all forms share their stem.
PREFIXES = (4, 6)
#: A term met so often in one text is a further term: a harmless stem may be telling when it is repeated.
REPEATS = (2, 3)
#: Labelled texts used for learning, at most, and their bytes together.
MAX_TRAINING_ROWS, MAX_TRAINING_BYTES = 20_000, 64_000_000


#: Ridges on the factors, and shares that they are shrunk to, which validation chooses from.
RIDGES = (0.001, 0.01, 0.1)
SHARES = (1.0, 0.7, 0.5, 0.35, 0.25, 0.1, 0.03, 0.01)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term buckets of all texts, one text after the other, and the text of each."""
    words = Words(column, ALNUM, lower=True)
    text = np.repeat(np.arange(len(column)), words.count)
    kinds = [text * BUCKETS + _slot(words.hash)]
    for k in PREFIXES:
        long = np.flatnonzero(words.end - words.start > k)
        total = np.full(len(long), k, np.uint64)
        for j in range(k):
            total = total * np.uint64(0x100000001B3) + words.buf[words.start[long] + j]
        kinds.append(text[long] * BUCKETS + _slot(mixed(total)))
    found = []
    for each in kinds:
        once, times = np.unique(each, return_counts=True)
        found.append(once)
        for n in REPEATS:
            often = once[times >= n]
            found.append(often // BUCKETS * BUCKETS + _slot(mixed((often % BUCKETS).astype(np.uint64) * np.uint64(16) + np.uint64(n))))
    both = np.unique(np.concatenate(found))
    return both % BUCKETS, both // BUCKETS


def _loss(logits: np.ndarray, labels: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - labels * logits))


@dataclass
class FactorizationMachine:
    """logit = bias + sum of linear[i] + sum over pairs i < j of <factors[i], factors[j]>, over the terms of a text.

    ``place`` maps a bucket to its row, or to -1 for terms that learning has seen too rarely.
    """

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    place: np.ndarray

    def logits(self, rows: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(text, self.linear[rows], n)
        for f in self.factors.T:
            v = f[rows]
            out += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        buckets, text = _terms(column)
        rows = self.place[buckets]
        known = rows >= 0
        return 1 / (1 + np.exp(-np.clip(self.logits(rows[known], text[known], len(column)), -30, 30)))

    @classmethod
    def learn(cls, terms: list[np.ndarray], labels: np.ndarray, size: int = 4, min_texts: int = 3, penalties: tuple[float, ...] = (1.0, 2.0, 4.0), seed: int = 1) -> FactorizationMachine:
        """Learns from all terms that ``min_texts`` texts have, however harmless each of them is alone.

        First the linear weights, for each L1 penalty; the one that does best on every fifth text, kept aside, goes on.
        Then linear weights and factors together from there, for each ridge on the factors, as long as these texts gain
        by it, and the factors are shrunk by the share that suits these texts best: interactions that mostly fit noise
        count little, pairs that matter stay whole.  At last the logits are scaled to what these texts show.
        """
        base = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
        met = np.bincount(np.concatenate([*terms, np.zeros(0, np.int64)]).astype(np.int64), minlength=BUCKETS)
        known = np.flatnonzero(met >= min_texts)
        place = np.full(BUCKETS, -1, np.int32)
        place[known] = np.arange(len(known))
        if not len(known) or len(set(labels.tolist())) < 2:
            return cls(np.log(base / (1 - base)), np.zeros(len(known)), np.zeros((len(known), size)), place)
        rows = [p[p >= 0] for p in (place[t] for t in terms)]
        aside = np.arange(len(rows)) % 5 == 0
        data = _Rows(rows, labels, np.flatnonzero(~aside), np.flatnonzero(aside))
        found = min((_Fit(len(known), size, base, p, seed).run(data, False, 8, 3) for p in penalties), key=lambda f: f.best)
        found = min((copy.deepcopy(found).run(data, True, 25, 4, ridge).shrunk(data, found) for ridge in RIDGES), key=lambda f: f.best)
        scale, shift = _calibrated(found.logits(*data.aside, True), labels[aside])
        # Float32 halves what goes to the tasks; a factor takes the root of the scale, since it enters twice.
        return cls(scale * found.bias + shift, (scale * found.linear).astype(np.float32), (np.sqrt(scale) * found.factors).astype(np.float32), place)


class _Rows:
    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, used: np.ndarray, aside: np.ndarray):
        self.rows, self.labels, self.used = rows, labels, used
        self.aside, self.aside_labels = self.packed(aside), labels[aside]

    def packed(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        none = np.zeros(0, np.int32)
        return np.concatenate([none, *(self.rows[i] for i in pick)]), np.repeat(np.arange(len(pick)), [len(self.rows[i]) for i in pick]), len(pick)


class _Fit:
    """Follow-the-regularised-leader for the linear weights (most stay 0), AdaGrad for the factors."""

    def __init__(self, n: int, size: int, base: float, penalty: float, seed: int, rate: float = 0.3, ridge: float = 0.1, factor_rate: float = 0.02):
        self.rng = np.random.default_rng(seed)
        self.linear, self.sums, self.squares = np.zeros(n), np.zeros(n), np.zeros(n)
        self.factors, self.factor_squares = self.rng.normal(0, 0.02, (n, size)), np.ones((n, size))
        self.bias, self.bias_squares, self.best = float(np.log(base / (1 - base))), 1.0, np.inf
        self.penalty, self.rate, self.ridge, self.factor_rate = penalty, rate, ridge, factor_rate

    def logits(self, rows: np.ndarray, text: np.ndarray, n: int, pairs: bool) -> np.ndarray:
        return FactorizationMachine(self.bias, self.linear, self.factors if pairs else self.factors[:, :0], rows).logits(rows, text, n)

    def run(self, data: _Rows, pairs: bool, rounds: int, patience: int, factor_ridge: float = 0.0, batch: int = 32) -> _Fit:
        """Rounds over the rows until those kept aside gain no more; the best state stays."""
        self.factor_ridge, self.best, since = factor_ridge, np.inf, 0
        for _ in range(rounds):
            order = self.rng.permutation(data.used)
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                self._step(*data.packed(pick), data.labels[pick], pairs)
            loss, since = _loss(self.logits(*data.aside, pairs), data.aside_labels), since + 1
            if loss < self.best - 1e-4:
                self.best, kept, since = loss, (self.bias, self.linear.copy(), self.factors.copy()), 0
            elif since >= patience:
                break
        self.bias, self.linear, self.factors = kept
        return self

    def shrunk(self, data: _Rows, before: _Fit) -> _Fit:
        """The factors shrunk to the share of each pair's weight that the rows kept aside like best, beside the linear
        weights learned with them or those learned ``before``."""
        pairs = self.logits(*data.aside, True) - self.logits(*data.aside, False)
        tried = [(_loss(f.logits(*data.aside, False) + x * pairs, data.aside_labels), -x, i) for i, f in enumerate((self, before)) for x in SHARES]
        self.best, share, i = min(tried)
        if i:
            self.bias, self.linear = before.bias, before.linear
        self.factors *= np.sqrt(-share)
        return self

    def _step(self, rows: np.ndarray, text: np.ndarray, n: int, labels: np.ndarray, pairs: bool) -> None:
        miss = 1 / (1 + np.exp(-np.clip(self.logits(rows, text, n, pairs), -30, 30))) - labels
        each = miss[text]
        own, at = np.unique(rows, return_inverse=True)
        grad = np.bincount(at, each, len(own))
        before, after = self.squares[own], self.squares[own] + grad * grad
        self.sums[own] += grad - (np.sqrt(after) - np.sqrt(before)) / self.rate * self.linear[own]
        self.squares[own] = after
        total = self.sums[own]
        self.linear[own] = np.where(np.abs(total) <= self.penalty, 0, (np.sign(total) * self.penalty - total) / ((1 + np.sqrt(after)) / self.rate + self.ridge))
        for f in range(self.factors.shape[1] if pairs else 0):
            v = self.factors[rows, f]
            grad = np.bincount(at, each * (np.bincount(text, v, n)[text] - v) + self.factor_ridge * v, len(own))
            self.factor_squares[own, f] += grad * grad
            self.factors[own, f] -= self.factor_rate * grad / np.sqrt(self.factor_squares[own, f])
        self.bias_squares += miss.sum() ** 2
        self.bias -= self.rate * miss.sum() / np.sqrt(self.bias_squares)


def _calibrated(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logits by logistic regression (Newton's steps), a little held to scale 1."""
    scale, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scale * logits + shift, -30, 30)))
        w, miss = p * (1 - p) + 1e-6, p - labels
        grad = np.array([(miss * logits).sum() + 0.01 * (scale - 1), miss.sum()])
        step = np.linalg.solve(np.array([[(w * logits * logits).sum() + 0.01, (w * logits).sum()], [(w * logits).sum(), w.sum() + 1e-6]]), grad)
        step *= min(1.0, 2 / max(np.abs(step).max(), 1e-9))
        scale, shift = max(scale - step[0], 0.05), shift - step[1]
    return float(scale), float(shift)


def is_held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, limit: int, limit_bytes: int = MAX_TRAINING_BYTES) -> tuple[list[np.ndarray], np.ndarray]:
    """Term buckets and labels of at most ``limit`` labelled texts that aren't held out, of at most ``limit_bytes``
    together, chosen by a hash of the key.

    Only keys and sizes are shuffled to choose them; the chosen keys, whose number is bounded, are broadcast.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~is_held_out(F.col(key))).select(key, F.col(label).cast("int").alias("_y")).distinct()
    sizes = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0))).alias("_b"))
    chosen = usable.join(sizes, key).withColumn("_h", F.xxhash64(key)).orderBy("_h", key, "_y").limit(limit)
    before = Window.orderBy("_h", key, "_y").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # ``limit`` rows
    chosen = chosen.withColumn("_sum", F.sum("_b").over(before)).where(F.col("_sum") <= limit_bytes).select(key, "_y")
    rows = docs.select(key, text).join(F.broadcast(chosen), key).select("_y", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            buckets, of = _terms(batch.column(1))
            at = np.searchsorted(of, np.arange(len(batch) + 1))
            packed = [buckets[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["y", "terms"])

    # Copies of a text would weigh it more: one of each (terms, label) is kept.  The order makes learning repeatable.
    found = sorted({(bytes(r["terms"]), r["y"]) for r in rows.mapInArrow(run, "y int, terms binary").collect()})
    return [np.frombuffer(t, np.int32) for t, _ in found], np.array([y for _, y in found], np.float64)


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = MAX_TRAINING_ROWS, threshold: float = 0.7) -> DataFrame:
    """Adds ``held_out``, ``score`` (0 to 1) and ``predicted`` to every row of ``docs``.

    Only the text decides a score.  Learning uses labelled rows with crc32(key) mod 3 <> 1, ``limit`` and
    ``MAX_TRAINING_BYTES`` at most; rows without a label don't take part.  Null and empty texts get the score of no
    terms; very long texts are scored whole; without usable labels every score is 0.5; repeated rows all stay; without
    documents there are no rows.  Scoring shuffles nothing: the model, of bounded size, goes to all tasks.
    Input columns called like the new ones are replaced.
    """
    model = FactorizationMachine.learn(*training_rows(docs, labels, key, text, label, limit))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sent.value.scores(batch.column(text)), pa.float64())], [*keep, "score"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    scored = docs.select(*keep).mapInArrow(run, schema)
    return scored.withColumns({"held_out": F.coalesce(is_held_out(F.col(key)), F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")})
