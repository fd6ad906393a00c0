"""Principal components of very many vectors by a block Jacobi-Davidson method, and the vectors whitened with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import dropped, viewed, written

#: A residual of this share of the largest eigenvalue is double precision: it is what a product itself loses.
TOLERANCE = 5e-14
#: Steps of the inner solver at most, and the share of its right side at which it stops.
INNER_STEPS, INNER_SHARE = 8, 0.02
#: Bytes of vectors in a block, and partial sums that the driver adds up itself.
BLOCK, PARTIALS = 1 << 20, 64

Product = Callable[[np.ndarray], np.ndarray]


def minres(apply: Product, right: np.ndarray, steps: int, share: float) -> np.ndarray:
    """Solves apply(x) = right for each column on its own, for a symmetric ``apply`` that takes all columns at once:
    Lanczos vectors, whose tridiagonal matrix is reduced by rotations as it grows (minimal residual)."""

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=b != 0)

    x, before, w, w_before = (np.zeros_like(right) for _ in range(4))
    first = np.linalg.norm(right, axis=0)
    v, rest, beta = over(right, np.broadcast_to(first, right.shape)), first.copy(), np.zeros_like(first)
    c, c_before, s, s_before = np.ones_like(first), np.ones_like(first), np.zeros_like(first), np.zeros_like(first)
    for _ in range(steps):
        p = apply(v)
        alpha = np.sum(v * p, axis=0)
        p = p - alpha * v - beta * before
        after = np.linalg.norm(p, axis=0)
        delta, upper, top = c * alpha - c_before * s * beta, s * alpha + c_before * c * beta, s_before * beta
        pivot = np.hypot(delta, after)
        c_before, s_before, c, s = c, s, over(delta, pivot), over(after, pivot)
        w_before, w = w, over(v - top * w_before - upper * w, np.broadcast_to(pivot, v.shape))
        x += c * rest * w
        rest = -s * rest
        before, v, beta = v, over(p, np.broadcast_to(after, p.shape)), after
        if np.all(np.abs(rest) <= share * first):
            break
    return x


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the orthonormal ``against``; what is lost in rounding is left out."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
        u, size, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, size > 1e-10]
    return block


def jacobi_davidson(product: Product, dims: int, wanted: int, guard: int = 8, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix that only ``product``
    (matrix times a block of columns) knows.

    Rayleigh-Ritz in a subspace gives candidates; leading ones whose residual is at ``TOLERANCE`` are locked and
    projected out; for the others MINRES solves the projected correction equations
    (I - QQ')(A - theta I)(I - QQ') t = -r, all at once, and the t extend the subspace.  ``guard`` candidates more than
    wanted are carried along, so that no large eigenvalue is passed over.  When the subspace has grown to all dimensions
    or to its limit it starts again from the best candidates.
    """
    wanted = min(wanted, dims)
    size = min(dims, wanted + guard)
    basis = _orthonormal(np.random.default_rng(1).standard_normal((dims, size)), np.zeros((dims, 0)))
    image = product(basis)
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    scale = 0.0
    for _ in range(rounds):
        h = basis.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz, moved = basis @ s, image @ s
        scale = max(scale, float(np.abs(theta).max(initial=0.0)))
        left = wanted - len(values)
        residual = moved[:, :left] - ritz[:, :left] * theta[:left]
        far = np.linalg.norm(residual, axis=0) > TOLERANCE * scale
        done = int(np.argmax(far)) if far.any() else left
        locked, values = np.hstack((locked, ritz[:, :done])), np.concatenate((values, theta[:done]))
        if len(values) == wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        basis, image, theta, residual = ritz[:, done:], moved[:, done:], theta[done:], residual[:, done:]
        left -= done
        if basis.shape[1] + left > max(2 * (wanted + guard), 32) or basis.shape[1] + len(values) >= dims:
            keep = min(basis.shape[1], size) if basis.shape[1] + len(values) < dims else basis.shape[1]
            basis = _orthonormal(basis[:, :keep], locked)
            image = product(basis)  # afresh: rotations add rounding errors
        if basis.shape[1] + len(values) < dims:
            shut = np.hstack((locked, ritz[:, done : done + left]))
            inside = lambda x, q=shut: x - q @ (q.T @ x)
            step = minres(lambda x, t=theta[:left]: inside(product(p := inside(x)) - t * p), -inside(residual), INNER_STEPS, INNER_SHARE)  # noqa: B023
            new = _orthonormal(inside(step), np.hstack((locked, basis)))
            new = new[:, : dims - len(values) - basis.shape[1]]
            basis, image = np.hstack((basis, new)), np.hstack((image, product(new)))
    raise ArithmeticError(f"{wanted - len(values)} of {wanted} eigenpairs have no residual of double precision after {rounds} rounds")


def distributed_sum(blocks: DataFrame, shape: tuple[int, ...], add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``add(block)`` over all blocks.

    Each task adds up its own; the driver adds up ``PARTIALS`` of them at most, further ones are first added up in
    groups.  Partial sums are taken in the order of the tasks, so that the result doesn't depend on chance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for raw in batch.column(0):
                total += add(np.frombuffer(raw.as_buffer(), np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def added(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = np.sum([np.frombuffer(x, np.float64) for x in table["total"].to_pylist()], axis=0)
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    partial = blocks.select("block").mapInArrow(run, "part int, total binary")
    if (parts := blocks.rdd.getNumPartitions()) > PARTIALS:
        width = -(-parts // PARTIALS)
        partial = partial.groupBy(F.expr(f"part div {width}")).applyInArrow(added, "part int, total binary")
    rows = sorted((r["part"], bytes(r["total"])) for r in partial.collect())  # PARTIALS rows at most
    return np.sum([np.frombuffer(x, np.float64) for _, x in rows], axis=0).reshape(shape) if rows else np.zeros(shape)


@dataclass
class Whitening:
    """Counts, sums and components of a table of whole-number vectors; ``components`` has a column per component."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float


def fixed_point(vector: Column, scale: int, offset: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + offset)


def whole_vectors(vectors: DataFrame, key: str, vector: str, scale: int, offset: int) -> DataFrame:
    """(key, x): floor(scale c) + offset for each entry c; rows without a vector or with a null or non-finite entry go."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & finite).select(F.col(key).alias("_key"), fixed_point(F.col(vector), scale, offset).alias("_x"))


def _blocks(rows: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    """Centred vectors, (n x - S) / n, as blocks of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // (8 * len(sums)))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, len(sums))
            for i in range(0, len(x), step):
                yield pa.RecordBatch.from_arrays([pa.array([((n * x[i : i + step] - sums) / n).tobytes()], pa.binary())], ["block"])

    return rows.select("_x").mapInArrow(run, "block binary")


def fitted(rows: DataFrame, wanted: int) -> Whitening | None:
    """Components of the rows (_key, _x) of ``whole_vectors``; None for a table without rows.

    Null for no component: only those with a variance above rounding (1e-12 of the largest) count.
    """
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("_x")).alias("a"), F.max(F.size("_x")).alias("b"), F.min(F.array_min("_x")).alias("low"), F.max(F.array_max("_x")).alias("high")).first()
    if not sizes["n"] or not sizes["b"]:
        return None
    n, dims = sizes["n"], sizes["b"]
    if sizes["a"] != dims:
        raise ValueError(f"vectors have {sizes['a']} to {dims} entries")
    if dims * (n * (sizes["high"] - sizes["low"])) ** 2 >= 1 << 63 or n * max(abs(sizes["high"]), abs(sizes["low"])) >= 1 << 62:
        raise ValueError("the deviations of these vectors don't fit into longs")
    each = rows.select(F.posexplode("_x").alias("d", "v")).groupBy("d").agg(F.sum("v").alias("s")).collect()  # a row per dimension
    sums = np.array([r["s"] for r in sorted(each)], np.int64)
    blocks = written(_blocks(rows, n, sums), "blocks")

    def product(u: np.ndarray) -> np.ndarray:
        def add(raw: np.ndarray) -> np.ndarray:
            c = raw.reshape(-1, dims)
            return c.T @ (c @ u)

        return distributed_sum(blocks, u.shape, add) / n

    trace = float(distributed_sum(blocks, (1,), lambda raw: np.dot(raw, raw).reshape(1))[0]) / n
    values, vectors = jacobi_davidson(product, dims, wanted) if trace > 0 else (np.zeros(0), np.zeros((dims, 0)))
    some = values > 1e-12 * max(values.max(initial=0.0), 0.0)
    values, vectors = values[some], vectors[:, some]
    k, onto = len(values), vectors / np.sqrt(values)
    mean = distributed_sum(blocks, (k,), lambda raw: (raw.reshape(-1, dims) @ onto).sum(0)) / n

    def gram(raw: np.ndarray) -> np.ndarray:
        w = raw.reshape(-1, dims) @ onto - mean
        return w.T @ w

    error = float(np.abs(distributed_sum(blocks, (k, k), gram) / n - np.eye(k)).max(initial=0.0))
    dropped(blocks)
    return Whitening(n, sums.tolist(), values, vectors, trace, error)


_SCHEMA = "n long, deviation long, component int, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): each vector on each of the ``components``
    largest principal components, divided by their standard deviations.

    Entries become whole numbers first, floor(scale c) + offset, so that means and deviations are exact; the fit list is
    every remaining row.  Matrix-free: no matrix of dimensions by dimensions is built anywhere, and the driver holds a
    few columns of that length.

    Rows whose vector is null or has a null or non-finite entry go; rows without a key and repeated rows stay and count
    each; equal eigenvalues have any basis of their space; components without variance are left out, so vectors that
    are all equal, a single vector and an empty table give no rows.  Vectors of different lengths, and vectors whose
    deviations pass 63 bits, are errors.  Other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors, key, vector, scale, offset), "vectors")
    kind = vectors.schema[key].dataType.simpleString()
    model = fitted(rows, components)
    if model is None or not len(model.values):
        dropped(rows)
        return spark.createDataFrame([], f"{key} {kind}, {_SCHEMA}").select(key, "component", "n", "deviation", "whitened", "explained", "identity_error")
    n, sums, onto = model.n, np.array(model.sums, np.int64), model.components / np.sqrt(model.values)
    sent = spark.sparkContext.broadcast(onto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = n * batch.column("_x").flatten().to_numpy().reshape(-1, len(sums)) - sums
            w = (c / n) @ sent.value
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array((c * c).sum(1), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], ["_key", "deviation", "w"])

    each = rows.mapInArrow(run, f"_key {kind}, deviation long, w array<double>").select("_key", "deviation", F.posexplode("w").alias("_i", "whitened"))
    shares = F.array(*(F.lit(float(v / model.trace)) for v in model.values))  # ``components`` numbers
    out = each.select(
        F.col("_key").alias(key), (F.col("_i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("_i")].alias("explained"), F.lit(model.identity_error).alias("identity_error")
    )
    return viewed(out, rows)
