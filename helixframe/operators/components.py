"""Principal components of a long (sample, gene, value) table by randomised subspace iteration over blocks of the matrix.

The matrix is dealt out as blocks of about ``BLOCK`` x ``BLOCK`` cells; a tall matrix of few columns is a table of row
blocks.  Products of both are joins by block and sums by block.  The driver holds matrices of columns x columns only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

BLOCK = 256
#: Columns beyond those asked for, columns at least, rounds at most, and the change of the variances that ends them.
MORE, LEAST, ROUNDS, SETTLED = 10, 64, 60, 1e-12
#: Partial sums that the driver adds up itself.
PARTIALS = 64

TALL = "b int, size int, m binary"


def numbered(keys: DataFrame, key: str, count: int) -> DataFrame:
    """(key, b, i, size): blocks by hash, places inside a block in order of the key."""
    rows = keys.select(key).distinct().withColumn("b", F.pmod(F.xxhash64(key), F.lit(max(1, -(-count // BLOCK)))).cast("int"))
    block = W.partitionBy("b")  # about BLOCK rows
    return rows.select(key, "b", (F.row_number().over(block.orderBy(key)) - 1).alias("i"), F.count(F.lit(1)).over(block).cast("int").alias("size"))


def _cells(raw: pa.Scalar, size: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.float64).reshape(size, -1) if size else np.zeros((0, 0))


def mapped(tall: DataFrame, f: Callable[[int, np.ndarray], np.ndarray], schema: str = TALL) -> DataFrame:
    """``f(block number, rows)`` of each row block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, size, raw in zip(batch["b"].to_pylist(), batch["size"].to_pylist(), batch["m"], strict=True):
                out = np.ascontiguousarray(f(b, _cells(raw, size)))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([size], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["b", "size", "m"])

    return tall.select("b", "size", "m").mapInArrow(run, schema)


def filled(places: DataFrame, f: Callable[[int, int], np.ndarray]) -> DataFrame:
    """Row blocks ``f(block number, size)`` for the blocks of ``numbered``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [f(b, size).tobytes() for b, size in zip(batch["b"].to_pylist(), batch["size"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["b"], batch["size"], pa.array(cells, pa.binary())], ["b", "size", "m"])

    return places.select("b", "size").distinct().mapInArrow(run, TALL)


def beside(tall: DataFrame, column: DataFrame) -> DataFrame:
    """Row blocks with those of a single column behind them; ``_apart`` parts them."""
    return tall.join(column.select("b", F.col("m").alias("c")), "b").select("b", "size", F.concat("m", "c").alias("m"))


def summed(tall: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``f(rows)`` over all row blocks, added up per task, per group of tasks if there are many, then here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for size, raw in zip(batch["size"].to_pylist(), batch["m"], strict=True):
                one = f(_cells(raw, size))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([str(list(total.shape))]), pa.array([total.astype(float).tobytes()], pa.binary())], ["part", "shape", "m"])

    def added(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = np.sum([np.frombuffer(x, np.float64) for x in table["m"].to_pylist()], axis=0)
        return pa.table({"part": table["part"][:1], "shape": table["shape"][:1], "m": pa.array([total.tobytes()], pa.binary())})

    kind = "part int, shape string, m binary"
    parts = tall.select("size", "m").mapInArrow(run, kind)
    if parts.rdd.getNumPartitions() > PARTIALS:
        parts = parts.groupBy(F.col("part") % PARTIALS).applyInArrow(added, kind)
    rows = sorted((r["part"], r["shape"], bytes(r["m"])) for r in parts.collect())  # PARTIALS rows at most
    shape = [int(x) for x in rows[0][1].strip("[]").split(",") if x.strip()]
    return np.sum([np.frombuffer(m, np.float64) for _, _, m in rows], axis=0).reshape(shape)


def matrix_blocks(assay: DataFrame, samples: DataFrame, genes: DataFrame, sample: str, gene: str, value: str) -> DataFrame:
    """(sb, gb, rows, columns, i, j, v): the cells of each block, means of repeated ones."""
    cells = assay.where(F.col(value).isNotNull()).groupBy(sample, gene).agg(F.avg(value).cast("double").alias("v"))
    told = cells.join(genes.select(gene, F.col("b").alias("gb"), F.col("i").alias("j"), F.col("size").alias("columns")), gene)
    told = told.join(samples.select(sample, F.col("b").alias("sb"), "i", F.col("size").alias("rows")), sample)
    held = F.collect_list(F.struct("i", "j", "v"))
    blocks = told.groupBy("sb", "gb", "rows", "columns").agg(held.alias("h"))
    return blocks.select("sb", "gb", "rows", "columns", F.col("h.i").alias("i"), F.col("h.j").alias("j"), F.col("h.v").alias("v"))


def product(blocks: DataFrame, tall: DataFrame, turned: bool) -> DataFrame:
    """Matrix times ``tall`` (a row block per gene block), or the matrix turned round times ``tall`` (per sample block)."""
    inner, outer = ("sb", "gb") if turned else ("gb", "sb")
    joined = blocks.join(tall.select(F.col("b").alias(inner), "m"), inner).withColumn("outer", F.col(outer)).sortWithinPartitions("outer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([len(total)], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["b", "size", "m"])
        for batch in batches:
            for k in range(batch.num_rows):
                b, rows, columns = (batch[c][k].as_py() for c in ("outer", "rows", "columns"))
                block = np.zeros((rows, columns))
                block[batch["i"][k].values.to_numpy(), batch["j"][k].values.to_numpy()] = batch["v"][k].values.to_numpy()
                block = block.T if turned else block
                one = block @ _cells(batch["m"][k], block.shape[1])
                if last is not None and b != last:
                    yield row()
                    total = None
                last, total = b, one if total is None else total + one
        if total is not None:
            yield row()

    def added(table: pa.Table) -> pa.Table:
        parts = sorted(table["m"].to_pylist())  # one order, whatever the order of arrival
        total = np.sum([np.frombuffer(x, np.float64) for x in parts], axis=0)
        return pa.table({"b": table["b"][:1], "size": table["size"][:1], "m": pa.array([total.tobytes()], pa.binary())})

    return joined.mapInArrow(run, TALL).groupBy("b").applyInArrow(added, TALL)


def turned_to_units(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of a Gram matrix, and what turns its columns into unit ones at right angles; lost ones go."""
    values, vectors = np.linalg.eigh(gram)
    some = values > 1e-13 * max(values.max(initial=0.0), 1e-300)
    return values[::-1], (vectors[:, some] / np.sqrt(values[some]))[:, ::-1]


def orthonormal(tall: DataFrame) -> DataFrame:
    """Unit columns at right angles that span the same space."""
    turn = turned_to_units(summed(tall, lambda m: m.T @ m))[1]
    return mapped(tall, lambda b, m: m @ turn)


def principal_components(assay: DataFrame, k: int = 2, sample: str = "sample_id", gene: str = "gene", value: str = "value") -> tuple[DataFrame, list[tuple[float, float]]]:
    """((sample, components), [(variance, share of all variance)]) of the min(k, genes, samples) largest components.

    Cells that are missing or null are 0; genes are centred, but not scaled; the sign of a component is free.  Equal
    variances have any basis of their space; a table without variance has no components.  No genes x genes matrix is
    made: the work is products of the matrix with few columns, of which there are 2 k + 10, 64 at least.
    """
    held = assay.select(sample, gene, value)
    n, d = (held.agg(F.count_distinct(sample), F.count_distinct(gene)).first())[:2]
    if not n or not d:
        return held.select(sample, F.array().cast("array<double>").alias("components")).limit(0), []
    samples, genes = (written(numbered(held.where(F.col(c).isNotNull()), c, m), "numbers") for c, m in ((sample, n), (gene, d)))
    blocks = written(matrix_blocks(held, samples, genes, sample, gene, value), "blocks")
    ones = filled(samples, lambda b, size: np.ones((size, 1)))
    means = written(mapped(product(blocks, ones, True), lambda b, m: m / n), "means")
    squares = blocks.select(F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    total = squares - n * float(summed(means, lambda m: m.T @ m)[0, 0])
    if total <= 1e-14 * squares:
        return samples.select(sample, F.array().cast("array<double>").alias("components")), []
    columns = min(n, d, max(2 * k + MORE, LEAST))

    def centred_product(vectors: DataFrame) -> DataFrame:
        shift = summed(beside(vectors, means), lambda m: np.dot(*reversed(_apart(m))))
        return mapped(product(blocks, vectors, False), lambda b, m: m - shift)

    def centred_turned(vectors: DataFrame) -> DataFrame:
        sums = summed(vectors, lambda m: m.sum(0))
        return mapped(beside(product(blocks, vectors, True), means), lambda b, m: _apart(m)[0] - np.outer(_apart(m)[1], sums))

    basis = orthonormal(written(filled(genes, lambda b, size: np.random.default_rng([7, b]).standard_normal((size, columns))), "basis"))
    before = np.zeros(0)
    for _ in range(ROUNDS):
        left = orthonormal(written(centred_product(basis), "left"))
        right = written(centred_turned(left), "right")
        values, turn = turned_to_units(summed(right, lambda m: m.T @ m))
        if columns == min(n, d) or len(before) == len(values) and np.abs(values - before)[:k].max() <= SETTLED * values[0]:
            break
        before, basis = values, mapped(right, lambda b, m, t=turn: m @ t)
    left = orthonormal(written(left, "left"))  # once more, for what the first time has left
    values, vectors = np.linalg.eigh(summed(written(centred_turned(left), "right"), lambda m: m.T @ m))
    values, vectors = values[::-1], vectors[:, ::-1]
    some = int((values[: min(k, n, d)] > 1e-12 * values[0]).sum())
    turn = vectors[:, :some] * np.sqrt(values[:some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, size, raw in zip(batch["b"].to_pylist(), batch["size"].to_pylist(), batch["m"], strict=True):
                scores = _cells(raw, size) @ turn
                offsets = pa.array(np.arange(size + 1, dtype=np.int32) * some)
                yield pa.RecordBatch.from_arrays([pa.array([b] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(scores.ravel()))], ["b", "i", "components"])

    scores = left.select("b", "size", "m").mapInArrow(run, "b int, i int, components array<double>")
    variances = [(float(v) / max(n - 1, 1), float(v) / total) for v in values[:some]]
    return samples.join(scores, ["b", "i"]).select(sample, "components"), variances


def _apart(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row block and a single column, from the bytes of one after those of the other."""
    flat = joined.reshape(-1)
    size = len(joined)
    return flat[:-size].reshape(size, -1), flat[-size:]
