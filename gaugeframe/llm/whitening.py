"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers, so sums, the scatter around a whole-number centre and its correction to the mean are
exact whatever the partitioning. The centred scatter is factorised with diagonal pivoting; Jacobi rotations then make the
columns of the triangular factor orthogonal. Their squared norms are the eigenvalues and the normalised columns, put
back in the order of the dimensions, the components; the scatter itself is never diagonalised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import bounded_batches
from gaugeframe.runtime import scratch, tune

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
SWEEPS = 60
EXACT = 1 << 53
LARGEST = 1 << 40          # entries beyond this are refused: their sums could leave 64 bits


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """A lower-trapezoidal factor whose rows are in the order of the dimensions; columns end at the numerical rank."""
    rest = scatter.astype(np.longdouble)
    size = len(rest)
    factor, open_rows = np.zeros((size, size), dtype=np.longdouble), np.ones(size, dtype=bool)
    least = np.finfo(np.longdouble).eps * size * max(rest.diagonal().max(initial=0), 0) * 8
    for k in range(size):
        diagonal = np.where(open_rows, rest.diagonal(), -1)
        pivot = int(diagonal.argmax())
        if diagonal[pivot] <= least:
            return factor[:, :k].astype(np.float64)
        column = np.where(open_rows, rest[:, pivot], 0) / np.sqrt(diagonal[pivot])
        factor[:, k] = column
        rest -= np.outer(column, column)
        open_rows[pivot] = False
    return factor.astype(np.float64)


def one_sided_jacobi(factor: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Squared column norms in falling order and the normalised columns, after rotations that make the columns orthogonal."""
    g = np.ascontiguousarray(factor.T)          # one row per column of the factor
    least = np.finfo(np.float64).eps * np.sqrt(max(1, g.shape[1]))
    for _ in range(sweeps):
        turned = False
        for i in range(len(g) - 1):
            for j in range(i + 1, len(g)):
                a, b, c = g[i] @ g[i], g[j] @ g[j], g[i] @ g[j]
                if abs(c) <= least * np.sqrt(a * b):
                    continue
                turned = True
                zeta = (b - a) / (2 * c)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                cosine = 1 / np.hypot(1.0, t)
                sine = cosine * t
                g[i], g[j] = cosine * g[i] - sine * g[j], sine * g[i] + cosine * g[j]
        if not turned:
            break
    norms = (g * g).sum(1)
    order = np.argsort(-norms, kind="stable")
    g, norms = g[order], norms[order]
    return norms, (g / np.sqrt(norms)[:, None]).T


@dataclass
class Whitening:
    n: int
    sums: list[int]
    eigenvalues: np.ndarray          # of the covariance, falling
    components: np.ndarray           # one column each
    trace: float


def _numbers(column: pa.Array, size: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)
    if x.size and max(int(x.max()), -int(x.min())) > LARGEST:
        raise ValueError(f"entries beyond {LARGEST} after scaling are not supported")
    return x


def _gram(y: np.ndarray) -> np.ndarray:
    """Products of whole numbers, exactly: in doubles where no sum can pass 2^53, else in integers of any size."""
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * max(1, len(y)) < EXACT:
        return np.rint(y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64)
    wide = y.astype(object)
    return wide.T @ wide


def fit(distinct: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """The leading components of the distinct vectors in column x.

    The driver receives the sums and the scatter, size * (size + 1) / 2 numbers. There are no more components than the rank.
    """
    sums = distinct.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]).first()
    n, total = sums["n"], [int(sums[f"s{i}"] or 0) for i in range(size)]
    if not n or not size:
        return Whitening(n, total, np.zeros(0), np.zeros((size, 0)), 0.0)
    centre = np.array([s // n for s in total], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            if batch.num_rows:
                part = _gram(_numbers(batch.column("x"), size) - centre).astype(object)
                whole = part if whole is None else whole + part
        if whole is not None:
            up = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(up[0] * size + up[1]), pa.array([str(v) for v in whole[up]])], names=["place", "product"])

    products = distinct.select("x").mapInArrow(run, "place bigint, product string")
    scatter = np.zeros((size, size), dtype=object)
    for row in products.groupBy("place").agg(F.sum(F.col("product").cast("decimal(38,0)")).alias("product")).collect():
        i, j = divmod(row["place"], size)
        scatter[i, j] = scatter[j, i] = int(row["product"])
    left = np.array([s - n * int(c) for s, c in zip(total, centre)], dtype=object)          # what the whole-number centre misses, times n
    exact = n * scatter - np.outer(left, left)                                              # n^2 times the covariance
    covariance = np.array([[np.longdouble(v) for v in row] for row in exact], dtype=np.longdouble) / np.longdouble(n) ** 2
    values, vectors = one_sided_jacobi(pivoted_cholesky(covariance))
    k = min(components, len(values))
    return Whitening(n, total, values[:k], vectors[:, :k], float(covariance.trace()))


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    """(x - mean) on the components over the roots of the eigenvalues; n * x - sums is formed in whole numbers."""
    return (_deviations(x, model).astype(np.float64) / model.n) @ (model.components / np.sqrt(model.eigenvalues))


def _deviations(x: np.ndarray, model: Whitening) -> np.ndarray:
    most = model.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, model.sums), default=0)
    if most < 1 << 62:
        return model.n * x - np.array(model.sums, dtype=np.int64)
    return model.n * x.astype(object) - np.array(model.sums, dtype=object)


def _squares(deviations: np.ndarray) -> list[int | None]:
    """Exact sums of squares per row; null where the sum does not fit in 64 bits."""
    if deviations.dtype != object and int(np.abs(deviations).max(initial=0)) ** 2 * max(1, deviations.shape[1]) < 1 << 63:
        return (deviations * deviations).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in deviations)]


def identity_error(distinct: DataFrame, model: Whitening, size: int) -> float:
    """The largest absolute entry of the covariance of the whitened distinct vectors minus the identity, measured on all of them."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = project(_numbers(batch.column("x"), size), shared.value)
                sums += w.sum(0)
                products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.concatenate([sums, products.ravel()]))], names=["place", "v"])

    total = np.zeros(k * k + k)
    for row in distinct.select("x").mapInArrow(run, "place bigint, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():
        total[row["place"]] = row["v"]
    means, products = total[:k] / model.n, total[k:].reshape(k, k) / model.n
    return float(np.abs(products - np.outer(means, means) - np.eye(k)).max())


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, one row per input row and component.

    An entry c counts as floor(64 * c) + 1000000. The model is fitted on every distinct vector once. Entries that a
    vector lacks against the longest count as c = 0. Repeated rows are separate rows; null ids stay. There are as many components as
    the distinct vectors have directions, so none (and no rows) for an empty table or equal vectors. ``deviation`` is null
    where it does not fit in 64 bits. The vectors must be free of nulls and non-finite entries.
    """
    spark = tune(vectors.sparkSession)
    bounded_batches(spark)
    kind = vectors.schema[vec_id].dataType.simpleString()
    size = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    whole = F.transform(F.col(vector), lambda c: F.floor(F.lit(SCALE) * c.cast("double")) + OFFSET)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.concat(whole, F.array_repeat(F.lit(OFFSET).cast("bigint"), F.lit(size) - F.size(vector))).alias("x"))
    folder = scratch(spark, "whitening")
    rows.select("x").distinct().write.parquet(folder)
    distinct = spark.read.schema("x array<bigint>").parquet(folder)
    model = fit(distinct, size, components)
    error, k = identity_error(distinct, model, size), len(model.eigenvalues)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _numbers(batch.column("x"), size)
            times = np.repeat(np.arange(len(x)), k)
            squares = pa.array(_squares(_deviations(x, own)), pa.int64()).take(pa.array(times))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(times), own.n, dtype=np.int64)), squares, pa.array(project(x, own).ravel()),
                 pa.array(np.tile(own.eigenvalues / own.trace, len(x))), pa.array(np.full(len(times), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
