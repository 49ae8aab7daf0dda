"""Whitening of embeddings by a randomised range finder and a Rayleigh-Ritz step.

The covariance is never formed unless it has to be: a pass over all rows takes a thin basis Q to V Q, the covariance times Q,
as the sum of each centred row times its product with Q. Passes alternate with orthonormalisation on the driver, where a
matrix has as many rows as a vector has entries. After each pass the Rayleigh-Ritz pairs of the basis are taken, and
their residuals |V u - e u| say whether they are eigenpairs to double precision. If they aren't after the allowed passes,
the basis is expanded to the full dimension, where Rayleigh-Ritz is exact.

Entries are whole numbers x (embeddings in fixed point), so sums are exact and a centred entry (n x - S) / n is rounded once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonara.llm.common import map_batches, written

#: Columns of the basis beyond the components asked for; passes before the full dimension is taken.
OVERSAMPLING, PASSES = 10, 4
#: Residuals up to this part of the largest eigenvalue count as none: what is left by rounding in sums of doubles.
TOLERANCE = 1e-12
#: Tasks that add up the tasks' partial matrices: this many matrices at most reach the driver, whatever the input's size.
ADDERS = 32
#: Rows that are centred and multiplied at a time.
BLOCK = 8192


def fixed_point(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(id, x array<bigint>): floor(scale * c) + offset for the rows whose vector is complete.

    Left out are null vectors and those that hold a null or non-finite entry; a vector shorter than the table's longest lacks
    entries, so it counts as holding nulls. Repeated rows and null ids stay. An entry beyond the range of long is an error.
    """
    rows = df.select(df[id_col].cast("bigint").alias("id"), df[vector_col].cast("array<double>").alias("v"))
    size = rows.agg(F.max(F.size("v"))).first()[0] or 0
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform("v", lambda c: F.floor(c * scale) + F.lit(offset).cast("bigint"))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") == size) & (F.size("v") > 0)).filter(sound).select("id", whole.alias("x"))


def matrix(vectors: pa.Array) -> np.ndarray:
    """The rows of a list column as a matrix of 64-bit integers."""
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _added(df: DataFrame, of_rows: Callable[[np.ndarray], np.ndarray], zero: np.ndarray) -> np.ndarray:
    """The sum over all rows of of_rows(block of rows), an array like zero.

    Each task adds its blocks up, ADDERS tasks add those sums in the order of the tasks, and the driver adds theirs, so the
    result does not depend on which task ends first.
    """
    kind = zero.dtype

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = zero.copy(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                total += of_rows(matrix(batch.column(0).slice(at, BLOCK)))
                rows += 1
        if rows:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "sum": [total.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = zero.copy(), None
        for batch in batches:
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = number if part is None else part
                total += np.frombuffer(value, dtype=kind).reshape(zero.shape)
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "sum": [total.tobytes()]})

    schema = "part bigint, sum binary"
    parts = map_batches(df.select("x"), partial, schema)
    sums = map_batches(parts.repartition(ADDERS, F.pmod("part", F.lit(ADDERS))).sortWithinPartitions("part"), add, schema)
    total = zero.copy()
    for _, value in sorted((r.part, r.sum) for r in sums.collect()):
        total += np.frombuffer(value, dtype=kind).reshape(zero.shape)
    return total


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows less the mean: exact whole numbers n x - S, divided once. Raises where n x does not fit into 64 bits."""
    return exact_deviations(x, n, sums) / n


def exact_deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    if len(x) and int(np.abs(x).max()) * n >= 1 << 62:
        raise OverflowError("n * x does not fit into 64 bits")
    return x * n - sums


def squared_deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Each row's sum of (n x - S)^2 as a long; raises where it is none."""
    d = exact_deviations(x, n, sums)
    if len(d) and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
        exact = [sum(int(v) ** 2 for v in row) for row in d]
        if max(exact) >= 1 << 63:
            raise OverflowError("a row's squared deviation does not fit into 64 bits")
        return np.array(exact, dtype=np.int64)
    return (d * d).sum(axis=1)


@dataclass
class Whitening:
    """What rows need to be whitened: components are columns, by falling eigenvalue. `full` says that the basis was expanded;
    passes counts the products with the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int
    full: bool

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if self.trace > 0 else np.zeros_like(self.eigenvalues)

    def scaled(self) -> np.ndarray:
        """Components over the root of their eigenvalues; zero where a component has no variance."""
        top = self.eigenvalues.max(initial=0.0)
        some = self.eigenvalues > len(self.sums) * np.finfo(float).eps * top
        return np.where(some, self.components / np.sqrt(np.where(some, self.eigenvalues, 1.0)), 0.0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.scaled()


def fit(x: DataFrame, most: int = 32, oversampling: int = OVERSAMPLING, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = 12) -> Whitening | None:
    """The whitening of rows (x array<bigint> of equal lengths); None without rows.

    Components with equal eigenvalues are some orthonormal basis of their space. Fewer components than `most` if vectors are
    shorter. Residuals are compared with the spectrum's smallest eigenvalue asked for as well, by their size against the top.
    """
    size = x.agg(F.max(F.size("x"))).first()[0]
    if not size:
        return None
    head = _added(x, lambda rows: np.append(rows.sum(axis=0), len(rows)), np.zeros(size + 1, dtype=np.int64))
    sums, n = head[:-1], int(head[-1])

    def product(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """(V basis, trace of V) by one pass over all centred rows."""

        def of_rows(rows: np.ndarray) -> np.ndarray:
            c = centred(rows, n, sums)
            return np.append((c.T @ (c @ basis)).ravel(), (c * c).sum())

        found = _added(x, of_rows, np.zeros(basis.size + 1))
        return found[:-1].reshape(basis.shape) / n, float(found[-1]) / n

    count, width = min(most, size), min(size, most + oversampling)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    done = 0
    while True:
        full = basis.shape[1] == size
        image, trace = product(basis)
        done += 1
        ritz = basis.T @ image
        values, turns = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        residual = np.linalg.norm(image @ turns - basis @ turns * values, axis=0)[:count]
        if full or residual.max() <= tolerance * max(values[0], 0.0):
            break
        if done >= passes:
            basis = np.linalg.qr(np.hstack([basis @ turns, np.random.default_rng(seed + 1).standard_normal((size, size - width))]))[0]
        else:
            basis = np.linalg.qr(image)[0]
    return Whitening(n, sums, basis @ turns[:, :count], np.maximum(values[:count], 0.0), trace, done, full)


def identity_error(x: DataFrame, whitening: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, over the components with variance."""
    some = np.flatnonzero(np.abs(whitening.scaled()).max(axis=0) > 0)

    def of_rows(rows: np.ndarray) -> np.ndarray:
        w = whitening.whiten(rows)[:, some]
        return np.vstack([w.T @ w, w.sum(axis=0)])

    if not len(some):
        return 0.0
    found = _added(x, of_rows, np.zeros((len(some) + 1, len(some)))) / whitening.n
    return float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(len(some))).max())  # rows come centred; the mean is rounding


def whitened(x: DataFrame, whitening: Whitening) -> DataFrame:
    """(id, deviation, whitened array<double>) of rows (id, x); one row for each row, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows = matrix(part.column(1))
                w = whitening.whiten(rows)
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel()))
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "deviation": pa.array(squared_deviations(rows, whitening.n, whitening.sums)), "whitened": lists})

    return map_batches(x.select("id", "x"), run, "id bigint, deviation bigint, whitened array<double>")


def whitening_rows(df: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row for each complete vector and component.

    Which rows are complete, and that repeated rows and null ids count, is as in fixed_point; extra columns are not read. A
    component without variance has 0 for whitened and explained. A table without complete vectors gives no rows. What
    reaches the driver is a few matrices of the vectors' dimension; the fixed-point table is written once and read by each
    pass.
    """
    spark = df.sparkSession
    x, _ = written(fixed_point(df, id_col, vector_col), "fixed")
    found = fit(x, most)
    schema = f"{id_col} bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if found is None:
        return spark.createDataFrame([], schema)
    error = identity_error(x, found)
    rows = whitened(x, found).select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    shares = F.array(*(F.lit(float(v)) for v in found.explained))
    return rows.select(F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(found.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
