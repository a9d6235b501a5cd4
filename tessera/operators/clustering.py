"""Deterministic k-means over a DataFrame: farthest-first seeding, Lloyd passes, residuals.

Observations are held as a written table of (ord, x) and whatever else is to be kept, x the raw bytes of the float64 vector, so that a pass is a
narrow scan of two columns with numpy kernels. Only k centroids travel; a pass sends back one partial sum for each class and
partition; more than a few are added up by executors first. The seeding and the stop rule are part of the contract: largest norm first, then the row
farthest from the seeds, ties to the smallest ord; empty classes keep their centroid; on convergence the centroids
before the last update are kept.

Distances come from one matrix product; where the two nearest centroids are within its rounding error, direct differences decide.
A seeding pass compares with all seeds so far, which costs less than reading the rows does: nothing is carried from pass to pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import written

MAX_ITER = 64
EPS = 1e-12
#: Elements of the product of one step of a kernel.
_CHUNK = 4_000_000
#: Twice what a product of float64 vectors of a few thousand elements is off, in units of the squared lengths.
_ROUNDING = 1e-12
#: Partial sums the driver adds up itself.
MANY = 64


def stack_embeddings(rows: DataFrame) -> DataFrame:
    """The rows, checked: an embedding whose width differs from the first row's (by ord) is an error naming the row."""
    first = rows.select(F.min(F.struct("ord", F.size("embedding").alias("d"))).getField("d").alias("_d"))
    blame = F.raise_error(F.format_string("embedding dim mismatch: %s has %d, expected %d", "observation_id", F.size("embedding"), "_d")).cast("array<double>")
    return rows.crossJoin(F.broadcast(first)).withColumn("embedding", F.when(F.size("embedding") == F.col("_d"), F.col("embedding")).otherwise(blame)).drop("_d")  # one row


def matrix(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(ord, x) and the columns to keep: the written table that all passes scan, each only the columns it needs."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(x), *batch.columns[2:]], names=["ord", "x", *keep])

    schema = ", ".join(["ord bigint", "x binary", *(f"{c} {kinds[c]}" for c in keep)])
    return written(rows.select("ord", F.col("embedding").cast("array<double>"), *keep).mapInArrow(run, schema), "matrix")


def packed(x: np.ndarray) -> pa.Array:
    """Rows as binary values without a Python object for each."""
    x = np.ascontiguousarray(x, dtype=np.float64)
    offsets = np.arange(len(x) + 1, dtype=np.int64) * (8 * x.shape[1])
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)]).cast(pa.binary())


def rows_of(batch: pa.RecordBatch, column: int = 1) -> np.ndarray:
    raw = batch.column(column).to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 0))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest centroid of each row, ties to the lowest index."""
    label, far = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    length = (centroids**2).sum(axis=1)
    step = max(1, _CHUNK // max(1, len(centroids)))
    for lo in range(0, len(x), step):
        own = x[lo : lo + step]
        rough = length - 2 * own @ centroids.T  # less the row's own norm
        first = rough.argmin(axis=1)
        scale = (own**2).sum(axis=1) + length.max()
        close = rough <= (rough[np.arange(len(own)), first] + _ROUNDING * scale)[:, None]
        for i in np.flatnonzero(close.sum(axis=1) > 1):
            some = np.flatnonzero(close[i])
            first[i] = some[((own[i] - centroids[some]) ** 2).sum(axis=1).argmin()]
        label[lo : lo + step] = first
        far[lo : lo + step] = ((own - centroids[first]) ** 2).sum(axis=1)
    return label, far


def _farthest(x: DataFrame, chosen: np.ndarray | None) -> tuple[int, np.ndarray]:
    """(ord, vector) of the row farthest from the chosen ones; without any the one of largest norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, order = rows_of(batch), batch.column(0).to_numpy()
            far = np.linalg.norm(rows, axis=1) if chosen is None else nearest(rows, chosen)[1]
            at = np.flatnonzero(far == far.max())
            k = at[np.argmin(order[at])]
            if best is None or (-far[k], order[k]) < best[:2]:
                best = (-far[k], order[k], rows[k].tobytes())
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]]), pa.array([best[2]], pa.binary())], names=["far", "ord", "x"])

    top = x.select("ord", "x").mapInArrow(run, "far double, ord bigint, x binary").orderBy("far", "ord").first()  # far is negated
    return top["ord"], np.frombuffer(top["x"], dtype=np.float64)


def farthest_first(x: DataFrame, k: int) -> tuple[list[int], np.ndarray]:
    """(ords, vectors) of k seeds: one pass for each."""
    ords, points = [], None
    for _ in range(k):
        name, point = _farthest(x, points)
        ords.append(name)
        points = point[None] if points is None else np.concatenate([points, point[None]])
    return ords, points


def class_sums(x: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the rows nearest to each centroid."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, d + 1))
        for batch in batches:
            if batch.num_rows:
                rows = rows_of(batch)
                label, _ = nearest(rows, centroids)
                order = np.argsort(label, kind="stable")
                own, first = np.unique(label[order], return_index=True)
                total[own] += np.add.reduceat(np.c_[rows, np.ones(len(rows))][order], first, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    out = summed(x.select("ord", "x").mapInArrow(run, "part binary"), k * (d + 1)).reshape(k, d + 1)
    return out[:, :d], out[:, d]


def summed(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of arrays of ``width`` numbers, one for each partition; many are first added up in groups by the executors."""

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b, dtype=np.float64) for b in group.column("part").to_pylist()], axis=0)
        return pa.table({"part": pa.array([total.tobytes()], pa.binary())})

    if parts.rdd.getNumPartitions() > MANY:
        parts = parts.withColumn("k", F.spark_partition_id() % 32).groupBy("k").applyInArrow(add, "part binary")
    got = parts.collect()  # at most MANY arrays
    return np.sum([np.frombuffer(r["part"], dtype=np.float64) for r in got], axis=0) if got else np.zeros(width)


def lloyd(x: DataFrame, seeds: np.ndarray, max_iter: int = MAX_ITER) -> tuple[np.ndarray, np.ndarray, int]:
    """(labelling centroids, final centroids, iterations).

    Labels belong to the first, prototypes to the second: they differ if the iterations run out.
    """
    centroids, labelling = seeds.copy(), seeds
    for turn in range(1, max_iter + 1):
        labelling = centroids
        sums, n = class_sums(x, centroids)
        moved = centroids.copy()
        moved[n > 0] = sums[n > 0] / n[n > 0, None]
        if np.allclose(moved, centroids):
            return labelling, centroids, turn
        centroids = moved
    return labelling, centroids, max_iter


def assign(x: DataFrame, labelling: np.ndarray, prototypes: np.ndarray | None = None) -> DataFrame:
    """The kept columns of every row with class_id, distance2 to the nearest centroid (ties to the lowest class), and, against the prototype
    of its class: cosine, error2 (the squared difference) and norm2 (of the row). One narrow pass."""
    prototypes = labelling if prototypes is None else prototypes
    keep = [c for c in x.columns if c != "x"]
    kinds = dict(x.dtypes)
    length = np.sqrt((prototypes**2).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = rows_of(batch, 0)
            label, far = nearest(rows, labelling)
            own, norm2 = prototypes[label], (rows**2).sum(axis=1)
            both = np.sqrt(norm2) * length[label]
            cosine = np.where((np.sqrt(norm2) < EPS) | (length[label] < EPS), 0.0, (rows * own).sum(axis=1) / np.where(both > 0, both, 1.0))
            error2 = ((rows - own) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(label.astype(np.int32)), *map(pa.array, (far, cosine, error2, norm2))], names=[*keep, "class_id", "distance2", "cosine", "error2", "norm2"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "class_id int, distance2 double, cosine double, error2 double, norm2 double"])
    return x.select("x", *keep).mapInArrow(run, schema)


def kmeans(x: DataFrame, k: int, n: int, max_iter: int = MAX_ITER) -> tuple[DataFrame, np.ndarray, int]:
    """(assigned rows, centroids, iterations); k is clipped to [1, n]."""
    _, seeds = farthest_first(x, max(1, min(k, n)))
    labelling, centroids, turns = lloyd(x, seeds, max_iter)
    return assign(x, labelling, centroids), centroids, turns


def reconstruction_error(assigned: DataFrame) -> float:
    """Frobenius norm of rows minus their prototypes over that of the rows, from (error2, norm2); 0 where the rows vanish."""
    r = assigned.agg(F.sum("error2"), F.sum("norm2")).first()
    total = math.sqrt(r[1] or 0.0)
    return 0.0 if total <= EPS else math.sqrt(r[0]) / total


def gram(x: DataFrame) -> np.ndarray:
    """The d x d matrix of inner products, summed in batches and partitions before anything moves."""
    first = x.first()
    d = len(first["x"]) // 8 if first else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                rows = rows_of(batch)
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return summed(x.select("ord", "x").mapInArrow(run, "part binary"), d * d).reshape(d, d)


def svd_residual(x: DataFrame, rank: int, n: int) -> float:
    """Share of the Frobenius norm outside the leading ``rank`` singular directions, from the eigenvalues of the Gram matrix."""
    g = gram(x)
    if not g.size:
        return 0.0
    values = np.clip(np.linalg.eigvalsh(g)[::-1], 0.0, None)
    rank = max(1, min(rank, n, len(values)))
    total = values.sum()
    return 0.0 if np.sqrt(total) <= 1e-12 else float(np.sqrt(values[rank:].sum() / total))
