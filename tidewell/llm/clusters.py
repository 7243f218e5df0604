"""Clusters around centroids, with whole numbers throughout and a filter of rotated coordinates.

Vectors become integers, ``floor(scale * x)``. They are rotated once onto the principal axes of all of
them, and each row keeps the leading rotated coordinates, which hold ``SHARE`` of the variance, and
the norm of the rest. For a
vector and a centroid, the squared distance of those coordinates plus the squared difference of the
rest norms is a lower bound of their squared distance, since a rotation keeps lengths. A round
computes the exact distance to the centroid of the smallest bound, and then to those centroids only
whose bound, less an allowance for rounding, does not exceed it. Distances and means are computed
in integers, so the filter cannot change a result.

Tasks send the sums of their own vectors per centroid, never vectors. The driver holds centroids and
sums, which are bounded by their number and dimension.

Nulls and edges: vectors that are null, of another length, or hold null or non-finite entries are
left out; scaled values beyond +-2^27 count as +-2^27, so that squared distances fit 64 bits; a null
vec_id comes last in the choice of first centroids; repeated rows are separate vectors, and equal ids
are chosen in order of their values; an empty table gives no rows, fewer vectors than centroids give
as many centroids as vectors; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

DIMENSION, CENTROIDS, ROUNDS, SCALE, SHARE = 64, 40, 5, 256, 0.8
LARGEST = 1 << 27
PAIRS = 1 << 14             # exact distances computed at once
PER_TASK = 20_000           # vectors that a task looks at, at least, where there are as many
ROTATED = "vec_id long, x array<int>, lead array<double>, rest double"


def finite(vector: Column) -> Column:
    """Whether a vector has values only that are neither null nor infinite nor NaN."""
    value = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, value), F.lit(False))


def whole_numbers(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id, x (integers) of the vectors that count."""
    number = lambda e: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(
        F.lit(float(LARGEST)), e.cast("double") * scale))).cast("int")
    return (vectors.where((F.size("embedding") == dimension) & finite(F.col("embedding")))
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform("embedding", number).alias("x")))


def matrix(column: pa.Array, kind: str = "int64") -> np.ndarray:
    """Lists of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def moments(rows: DataFrame, dimension: int) -> tuple[int, np.ndarray]:
    """How many vectors there are, and their scatter around the origin (rounded)."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((dimension + 1, dimension))
        for batch in batches:
            x = matrix(batch.column(0), "float64")
            n += len(x)
            total[:-1] += x.T @ x
            total[-1] += x.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([total.ravel()], pa.list_(pa.float64()))],
                names=["n", "total"])

    parts = stage(rows.select("x").mapInArrow(partial, "n long, total array<double>"), "scatter")
    n = parts.agg(F.sum("n")).first()[0] or 0
    sums = np.zeros(dimension * (dimension + 1))
    for place, value in (parts.select(F.posexplode("total")).groupBy("pos").agg(F.sum("col"))
                         .toLocalIterator()):
        sums[place] = value
    return n, sums.reshape(dimension + 1, dimension)


def rotation(rows: DataFrame, dimension: int, share: float = SHARE) -> tuple[np.ndarray, int]:
    """Principal axes of all vectors as columns, that of the largest variance first, and how many of
    them hold ``share`` of the variance."""
    n, sums = moments(rows, dimension)
    mean = sums[-1] / max(n, 1)
    values, axes = np.linalg.eigh(sums[:-1] / max(n, 1) - np.outer(mean, mean))
    held = np.cumsum(np.maximum(values[::-1], 0))
    return axes[:, ::-1], int(np.searchsorted(held, share * held[-1])) + 1


def rotated(x: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading rotated coordinates, and the norm of the others."""
    y = x @ axes
    return y[:, :leading], np.sqrt((y[:, leading:] ** 2).sum(1))


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray,
            c_lead: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the first of equals), squared distance, and how many were verified."""
    def exact(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        parts = [((x[i[s:s + PAIRS]] - centroids[k[s:s + PAIRS]]) ** 2).sum(1)
                 for s in range(0, len(i), PAIRS)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    own, other = (lead ** 2).sum(1), (c_lead ** 2).sum(1)
    bound = (own[:, None] + other - 2 * lead @ c_lead.T) + (rest[:, None] - c_rest) ** 2
    # far more than rounding can add to these sums of products
    allowance = 1e-9 * (own + rest ** 2)[:, None] + 1e-9 * (other + c_rest ** 2) + 1e-6
    rows, guess = np.arange(len(x)), bound.argmin(1)
    distance = np.full(bound.shape, np.iinfo(np.int64).max)
    distance[rows, guess] = least = exact(rows, guess)
    check = bound - allowance <= least[:, None]
    check[rows, guess] = False
    i, k = np.nonzero(check)
    distance[i, k] = exact(i, k)
    cluster = distance.argmin(1)
    return cluster, distance[rows, cluster], len(i) + len(rows)


class Centroids:
    """Integer centroids with what the filter needs of them."""

    def __init__(self, values: np.ndarray, axes: np.ndarray, leading: int):
        self.values, self.axes, self.leading = values, axes, leading
        self.lead, self.rest = rotated(values.astype(float), axes, leading)

    def assign(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors, their clusters and squared distances."""
        x = matrix(batch.column("x"))
        cluster, distance, _ = nearest(x, matrix(batch.column("lead"), "float64"),
                                       batch.column("rest").to_numpy(), self.values, self.lead,
                                       self.rest)
        return x, cluster, distance

    def moved(self, rows: DataFrame) -> Centroids:
        """The rounded-down means of the vectors nearest to each; those without any stay."""
        k, dimension = self.values.shape

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
            for batch in batches:
                x, cluster, _ = self.assign(batch)
                np.add.at(sums, cluster, x)
                counts += np.bincount(cluster, minlength=k)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(counts[some]),
                 pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

        total = (rows.mapInArrow(partial, "cluster int, n long, sums array<long>")
                 .groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[
                     F.sum(F.col("sums")[d]) for d in range(dimension)]).alias("sums")))
        values = self.values.copy()
        for cluster, n, sums in total.toLocalIterator():       # a row per centroid
            values[cluster] = [s // n for s in sums]
        return Centroids(values, self.axes, self.leading)


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors whose salted id has the smallest hash."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    chosen = rows.select("x", order.alias("order")).orderBy(
        F.col("order").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in chosen], np.int64)


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = "2:",
              dimension: int = DIMENSION, scale: int = SCALE, share: float = SHARE
              ) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of every vector that counts (staged), and the centroids."""
    def tasks(rows: DataFrame) -> DataFrame:
        """Many small files make no more tasks than their vectors are worth."""
        return rows.coalesce(max(1, rows.count() // PER_TASK))

    numbers = tasks(stage(whole_numbers(vectors, dimension, scale), "whole-numbers"))
    start = first_centroids(numbers, k, salt)
    if not len(start):
        return numbers.select("vec_id", F.lit(0).alias("cluster"),
                              F.lit(0).cast("long").alias("distance")), start
    axes, leading = rotation(numbers, dimension, share)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotated(matrix(batch.column(1), "float64"), axes, leading)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(lead), pa.list_(pa.float64())), pa.array(rest)],
                names=["vec_id", "x", "lead", "rest"])

    rows = tasks(stage(numbers.mapInArrow(turned, ROTATED), "rotated"))
    centroids = Centroids(start, axes, leading)
    for _ in range(rounds):
        centroids = centroids.moved(rows)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance = centroids.assign(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cluster", "distance"])

    return stage(rows.mapInArrow(final, "vec_id long, cluster int, distance long"),
                 "clusters"), centroids.values


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256."""
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda v: F.lit(v if v < 1 << 63 else None).cast("long")
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    if not sums:
        centroids = np.zeros((1, 1), np.int64)
    return assigned.select(
        "vec_id", "cluster", "distance",
        of([long(sums.get(k, 0)) for k in range(len(centroids))]).alias("cluster_inertia"),
        long(sum(sums.values())).alias("inertia"),
        of([F.lit(digest(c)) for c in centroids]).alias("centroid_sha256"))
