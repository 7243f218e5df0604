"""Whitened embeddings: principal axes by rank-one updates of an eigendecomposition.

Every partition holds the spectrum (eigenvalues and eigenvectors) of the scatter of its vectors
around their mean. A vector adds a rank-one term, centred on the mean so far. The new eigenvalues
are the roots of a secular equation, one between each two old ones; entries that cannot move an
eigenvalue, and all but one direction of equal eigenvalues, are deflated first. The eigenvectors
follow from the roots by the formula of Gu and Eisenstat, which keeps them orthogonal. Spectra of
partitions are combined in a tree, a few at a time, by the same updates: one for each eigenvalue of
the other and one for the distance of the means. A last pass over all vectors refines the result: it
sums the products of their centred projections on the combined axes, and the small eigenproblem of
that sum turns the axes (Rayleigh-Ritz).

Nulls and edges: vectors that are null or empty, or hold null or non-finite entries, are left out,
and so are those of another length than most have (of equally frequent lengths the larger
counts); numbers beyond +-2^31 count as +-2^31; a null vec_id is kept; repeated rows are separate
vectors; an axis without variance has explained 0 and no whitened value, and identity_error leaves it
out; a deviation beyond 64 bits is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import finite, matrix
from .common import stage

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LARGEST = 1 << 31
FAN_IN = 8                  # spectra that one task combines
EPS = float(np.finfo(float).eps)
SPECTRUM = "part int, n long, mean array<double>, spectrum array<double>, axes array<double>"
RESULT = ("vec_id long, component int, n long, deviation long, whitened double, "
          "explained double, identity_error double")


def whole_numbers(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x (integers) of the vectors that count."""
    number = lambda e: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(
        F.lit(float(LARGEST)), e.cast("double") * scale))) + F.lit(shift).cast("long")
    rows = stage(vectors.where(finite(F.col("embedding")) & (F.size("embedding") > 0))
                 .select(F.col("vec_id").cast("long").alias("vec_id"),
                         F.transform("embedding", number).alias("x")), "whole-numbers")
    usual = (rows.groupBy(F.size("x").alias("size")).count()
             .orderBy(F.desc("count"), F.desc("size")).first())
    return rows.where(F.size("x") == (usual["size"] if usual else 0))


def secular_roots(d: np.ndarray, z2: np.ndarray) -> np.ndarray:
    """``d - root`` for every root of 1 + sum(z2 / (d - t)) = 0, as rows; d ascending and distinct.

    Root j lies above d[j] and below d[j + 1]. Each is sought as its distance from the nearer of
    the two, by steps that solve the equation of two poles, and by halving where a step leaves the
    bracket.
    """
    k = len(d)
    above = np.append(d[1:], d[-1] + z2.sum())
    middle = (d + above) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        nearer_left = 1 + (z2 / (d - middle[:, None])).sum(1) >= 0
        nearer_left[-1] = True
        origin = np.where(nearer_left, d, above)
        poles = d - origin[:, None]                      # row j: poles seen from root j's origin
        low = np.where(nearer_left, 0, (d - above) / 2)  # bracket of the root, from its origin
        high = np.where(nearer_left, (above - d) / 2, 0)
        high[-1] = above[-1] - d[-1]
        low_pole = np.diag(poles)
        high_pole = np.append(np.diagonal(poles, 1), np.inf)
        left = np.tri(k, dtype=bool)                     # poles up to d[j]
        t = (low + high) / 2
        for _ in range(80):
            gap = poles - t[:, None]
            term = z2 / gap
            slope = term / gap
            psi, phi = (term * left).sum(1), (term * ~left).sum(1)
            value = 1 + psi + phi
            noise = EPS * k * (1 + np.abs(psi) + np.abs(phi))
            if (np.abs(value) <= noise).all():
                break
            low, high = np.where(value < 0, t, low), np.where(value > 0, t, high)
            dpsi, dphi = (slope * left).sum(1), (slope * ~left).sum(1)
            p, q = low_pole - t, high_pole - t
            c = 1 + psi - p * dpsi + np.where(np.isinf(q), 0, phi - q * dphi)
            s, r = p * p * dpsi, q * q * dphi
            a = c * (p + q) + s + r
            b = p * q * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
            step[-1] = p[-1] + s[-1] / c[-1]
            new = t + step
            inside = (new > low) & (new < high)          # false for NaN as well
            new = np.where(inside, new, (low + high) / 2)
            done = (np.abs(value) <= noise) | (new == t)
            if done.all():
                break
            t = np.where(done, t, new)
        gap = poles - t[:, None]
    return gap


def rank_one(values: np.ndarray, axes: np.ndarray, weight: float, vector: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``axes diag(values) axes' + weight vector vector'``; values ascending."""
    z = axes.T @ vector * np.sqrt(weight)
    size = float(z @ z)
    if not size:
        return values, axes
    limit = 8 * EPS * max(float(values[-1]), size)
    # equal eigenvalues: turn their axes so that one of them has all of z
    new_group = np.flatnonzero(np.diff(values) > limit) + 1
    if len(new_group) + 1 < len(values):
        z, axes = z.copy(), axes.copy()
        for g in np.split(np.arange(len(values)), new_group):
            if len(g) > 1 and (norm := np.sqrt(z[g] @ z[g])) > 0:
                mirror = z[g].copy()
                mirror[-1] += norm if mirror[-1] >= 0 else -norm
                axes[:, g] -= np.outer(axes[:, g] @ mirror, mirror) * (2 / (mirror @ mirror))
                sign = -1 if z[g[-1]] >= 0 else 1
                z[g] = 0
                z[g[-1]] = sign * norm
    active = np.flatnonzero(np.abs(z) * np.sqrt(size) > limit)
    if not len(active):
        return values, axes
    d, own = values[active], z[active]
    gap = secular_roots(d, own * own)                    # d[i] - root[j], by rows j
    roots = d - np.diagonal(gap)                         # diagonal: d[j] - root[j]
    # z for which these roots are exact
    between = d[:, None] - d
    np.fill_diagonal(between, 1)
    ratio = gap / between.T                              # row j, column i: / (d[i] - d[j])
    exact = np.sqrt(np.abs(np.prod(ratio, 0))) * np.sign(own)
    turn = exact / gap
    turn /= np.sqrt((turn * turn).sum(1))[:, None]
    values, axes = values.copy(), axes.copy()
    values[active], axes[:, active] = roots, axes[:, active] @ turn.T
    order = np.argsort(values, kind="stable")
    return values[order], axes[:, order]


class Spectrum:
    """Number, mean and scatter (as eigenvalues and axes) of some vectors."""

    def __init__(self, dimension: int):
        self.n, self.mean = 0, np.zeros(dimension)
        self.values, self.axes = np.zeros(dimension), np.eye(dimension)

    def add(self, x: np.ndarray) -> None:
        self.shift(x - self.mean, 1)

    def shift(self, distance: np.ndarray, n: int) -> None:
        """``n`` vectors join whose mean is ``distance`` away; their own scatter is not counted."""
        total = self.n + n
        if self.n:
            self.values, self.axes = rank_one(self.values, self.axes, self.n * n / total, distance)
        self.mean = self.mean + distance * (n / total)
        self.n = total

    def join(self, other: Spectrum) -> None:
        for value, axis in zip(other.values, other.axes.T):
            if value > 0:
                self.values, self.axes = rank_one(self.values, self.axes, value, axis)
        self.shift(other.mean - self.mean, other.n)

    def row(self, part: int) -> pa.RecordBatch:
        double = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([self.n], pa.int64()),
             pa.array([self.mean], double), pa.array([self.values], double),
             pa.array([self.axes.ravel()], double)],
            names=[c.split()[0] for c in SPECTRUM.split(", ")])

    @staticmethod
    def of(row: dict) -> Spectrum:
        out = Spectrum(len(row["mean"]))
        out.n, out.mean, out.values = row["n"], np.array(row["mean"]), np.array(row["spectrum"])
        out.axes = np.array(row["axes"]).reshape(len(out.mean), -1)
        return out


def spectrum(rows: DataFrame, centre: np.ndarray) -> Spectrum:
    """Spectrum of all vectors less ``centre``, of partitions and then combined."""
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(len(centre))
        for batch in batches:
            for x in (matrix(batch.column(0)) - centre).astype(float):
                own.add(x)
        if own.n:
            yield own.row(TaskContext.get().partitionId())

    def combined(parts: pa.Table) -> pa.Table:
        first, *others = map(Spectrum.of, parts.sort_by("part").to_pylist())
        for other in others:
            first.join(other)
        return pa.Table.from_batches([first.row(parts["part"][0].as_py() // FAN_IN)])

    parts = stage(rows.select("x").mapInArrow(fitted, SPECTRUM), "spectra")
    left = parts.agg(F.max("part")).first()[0]
    while left:
        parts = stage(parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("group"))
                      .applyInArrow(combined, SPECTRUM), "spectra")
        left //= FAN_IN
    return Spectrum.of(parts.first().asDict())


def refined(rows: DataFrame, n: int, sums: np.ndarray, axes: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
    """Variances and axes, the largest first, of the vectors projected on ``axes``."""
    axes, _ = np.linalg.qr(axes)
    size = axes.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = centred(matrix(batch.column(0)), n, sums) @ axes
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))],
                                         names=["products"])

    products = np.zeros(size * size)
    for place, value in (rows.select("x").mapInArrow(partial, "products array<double>")
                         .select(F.posexplode("products")).groupBy("pos").agg(F.sum("col"))
                         .toLocalIterator()):
        products[place] = value
    products = products.reshape(size, size) / n
    values, turn = np.linalg.eigh((products + products.T) / 2)
    return values[::-1], (axes @ turn)[:, ::-1]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - sums / n`` by way of whole numbers near zero."""
    base = sums // n
    return (x - base).astype(float) - (sums - base * n) / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums over dimensions of (n * x - sums) squared; None beyond 64 bits."""
    base = sums // n
    rest = (sums - base * n).astype(object)
    near = x - base
    if n * (float(np.abs(near).max(initial=0)) + 1) < 2 ** 31 / np.sqrt(x.shape[1]):
        return ((n * near - rest.astype(np.int64)) ** 2).sum(1).tolist()
    exact = ((n * near.astype(object) - rest) ** 2).sum(1)
    return [v if v < 1 << 63 else None for v in exact.tolist()]


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component, as in ``RESULT``."""
    rows = whole_numbers(vectors)
    spark = rows.sparkSession
    first = rows.select(F.size("x")).first()
    if first is None:
        return spark.createDataFrame([], RESULT)
    dimension = first[0]
    n, *sums = rows.agg(F.count("*"), *[F.sum(F.col("x")[d]) for d in range(dimension)]).first()
    sums = np.array(sums, np.int64)
    variances, axes = refined(rows, n, sums, spectrum(rows, sums // n).axes)
    trace = float(variances.sum())
    kept = min(components, dimension)
    variances, axes = variances[:kept], axes[:, :kept]
    some = int((variances > 64 * dimension * EPS * trace).sum())     # axes with any variance
    roots = np.sqrt(variances[:some])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            values = centred(x, n, sums) @ axes[:, :some] / roots
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviations(x, n, sums), pa.int64()),
                 pa.array(list(values), pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "whitened"])

    out = stage(rows.mapInArrow(projected, "vec_id long, deviation long, whitened array<double>"),
                "whitened")
    pairs = [(a, b) for a in range(some) for b in range(a, some)]
    found = out.agg(F.count("*"), *[F.covar_pop(F.col("whitened")[a], F.col("whitened")[b])
                                    for a, b in pairs]).first()[1:]
    error = max((abs(v - (a == b)) for v, (a, b) in zip(found, pairs)), default=0.0)
    explained = F.array(*[F.lit(float(max(v, 0) / trace) if trace > 0 else 0.0) for v in variances])
    return (out.select("vec_id", "deviation", "whitened",
                       F.explode(F.sequence(F.lit(1), F.lit(kept))).alias("component"))
            .select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation",
                    F.get("whitened", F.col("component") - 1).alias("whitened"),
                    F.get(explained, F.col("component") - 1).alias("explained"),
                    F.lit(float(error)).alias("identity_error")))
