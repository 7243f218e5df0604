"""Whitening and clusters of embeddings against numpy and plain integers."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF

from tidewell.llm import clusters, whitening
from tidewell.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, x string, cluster string, n string"
BAD = [None, [], [1.0] * 63, [1.0] * 65, [None] + [0.0] * 63, [float("nan")] + [0.0] * 63,
       [float("-inf")] + [0.0] * 63]


def table(path):
    t = pq.read_table(f"{path}/embeddings.parquet")
    return list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist()))


@pytest.fixture
def odd_vectors(tables):
    """Bad rows, repeated rows and ids, ties, null ids, large numbers."""
    rng = np.random.default_rng(3)
    good = rng.normal(size=(90, 64)).astype(np.float32)
    good[:, 7] = 0.25                                   # a dimension without variance
    rows = [(i, v.tolist()) for i, v in enumerate(good)]
    rows += rows[:5] + [(500 + i, rows[3][1]) for i in range(30)] + [(3, rows[9][1])]
    rows += [(900, (good[0] * 1000).tolist())] + [(1000 + i, b) for i, b in enumerate(BAD)]
    return tables(embeddings=([(*r, None, "a", "b", "c") for r in rows], VECTORS))


def plain_clusters(rows, k=40, rounds=5):
    rows = [(i, [int(np.floor(256 * float(e))) for e in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(e is not None and np.isfinite(e) for e in v)]
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in rows]
        for j in range(len(centres)):
            members = [v for (_, v), c in zip(rows, own) if c == j]
            if members:
                centres[j] = [sum(x) // len(members) for x in zip(*members)]
    last = [nearest(v) for _, v in rows]
    inertia = [sum(d for d, c in last if c == j) for j in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i, c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (d, c) in zip(rows, last))


CLUSTER = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters(spark, odd_vectors):
    for path in (SF, odd_vectors):
        out = QUERIES["op13_centroid_clustering"](spark, path)
        assert sorted(tuple(r[c] for c in CLUSTER) for r in out.collect()) == plain_clusters(table(path))


def test_few_vectors_and_null_ids(spark):
    df = spark.createDataFrame([(None, [2.0] * 64), (1, [1.0] * 64), (2, [float("nan")] * 64)],
                               "vec_id long, embedding array<double>")
    assigned, centroids = clusters.clustered(df)
    assert centroids.tolist() == [[256] * 64, [512] * 64]
    out = {r["vec_id"]: (r["cluster"], r["distance"], r["inertia"])
           for r in clusters.with_inertia(assigned, centroids).collect()}
    assert out == {1: (0, 0, 0), None: (1, 0, 0)}


def test_large_numbers_are_bounded(spark):
    df = spark.createDataFrame([(1, [1e30] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)],
                               "vec_id long, embedding array<double>")
    assigned, centroids = clusters.clustered(df, k=1, rounds=0)
    assert sorted(r["distance"] for r in assigned.collect())[0] == 0
    assert abs(centroids[0][0]) in (0, clusters.LARGEST)


def test_filter_verifies_few_and_loses_none(spark):
    """Against distances to all centroids; few are left where few axes hold most of the variance."""
    rng = np.random.default_rng(8)
    given = np.array([v for _, v in table("/root/testdata/sf0.1") if v], np.float64)
    narrow = rng.normal(size=(2000, 64)) * np.geomspace(1, 0.01, 64)
    for x, most in ((given, 0.5), (narrow, 0.15)):
        numbers = np.floor(x * 256).astype(np.int64)
        rows = spark.createDataFrame([(v.tolist(),) for v in numbers], "x array<int>")
        axes, leading = clusters.rotation(rows.repartition(3), 64)
        c = numbers[::len(numbers) // 39][:40]
        lead, rest = clusters.rotated(numbers.astype(float), axes, leading)
        c_lead, c_rest = clusters.rotated(c.astype(float), axes, leading)
        own, distance, verified = clusters.nearest(numbers, lead, rest, c, c_lead, c_rest)
        full = ((numbers[:, None] - c) ** 2).sum(2)
        assert (own == full.argmin(1)).all() and (distance == full.min(1)).all()
        assert leading < 60 and verified < most * full.size


def plain_whitening(rows):
    rows = [(i, v) for i, v in rows if v is not None and len(v) == 64
            and all(e is not None and np.isfinite(e) for e in v)]
    x = np.floor(1024 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s).astype(object) ** 2).sum(1)
    y = (x - s / n)
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    return rows, n, deviation, y @ axes / np.sqrt(values), values / np.trace(y.T @ y / n)


def test_whitening(spark, odd_vectors):
    for path in (SF, odd_vectors):
        rows, n, deviation, white, share = plain_whitening(table(path))
        out = QUERIES["op11_embedding_whitening"](spark, path).collect()
        assert len(out) == 8 * len(rows)
        assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-9
        assert all(r["n"] == n for r in out)
        expected = sorted((i, d, *[round(abs(w), 6) for w in ws])
                          for (i, _), d, ws in zip(rows, deviation, white))
        by_row, signs = {}, np.zeros(8)
        for r in out:
            by_row.setdefault((r["vec_id"], r["deviation"]), []).append(r)
            assert abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9
        mine = {k: sorted(round(abs(r["whitened"]), 5) for r in v) for k, v in by_row.items()}
        theirs = {}
        for (i, _), d, ws in zip(rows, deviation, white):
            theirs.setdefault((i, d), []).extend(round(abs(w), 5) for w in ws)
        assert set(mine) == set(theirs)
        assert all(np.allclose(mine[k], sorted(theirs[k]), atol=2e-5) for k in mine)
        # one sign per component for all rows
        unique = {i: w for (i, _), w in zip(rows, white) if [r[0] for r in rows].count(i) == 1}
        for r in out:
            if r["vec_id"] in unique and abs(unique[r["vec_id"]][r["component"] - 1]) > 1e-3:
                sign = np.sign(r["whitened"] * unique[r["vec_id"]][r["component"] - 1])
                assert signs[r["component"] - 1] in (0, sign)
                signs[r["component"] - 1] = sign


def whitened(spark, rows, **more):
    return whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"),
                              **more).collect()


def test_little_variance(spark):
    """One vector, equal vectors, fewer vectors than dimensions, lengths that differ."""
    one = whitened(spark, [(1, [1.0, 2.0, 3.0])])
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"])
            for r in one] == [(k, 0, None, 0.0, 0.0) for k in (1, 2, 3)]
    same = whitened(spark, [(1, [1.0, 2.0])] * 3 + [(None, [1.0, 2.0]), (7, [5.0]), (8, None)])
    assert len(same) == 8 and {r["n"] for r in same} == {4} and {r["whitened"] for r in same} == {None}
    two = whitened(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])])
    assert sorted((r["vec_id"], r["component"], r["whitened"] and round(abs(r["whitened"]), 9)) for r in two) \
        == [(1, 1, 1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None)]
    assert {r["identity_error"] < 1e-9 for r in two} == {True}
    assert {r["explained"] for r in two} == {1.0, 0.0}
    huge = whitened(spark, [(i, [1e30 * i, 1.0]) for i in range(4)])
    assert {r["vec_id"]: r["deviation"] for r in huge} == {0: None, 1: 1 << 62, 2: 1 << 62, 3: 1 << 62}
    assert whitened(spark, []) == []


@pytest.mark.parametrize("dimension, n", [(1, 5), (5, 60), (64, 400), (8, 5)])
def test_updates_follow_the_scatter(dimension, n):
    """Spectra after each kind of update against the eigenvalues of the whole scatter."""
    rng = np.random.default_rng(dimension)
    x = np.floor(rng.normal(size=(n, dimension)) @ rng.normal(size=(dimension, dimension)) * 100)
    x[n // 2:n // 2 + 2] = x[0]                          # repeated rows
    if dimension > 4:
        x[:, 3] = x[:, 2]                                # a dependent dimension
        x[:, 4] = 7                                      # one without variance
    y = x - x.mean(0)
    scatter = y.T @ y
    size = np.abs(scatter).max()

    def check(s):
        assert s.n == n and np.allclose(s.mean, x.mean(0), rtol=0, atol=1e-10)
        assert np.abs(s.values - np.linalg.eigvalsh(scatter)).max() < 1e-12 * size * dimension
        assert np.abs(s.axes * s.values @ s.axes.T - scatter).max() < 1e-12 * size * dimension
        assert np.abs(s.axes.T @ s.axes - np.eye(dimension)).max() < 1e-11

    whole, halves = whitening.Spectrum(dimension), [whitening.Spectrum(dimension) for _ in range(2)]
    for i, v in enumerate(x):
        whole.add(v)
        halves[i % 2].add(v)
    check(whole)
    halves[0].join(halves[1])
    check(halves[0])


def test_deflation():
    """Equal eigenvalues, entries without influence, and an axis of its own."""
    values, axes = np.array([1.0, 2.0, 2.0, 2.0, 5.0]), np.eye(5)
    for vector in (np.array([0, 1.0, 2.0, 3.0, 0]), np.array([0, 0, 0, 0, 2.0]), np.ones(5),
                   np.array([1e-30, 0, 1.0, 0, 1e-12]), np.zeros(5)):
        got, turned = whitening.rank_one(values, axes, 0.5, vector)
        full = np.diag(values) + 0.5 * np.outer(vector, vector)
        assert np.allclose(got, np.linalg.eigvalsh(full), atol=1e-13)
        assert np.allclose(turned * got @ turned.T, full, atol=1e-13)


def test_refinement_mends_axes(spark):
    """Rayleigh-Ritz turns any full set of axes into the right ones."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(200, 6)) * [900, 500, 300, 100, 50, 10]).astype(int)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<long>")
    start, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    values, axes = whitening.refined(rows.repartition(4), 200, x.sum(0), start)
    y = x - x.mean(0)
    expected, own = np.linalg.eigh(y.T @ y / 200)
    assert np.allclose(values, expected[::-1], rtol=1e-12)
    assert np.allclose(np.abs((axes * own[:, ::-1]).sum(0)), 1, atol=1e-10)
