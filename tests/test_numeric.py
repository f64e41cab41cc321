"""Driver-side numerics against brute force and invariants."""

import itertools
import math

import numpy as np
import pytest

from ledgerlens.operators import kmeans, linalg, mixture, zeta


@pytest.fixture()
def rng():
    return np.random.default_rng(5)


def test_hungarian(rng):
    for _ in range(20):
        c = rng.random((5, 5))
        got = linalg.hungarian(c)
        assert math.isclose(c[np.arange(5), got].sum(), min(c[np.arange(5), list(p)].sum() for p in itertools.permutations(range(5))))


def test_ward_matches_greedy(rng):
    x = rng.random((40, 3))
    groups = [[i] for i in range(40)]

    def cost(a, b):
        return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()

    while len(groups) > 5:
        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    lab = linalg.ward(x, 5)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(lab == c).tolist()) for c in range(5)}


def test_whitening(rng):
    x = rng.random((200, 4)) @ rng.random((4, 4))
    mean, m = linalg.whiten_pca(x)
    assert np.allclose(np.cov(((x - mean) @ m).T), np.eye(4), atol=1e-8)
    w = linalg.mahalanobis_metric(np.cov(x.T))
    assert np.allclose(w @ np.cov(x.T) @ w, np.eye(4), atol=1e-6)


def test_adjusted_information():
    assert math.isclose(linalg.adjusted_information(np.diag([3.0, 4.0, 5.0])), 1.0)
    a, b = np.array([3, 2]), np.array([2, 3])
    truth = np.repeat([0, 1], a)
    each = []
    for p in set(itertools.permutations([0] * 2 + [1] * 3)):
        t = np.zeros((2, 2))
        for i, j in zip(truth, p):
            t[i, j] += 1
        i, j = np.nonzero(t)
        v = t[i, j]
        each.append((v / 5 * np.log(5 * v / (a[i] * b[j]))).sum())
    assert math.isclose(linalg.expected_information(a, b), np.mean(each), rel_tol=1e-9)


def test_neighbour_information(rng):
    x = rng.normal(size=600)
    y = 0.8 * x + 0.6 * rng.normal(size=600)
    assert abs(linalg.neighbour_information(x, y) + 0.5 * math.log(1 - 0.64)) < 0.1
    assert linalg.neighbour_information(x, rng.normal(size=600)) < 0.08


def test_isolation_forest_finds_outlier(rng):
    x = np.concatenate([rng.normal(size=(300, 3)), [[8, 8, 8]]])
    assert linalg.IsolationForest(x, 50).score(x).argmax() == 300


def test_density_clusters(rng):
    x = np.concatenate([rng.normal(size=(60, 2)) * 0.1, rng.normal(size=(60, 2)) * 0.1 + 5, rng.random((10, 2)) * 40 + 20])
    lab = linalg.density_clusters(x, 15, 5)
    assert len(set(lab[:60]) - {-1}) == 1 and len(set(lab[60:120]) - {-1}) == 1 and lab[0] != lab[60]


def test_seed_allocation():
    got = kmeans.allocate_seeds({"a": 6000, "b": 3000, "c": 600, "tiny": 10, "Unknown": 9000}, 10)
    assert sum(got.values()) == 10 and set(got) == {"a", "b", "c"} and got["c"] >= 1


def test_zeta():
    assert math.isclose(zeta.zeta(2), math.pi**2 / 6, rel_tol=1e-10) and zeta.zeta(1) == float("inf")
    assert math.isclose(sum(k**-1.5 for k in range(1, 28)) / zeta.normaliser(27, 1.5), 1)


@pytest.fixture()
def blobs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(80, 3)) * 0.2 + c for c in (0, 3, 6)])
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), x


def test_lloyd(blobs):
    df, x = blobs
    centres, history = kmeans.seeded_kmeans(df, x[[0, 80, 160]])
    assert all(a >= b - 1e-9 for a, b in zip(history, history[1:]))
    assert np.allclose(np.sort(centres[:, 0]), np.sort([x[i : i + 80, 0].mean() for i in (0, 80, 160)]))
    empty, _ = kmeans.step(df, np.array([[0.0, 0, 0], [99, 99, 99]]))
    assert np.allclose(empty[1], 99)


def test_mixture(blobs):
    df, x = blobs
    means, _, weight, history = mixture.diagonal_mixture(df, x[[0, 80, 160]], 15)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:])) and np.allclose(weight, 1 / 3, atol=0.02)
