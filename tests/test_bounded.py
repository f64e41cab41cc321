"""Clusterings and scores of bounded samples against brute force."""

import itertools

import numpy as np
import pytest

from ledgerlens.operators import bounded, graph, linalg
from ledgerlens.plans import search


@pytest.fixture()
def blobs():
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0, 0], [8, 0, 0], [0, 8, 0], [0, 0, 8.0]])
    y = np.repeat(np.arange(4), 40)
    return centres[y] + 0.6 * rng.normal(size=(160, 3)), y


def test_scores_against_definitions(blobs):
    x, y = blobs
    y = y.copy()
    y[0] = 9  # a cluster of one
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        own = (y == y[i]) & (np.arange(len(x)) != i)
        if not own.any():
            s.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, y == c].mean() for c in set(y.tolist()) - {y[i]})
        s.append((b - a) / max(a, b))
    names = sorted(set(y.tolist()))
    m = {c: x[y == c].mean(0) for c in names}
    e = {c: np.sqrt(((x[y == c] - m[c]) ** 2).sum(1)).mean() for c in names}
    dbi = np.mean([max((e[a] + e[b]) / np.sqrt(((m[a] - m[b]) ** 2).sum()) for b in names if b != a) for a in names])
    between = sum((y == c).sum() * ((m[c] - x.mean(0)) ** 2).sum() for c in names)
    within = sum(((x[y == c] - m[c]) ** 2).sum() for c in names)
    chi = between * (len(x) - len(names)) / (within * (len(names) - 1))
    got = bounded.scores(x, y)
    assert np.allclose([got["silhouette"], got["davies_bouldin"], got["calinski_harabasz"]], [np.mean(s), dbi, chi], atol=1e-6)
    assert np.isnan(bounded.scores(x, np.zeros(len(x)))["silhouette"])


def same(a, b):
    return {frozenset(np.flatnonzero(a == c).tolist()) for c in set(a.tolist())} == {frozenset(np.flatnonzero(b == c).tolist()) for c in set(b.tolist())}


def test_all_methods_find_clear_clusters(blobs):
    x, y = blobs
    start = x[[0, 40, 80, 120]]
    for centres in (bounded.best_kmeans(x, 4), bounded.lloyd(x, bounded.guided_centres(x, 4, 20), 50), bounded.stream_kmeans(x, start, 64)):
        assert same(bounded.nearest(x, centres), y)
    assert same(bounded.mixture(x, bounded.best_kmeans(x, 4, 2)), y)
    assert same(linalg.ward(x, 4), y)
    assert same(bounded.attach_noise(x, linalg.density_clusters(x, 10, 5)), y)


def test_noise_takes_the_nearest_label():
    x = np.array([[0.0], [1.0], [10.0], [11.0], [5.9]])
    assert bounded.attach_noise(x, np.array([0, -1, 1, 1, -1])).tolist() == [0, 0, 1, 1, 1]
    assert bounded.attach_noise(x, np.full(5, -1)).tolist() == [-1] * 5


def test_flag_and_family_centres(blobs):
    x, y = blobs
    flags = np.stack([y == 0, y == 1, np.zeros(160)], axis=1)
    c = bounded.flag_centres(x, flags, 4)
    assert len(c) == 4 and np.allclose(c[:2], [x[:40].mean(0), x[40:80].mean(0)])
    family = np.array(["a", "b", "c", "Unknown"])[y]
    assert bounded.family_centres(x, family, 6, at_least=10).shape == (6, 3)


def test_agreement_against_counts():
    a, b = np.array([0, 0, 0, 1, 1, 2]), np.array(["x", "x", "y", "y", "y", "Unknown"])
    got = bounded.agreement(a, b)
    assert np.isclose(got["weighted_purity"], 5 / 6) and np.isclose(got["macro_purity"], (2 / 3 + 1 + 1) / 3) and got["pure_clusters"] == 1
    assert np.isclose(bounded.agreement(a, a)["nmi"], 1) and np.isclose(bounded.agreement(a, a)["ami"], 1)


def test_flag_tree_is_the_best_split():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 30, (8, 3)).astype(float)
    tree = bounded.FlagTree(counts, 1)

    def impurity(t):
        return t.sum() - (t * t).sum() / t.sum()

    bits = np.array([[c >> j & 1 for j in range(3)] for c in range(8)], bool)
    best = min(range(3), key=lambda j: impurity(counts[bits[:, j]].sum(0)) + impurity(counts[~bits[:, j]].sum(0)))
    want = np.where(bits[:, best], counts[bits[:, best]].sum(0).argmax(), counts[~bits[:, best]].sum(0).argmax())
    assert (tree.leaf == want).all()
    flags = rng.integers(0, 2, (4000, 3))
    assert bounded.tree_scores(flags, flags[:, 0] * 2 + flags[:, 1], 1)["tree_accuracy"] == 1.0


def test_metrics_separate_and_whiten():
    rng = np.random.default_rng(4)
    y = np.repeat([0, 1], 300)
    x = np.stack([rng.normal(size=600) * 20, rng.normal(size=600) + 4 * y, rng.normal(size=600)], axis=1)
    w, b = search.weighted_scatter(x, y, np.ones(600))
    for name, m in linalg.metric_grid(w, b).items():
        z = x @ m
        share = [((z[y == 1].mean(0) - z[y == 0].mean(0)) ** 2).sum() / z.var(axis=0).sum()]
        if name != "plain":
            assert share[0] > ((x[y == 1].mean(0) - x[y == 0].mean(0)) ** 2).sum() / x.var(axis=0).sum()
    m = linalg.discriminant_metric(w, b, 0.0)
    assert np.allclose(m.T @ w @ m, np.eye(3), atol=1e-4)  # distances are those of the whitening
    values = np.diag(linalg.discriminant_metric(w, b, 0.5).T @ w @ linalg.discriminant_metric(w, b, 0.5))
    assert np.isclose(values.sum(), 3, atol=0.01)


def test_weighted_scatter_leaves_out_light_classes():
    x, y, w = np.array([[0.0], [2.0], [9.0], [5.0], [7.0]]), np.array([0, 0, 1, 2, 2]), np.array([1.0, 3.0, 5.0, 0.0, 0.0])
    within, _ = search.weighted_scatter(x, y, w)
    assert np.isclose(within[0, 0], (1 * 1.5**2 + 3 * 0.5**2) / 4)


def test_anchor_graph_against_loops(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    edges, values = graph.anchor_graph(spark, x, 12, 3)
    got = {(r.src, r.dst): r.w for r in edges.collect()}
    v = {}
    for r in values.collect():
        v.setdefault(r.node, {})[r.dim] = r.val
    c = np.array([[v[i][0], v[i][1]] for i in sorted(v)])
    n = np.bincount(bounded.nearest(x, c), minlength=len(c))
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    near = [[j for j in np.argsort(d[i], kind="stable") if j != i][:3] for i in range(len(c))]
    s = np.median([d[i, j] for i in range(len(c)) for j in near[i]])
    w = np.zeros_like(d)
    for i, j in itertools.chain.from_iterable([(i, j) for j in near[i]] for i in range(len(c))):
        w[i, j] = np.exp(-(d[i, j] ** 2) / (2 * s * s)) * np.sqrt(n[i] * n[j])
    w = (w + w.T) / 2
    assert {(int(i), int(j)) for i, j in zip(*np.nonzero(w))} == set(got) and all(np.isclose(w[k], x, rtol=1e-4) for k, x in got.items())
    scores = {r.dim: r.laplacian_score for r in graph.laplacian_scores(edges, values).collect()}
    for f in range(2):
        g = c[:, f] - (w.sum(1) @ c[:, f]) / w.sum()
        assert np.isclose(scores[f], g @ (np.diag(w.sum(1)) - w) @ g / (w.sum(1) @ g**2), rtol=1e-4)


def test_layout_keeps_clusters_together(blobs):
    x, y = blobs
    z = bounded.layout(x, neighbours=12)
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert (y[d.argmin(axis=1)] == y).mean() > 0.95
    assert bounded.layout(x[:1]).shape == (1, 2)


def test_lloyd_measures_few_rows_and_equals_plain_steps(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 5)) + 4 * rng.integers(0, 3, (6000, 5))
    start = want = bounded.spread_start(x, 12, np.random.default_rng(1))
    steps = 0
    for _ in range(100):
        label = ((x[:, None] - want[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else want[j] for j in range(12)])
        done, want, steps = np.allclose(new, want, atol=1e-9), new, steps + 1
        if done:
            break
    measured, kernel = [], bounded.two_nearest
    monkeypatch.setattr(bounded, "two_nearest", lambda rows, c: measured.append(len(rows)) or kernel(rows, c))
    assert np.allclose(bounded.lloyd(x, start, 100), want, atol=1e-10)
    assert sum(measured) < 0.6 * steps * len(x)


def test_starts_as_tasks_equal_starts_in_a_row(spark, blobs):
    x, _ = blobs
    turn = np.diag([1.0, 0.5, 2.0])
    with bounded.Shared(spark, x) as sample:
        plain, turned = sample.best_kmeans(5, 3, 7, (None, turn))
    assert np.allclose(plain, bounded.best_kmeans(x, 5, 3, seed=7)) and np.allclose(turned, bounded.best_kmeans(x @ turn, 5, 3, seed=7))


@pytest.mark.parametrize("rows", [0, 40, 299, 300, 900])
def test_samples_in_parts_are_the_rows_of_least_hash(spark, monkeypatch, rows):
    import hashlib

    monkeypatch.setattr(search, "PART", 16)
    df = spark.createDataFrame([(f"r{i}", i) for i in range(300)], "_rid string, i int")
    got = [i for t in search.first_by_hash(df, rows, 9) for i in t.column("i").to_pylist()]
    assert got == sorted(range(300), key=lambda i: hashlib.md5(f"9|r{i}".encode()).hexdigest())[:rows]


def test_nearest_centre_is_that_of_differences(monkeypatch):
    """Labels and distances are bit for bit those of measuring every row to every centre, which only tied rows and those without a finite one need."""
    from ledgerlens.operators import kmeans

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 3, (2_000, 5)), rng.integers(-2, 3, (500, 5)), [[np.inf, 0, 0, 0, 0], [np.nan, 0, 0, 0, 0]], rng.normal(0, 1, (50, 5)) + 1e6])
    centres = np.concatenate([rng.integers(-2, 3, (12, 5)).astype(float), rng.normal(0, 3, (8, 5)), np.zeros((2, 5))])
    measured, by_differences = [], kmeans.distances
    monkeypatch.setattr(kmeans, "distances", lambda q, r: measured.append(len(q)) or by_differences(q, r))
    at, dist = kmeans.nearest_centre(x, centres)
    d = by_differences(x, centres)
    assert (at == d.argmin(axis=1)).all() and np.array_equal(dist, d.min(axis=1), equal_nan=True)
    assert sum(measured) < 1_000
