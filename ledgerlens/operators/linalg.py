"""Numerical steps on bounded matrices: K centres, d x d scatters, samples of a few thousand rows.

Everything here runs on the driver or inside one task, on inputs whose size is fixed by a parameter (the number of
centres, features, micro-clusters or sampled rows), never on whole tables.
"""

from __future__ import annotations

import math

import numpy as np


def hungarian(cost: np.ndarray) -> np.ndarray:
    """The column assigned to each row at least total cost (square; shortest augmenting paths with potentials)."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    match = np.zeros(n + 1, int)  # row of each column, from 1; column 0 is a helper
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while match[j0]:
            used[j0] = True
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][~used[1:]] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


def ward(points: np.ndarray, k: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """Labels of Ward's clustering cut at k, by nearest-neighbour chains: O(n) memory, from centroids and sizes."""
    n = len(points)
    centre, size = points.astype(float).copy(), np.ones(n) if sizes is None else np.asarray(sizes, float).copy()
    alive, merges, chain = np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            d = ((centre - centre[a]) ** 2).sum(1) * size * size[a] / (size + size[a])
            d[~alive] = np.inf
            d[a] = np.inf
            b = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((float(d[b]), a, b))
        total = size[a] + size[b]
        centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / total
        size[a], alive[b] = total, False
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: n - k]:
        root[find(b)] = find(a)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def ward_guided_centres(micro: np.ndarray, k: int) -> np.ndarray:
    """Unweighted means of micro-centres merged by Ward to k."""
    lab = ward(micro, k)
    return np.array([micro[lab == c].mean(axis=0) for c in range(k)])


def whiten_pca(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and matrix of full-rank PCA whitening: (x - mean) @ matrix has unit sample variances."""
    return whiten_from_moments(x.mean(axis=0), np.cov(x.T))


def whiten_from_moments(mean: np.ndarray, covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, v = np.linalg.eigh(covariance)
    order = np.argsort(-w)
    return mean, v[:, order] / np.sqrt(np.maximum(w[order], 1e-12))


def shrink(within: np.ndarray, share: float) -> np.ndarray:
    d = len(within)
    return (1 - share) * within + share * np.trace(within) / d * np.eye(d)


def mahalanobis_metric(within: np.ndarray) -> np.ndarray:
    """Symmetric whitener."""
    w, v = np.linalg.eigh(within)
    return v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-8))) @ v.T


def discriminant_metric(within: np.ndarray, between: np.ndarray, power: float) -> np.ndarray:
    """Solves between v = l within v: with within = C C', the rows v of C^-1 have unit scatter within the classes, and the eigenvectors of
    C^-1 between C'^-1 part them. An axis is stretched by its eigenvalue's share of an even split, to ``power``."""
    c = np.linalg.cholesky(within + 1e-8 * max(np.trace(within) / len(within), 1e-300) * np.eye(len(within)))
    half = np.linalg.solve(c, between)
    values, axes = np.linalg.eigh(np.linalg.solve(c, half.T))
    share = np.clip(values, 0, None)
    share = np.maximum(share / max(share.sum(), 1e-300), 1e-9) * len(share)
    return np.linalg.solve(c.T, axes * share**power)


def ratio_metric(within: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Each coordinate by the deviation between against that within, both with one unit added, on average 1."""
    scale = np.exp(0.5 * (np.log1p(np.diag(between)) - np.log1p(np.diag(within))))
    return np.diag(scale * len(scale) / scale.sum())


def metric_grid(within: np.ndarray, between: np.ndarray, shrinkage: tuple[float, ...] = (0.05, 0.10, 0.20), powers: tuple[float, ...] = (0.0, 0.15, 0.30)) -> dict[str, np.ndarray]:
    """Metrics by name: none, the ratio of deviations, whitening (power 0) and discriminants, for every shrinkage and power."""
    out = {"plain": np.eye(len(within)), "ratio": ratio_metric(within, between)}
    for a in shrinkage:
        w = shrink(within, a)
        for p in powers:
            out[f"shrink {a:g} power {p:g}"] = discriminant_metric(w, between, p) if p else mahalanobis_metric(w)
    return out


def spectral_embedding(src: np.ndarray, dst: np.ndarray, val: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest eigenvalues and vectors of a normalised Laplacian given as edges of a bounded graph."""
    n = int(max(src.max(), dst.max())) + 1
    m = np.zeros((n, n))
    m[src, dst] = val
    w, v = np.linalg.eigh((m + m.T) / 2)
    v = v[:, :dims]
    return w[:dims], v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(dims)])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after moving small arguments up."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (low := x < 10).any():
        out[low] -= np.log(x[low])
        x[low] += 1
    return out + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def expected_information(a: np.ndarray, b: np.ndarray, deviations: float = 12.0) -> float:
    """The mean mutual information of two labellings with these class sizes under random permutation.

    A pair's count is hypergeometric. Terms further from its mean than ``deviations`` of its standard deviation (and 50) are below e^-70
    and left out, so the work grows with the root of the rows at most; nothing is kept per row.
    """
    n = float(a.sum())
    out = 0.0
    for x in a.astype(float):
        for y in b.astype(float):
            mean = x * y / n
            width = 50 + deviations * math.sqrt(max(mean * (n - x) * (n - y) / (n * max(n - 1, 1)), 0.0))
            k = np.arange(max(1, x + y - n, math.floor(mean - width)), min(x, y, math.ceil(mean + width)) + 1)
            if not len(k):
                continue
            fixed = log_gamma(np.array([x + 1, y + 1, n - x + 1, n - y + 1]))
            p = fixed.sum() - log_gamma(np.array([n + 1]))[0] - log_gamma(k + 1) - log_gamma(x - k + 1) - log_gamma(y - k + 1) - log_gamma(n - x - y + k + 1)
            out += float((k / n * np.log(n * k / (x * y)) * np.exp(p)).sum())
    return out


def adjusted_information(table: np.ndarray) -> float:
    """Adjusted mutual information of a contingency table, normalised by the mean of the entropies."""
    n, a, b = table.sum(), table.sum(1), table.sum(0)
    if len(a) == len(b) == 1:
        return 1.0
    i, j = np.nonzero(table)
    t = table[i, j]
    mi = float((t / n * np.log(n * t / (a[i] * b[j]))).sum())
    h = [-float((p[p > 0] / n * np.log(p[p > 0] / n)).sum()) for p in (a, b)]
    e = expected_information(a, b)
    return (mi - e) / (sum(h) / 2 - e)


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def neighbour_information(x: np.ndarray, y: np.ndarray, k: int = 5) -> float:
    """Mutual information of two numeric samples by k-nearest neighbours in the joint space (maximum norm)."""
    n = len(x)
    nx, ny = np.zeros(n), np.zeros(n)
    for i in range(0, n, 500):  # blocks of rows: memory is O(n)
        at = np.arange(i, min(i + 500, n))
        dx, dy = np.abs(x[at, None] - x[None, :]), np.abs(y[at, None] - y[None, :])
        joint = np.maximum(dx, dy)
        joint[at - i, at] = np.inf
        r = np.nextafter(np.partition(joint, k - 1, axis=1)[:, k - 1], 0)
        nx[at], ny[at] = (dx <= r[:, None]).sum(1), (dy <= r[:, None]).sum(1)
    return max(0.0, float(digamma(np.array([n]))[0] + digamma(np.array([k]))[0] - digamma(nx).mean() - digamma(ny).mean()))


class IsolationForest:
    """Isolation trees grown on bounded subsamples; scores of any number of rows."""

    def __init__(self, sample: np.ndarray, trees: int = 200, psi: int = 256, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.psi = min(psi, len(sample))
        self.trees = [self._grow(sample[rng.choice(len(sample), self.psi, replace=False)], 0, math.ceil(math.log2(max(2, self.psi))), rng) for _ in range(trees)]

    @staticmethod
    def path(n: int) -> float:
        """The mean length of an unsuccessful search in a binary tree of n."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, depth: int, limit: int, rng):
        lo, hi = x.min(axis=0), x.max(axis=0)
        wide = np.flatnonzero(hi > lo)
        if depth >= limit or len(x) < 2 or not len(wide):
            return depth + self.path(len(x))
        j = int(rng.choice(wide))
        cut = rng.uniform(lo[j], hi[j])
        left = x[:, j] < cut
        return j, cut, self._grow(x[left], depth + 1, limit, rng), self._grow(x[~left], depth + 1, limit, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            stack = [(tree, np.arange(len(x)))]
            while stack:
                node, at = stack.pop()
                if isinstance(node, float):
                    total[at] += node
                elif len(at):
                    left = x[at, node[0]] < node[1]
                    stack += [(node[2], at[left]), (node[3], at[~left])]
        return 2 ** (-(total / len(self.trees)) / max(self.path(self.psi), 1e-12))


def density_clusters(x: np.ndarray, min_size: int, min_samples: int) -> np.ndarray:
    """Density clustering of a bounded sample: mutual-reachability spanning tree, condensed tree, clusters by excess of mass;
    -1 is noise. Distances are computed row by row, so memory is O(n)."""
    n = len(x)
    row = lambda i: np.sqrt(((x - x[i]) ** 2).sum(1))
    core = np.array([np.partition(row(i), min(min_samples, n - 1))[min(min_samples, n - 1)] for i in range(n)])
    near, parent, open_ = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    at, edges = 0, []
    for _ in range(n - 1):
        open_[at] = False
        d = np.maximum(np.maximum(row(at), core), core[at])
        better = open_ & (d < near)
        near[better], parent[better] = d[better], at
        at = int(np.where(open_, near, np.inf).argmin())
        edges.append((float(near[at]), int(parent[at]), at))
    edges.sort()
    # the binary merge tree: node -> (left, right, distance), leaves are points
    top, size, kids, dist = list(range(2 * n - 1)), [1] * (2 * n - 1), {}, {}

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for m, (w, a, b) in enumerate(edges):
        a, b, new = find(a), find(b), n + m
        kids[new], dist[new], size[new] = (a, b), max(w, 1e-12), size[a] + size[b]
        top[a] = top[b] = new
    if n < 2:
        return np.full(n, -1)

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            i = stack.pop()
            stack.extend(kids[i]) if i in kids else out.append(i)
        return out

    # condense: a split counts where both sides reach min_size
    clusters = []  # (parent, born, node, stability, children)
    stack = [(2 * n - 2, -1, 0.0)]
    while stack:
        node, up, born = stack.pop()
        me, stable, members = len(clusters), 0.0, leaves(node)
        clusters.append([up, born, members, 0.0, []])
        if up >= 0:
            clusters[up][4].append(me)
        while node in kids:
            (a, b), lam = kids[node], 1 / dist[node]
            big = [c for c in (a, b) if size[c] >= min_size]
            if len(big) == 2:
                stable += size[node] * (lam - born)
                stack += [(a, me, lam), (b, me, lam)]
                break
            stable += sum(size[c] for c in (a, b) if c not in big) * (lam - born)
            if not big:
                break
            node = big[0]
        clusters[me][3] = stable
    chosen = [True] * len(clusters)
    best = [c[3] for c in clusters]
    for i in range(len(clusters) - 1, -1, -1):
        below = sum(best[c] for c in clusters[i][4])
        if i == 0 or (clusters[i][4] and below > clusters[i][3]):
            chosen[i], best[i] = False, below  # the root, all rows, is never a cluster
    out, k = np.full(n, -1), 0
    for i, c in enumerate(clusters):
        up, free = c[0], chosen[i]
        while free and up >= 0:
            free, up = not chosen[up], clusters[up][0]
        if free:
            out[c[2]] = k
            k += 1
    return out
