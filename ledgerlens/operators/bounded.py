"""Clusterings of bounded samples and their scores, as arrays on the driver.

Samples have a size fixed by a parameter; whole tables are clustered by ``kmeans`` and ``mixture``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators import linalg
from ledgerlens.operators.kmeans import allocate_seeds, blend

ROWS = 1_000  # of a block of distances
TILE = 2_048  # rows of a block that stays in a core's cache
SIDE = 512  # of a tile of pairwise distances
AHEAD = 8  # steps for which the rows that can change their centre are listed


def matrix(df: DataFrame, vector: str) -> np.ndarray:
    """The vectors of a bounded frame, by Arrow, without a Python object per value."""
    column = df.select(vector).toArrow().column(0).combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T, 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    double, own = np.ascontiguousarray(-2 * centres.T), lengths(centres)
    return np.concatenate([(x[i : i + TILE] @ double + own).argmin(axis=1) for i in range(0, len(x), TILE)] or [np.empty(0, int)])


def means(x: np.ndarray, labels: np.ndarray, k: int, old: np.ndarray | None = None) -> np.ndarray:
    """Means of the labels 0 to k - 1; an empty one keeps its old centre."""
    order = np.argsort(labels, kind="stable")
    sizes = np.bincount(labels, minlength=k)
    out = np.zeros((k, x.shape[1])) if old is None else old.copy()
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(x[order], np.cumsum(sizes)[full] - sizes[full]) / sizes[full][:, None]
    return out


def lengths(x: np.ndarray) -> np.ndarray:
    """Squared lengths of the rows."""
    return np.einsum("ij,ij->i", x, x)


def two_nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of tied ones, and how much nearer it is than the second."""
    label, gap = np.zeros(len(x), int), np.empty(len(x))
    double, own, place = np.ascontiguousarray(-2 * centres.T), lengths(centres), np.arange(TILE)
    for i in range(0, len(x), TILE):
        rows = x[i : i + TILE]
        d = rows @ double
        d += own
        at, row, size = d.argmin(axis=1), place[: len(rows)], lengths(rows)
        first = d[row, at]
        d[row, at] = np.inf
        label[i : i + TILE] = at
        gap[i : i + TILE] = np.sqrt(np.maximum(d.min(axis=1) + size, 0)) - np.sqrt(np.maximum(first + size, 0))
    return label, gap


def lloyd(x: np.ndarray, centres: np.ndarray, steps: int) -> np.ndarray:
    """Lloyd's steps. A row is measured again only when its centre and the fastest other one have moved by as much as the row was nearer
    to its own (the triangle inequality), so the labels of every step are those of measuring all rows."""
    k = len(centres)
    label, gap = two_nearest(x, centres)
    size = np.bincount(label, minlength=k)
    total = means(x, label, k, np.zeros_like(centres)) * size[:, None]
    moved = np.zeros(k)  # since the first step, by centre: its own way and that of the fastest other
    slack = 1e-6 * np.sqrt(lengths(x).max(initial=0))  # above the rounding of a distance
    near, limit = None, None  # rows that can change before a centre's ``moved`` exceeds its limit
    for s in range(steps):
        new = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
        way = np.sqrt(lengths(new - centres))
        done = np.allclose(new, centres, atol=1e-9)
        centres = new
        if done or s == steps - 1:
            break
        fastest = int(way.argmax())
        other = np.full(k, way[fastest])
        other[fastest] = np.delete(way, fastest).max(initial=0)
        moved += way + other
        if near is None or (moved > limit).any():
            limit = moved + AHEAD * (way + other).max()
            near = np.flatnonzero(gap <= limit[label] + slack)
        at = near[gap[near] <= moved[label[near]] + slack]
        rows = x[at]
        now, apart = two_nearest(rows, centres)
        old = label[at]
        label[at], gap[at] = now, apart + moved[now]
        turned = np.flatnonzero(now != old)
        if len(turned):
            sign = np.zeros((k, len(turned)))
            sign[now[turned], np.arange(len(turned))] = 1
            sign[old[turned], np.arange(len(turned))] = -1
            total += sign @ rows[turned]
            size += np.bincount(now[turned], minlength=k) - np.bincount(old[turned], minlength=k)
    return centres


def spread_start(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn with a chance that grows with its squared distance to those before."""
    at, size = [int(rng.integers(len(x)))], lengths(x)
    least = None
    for _ in range(k - 1):
        d = x @ (-2 * x[at[-1]])
        d += size
        d += size[at[-1]]
        np.maximum(d, 0, out=d)
        least = d if least is None else np.minimum(least, d, out=least)
        chances = least.cumsum()
        at.append(min(int(np.searchsorted(chances, rng.random() * chances[-1], "right")), len(x) - 1) if chances[-1] > 0 else int(rng.integers(len(x))))
    return x[at]


def one_kmeans(x: np.ndarray, k: int, seed: int, steps: int = 250) -> tuple[float, np.ndarray]:
    """(inertia, centres) of one start."""
    centres = lloyd(x, spread_start(x, k, np.random.default_rng(seed)), steps)
    return sum(float(squared(x[i : i + TILE], centres).min(axis=1).sum()) for i in range(0, len(x), TILE)), centres


def least_inertia(runs: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """The centres of the best run, the first of tied ones."""
    return min(runs, key=lambda r: r[0])[1]


def best_kmeans(x: np.ndarray, k: int, starts: int = 10, steps: int = 250, seed: int = 42) -> np.ndarray:
    """Centres of the least inertia over several starts."""
    return least_inertia([one_kmeans(x, k, seed + s, steps) for s in range(starts)])


class Shared:
    """A bounded sample that the executors hold while a ``with`` block runs independent jobs on it, a task each."""

    def __init__(self, spark: SparkSession, x: np.ndarray):
        self.context, self.sample = spark.sparkContext, spark.sparkContext.broadcast(np.ascontiguousarray(x))

    def __enter__(self) -> Shared:
        return self

    def __exit__(self, *_) -> None:
        self.sample.destroy()

    def run(self, jobs: list[tuple]) -> list:
        """The results of jobs (function, turn, arguments), in their order: the function's first argument is the sample, times the matrix
        ``turn`` unless that is None. Results are centres, labels or scores of a bounded sample."""
        sample = self.sample
        return self.context.parallelize(jobs, len(jobs)).map(lambda job: job[0](sample.value if job[1] is None else sample.value @ job[1], *job[2:])).collect()

    def best_kmeans(self, k: int, starts: int, seed: int, turns: tuple[np.ndarray | None, ...] = (None,)) -> list[np.ndarray]:
        """What ``best_kmeans`` gives in each of the spaces."""
        runs = self.run([(one_kmeans, turn, k, seed + s) for turn in turns for s in range(starts)])
        return [least_inertia(runs[i : i + starts]) for i in range(0, len(runs), starts)]


def stream_kmeans(x: np.ndarray, centres: np.ndarray, batch: int = 20_000, steps: int = 100, seed: int = 42) -> np.ndarray:
    """Mini-batches: each batch pulls a centre by the share of its rows among all the centre has seen."""
    rng, seen = np.random.default_rng(seed), np.zeros(len(centres))
    for _ in range(steps):
        rows = x[rng.choice(len(x), batch, replace=False)] if len(x) > batch else x
        at = nearest(rows, centres)
        n = np.bincount(at, minlength=len(centres))
        seen += n
        new = centres + (n / np.maximum(seen, 1))[:, None] * (means(rows, at, len(centres), centres) - centres)
        done = np.allclose(new, centres, atol=1e-4)
        centres = new
        if done:
            break
    return centres


def guided_centres(x: np.ndarray, k: int, micro: int = 160, seed: int = 42) -> np.ndarray:
    """Micro-clusters merged by Ward."""
    m = min(micro, len(x))
    return linalg.ward_guided_centres(stream_kmeans(x, spread_start(x, m, np.random.default_rng(seed)), seed=seed), k)


def family_centres(x: np.ndarray, family: np.ndarray, k: int, at_least: int = 500, most: int = 100_000, seed: int = 42) -> np.ndarray:
    """Centres of the rule families by their allocation. Where no family has ``at_least`` rows, those of two rows count."""
    names, sizes = np.unique(family, return_counts=True)
    counted = dict(zip(names.tolist(), sizes.tolist()))
    allocation = allocate_seeds(counted, k, at_least) or allocate_seeds(counted, k, 2)
    parts = []
    for f, n in sorted(allocation.items()):
        own = x[family == f][:most]
        parts.append(own.mean(axis=0, keepdims=True) if n == 1 else stream_kmeans(own, spread_start(own, n, np.random.default_rng(seed)), seed=seed))
    return np.concatenate(parts)


def flag_centres(x: np.ndarray, flags: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Means of the rows of each flag that has two, filled up to k with mini-batch centres."""
    own = [x[flags[:, j] > 0.5].mean(axis=0) for j in range(flags.shape[1]) if (flags[:, j] > 0.5).sum() >= 2][:k]
    left = k - len(own)
    fill = [stream_kmeans(x, spread_start(x, left, np.random.default_rng(seed)), 10_000, seed=seed)] if left else []
    return np.concatenate([np.array(own).reshape(len(own), x.shape[1]), *fill])


def mixture(x: np.ndarray, centres: np.ndarray, steps: int = 200, floor: float = 1e-5) -> np.ndarray:
    """Labels of a diagonal Gaussian mixture; a larger floor of the variances if the first attempt isn't finite."""
    k = len(centres)
    for ridge in (floor, 10 * floor):
        mean, var, weight, old = centres.copy(), np.tile(x.var(axis=0) + ridge, (k, 1)), np.full(k, 1 / k), -np.inf
        for _ in range(steps):
            log = np.log(np.maximum(weight, 1e-300)) - 0.5 * (np.log(2 * np.pi * var).sum(1) + (x * x) @ (1 / var).T - 2 * x @ (mean / var).T + (mean * mean / var).sum(1))
            top = log.max(axis=1, keepdims=True)
            p = np.exp(log - top)
            total = p.sum(axis=1, keepdims=True)
            p /= total
            n = p.sum(axis=0) + 1e-12
            mean, weight = (p.T @ x) / n[:, None], n / len(x)
            var = np.maximum((p.T @ (x * x)) / n[:, None] - mean * mean, 0) + ridge
            now = float((top + np.log(total)).mean())
            if not np.isfinite(now) or abs(now - old) < 1e-3:
                break
            old = now
        if np.isfinite(now):
            return log.argmax(axis=1)
    raise ValueError("the mixture has no finite likelihood")


def attach_noise(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Rows labelled -1 take the label of the nearest row that has one; all of them stay if none has."""
    noise = np.flatnonzero(labels < 0)
    known = np.flatnonzero(labels >= 0)
    out = labels.copy()
    for i in range(0, len(noise) if len(known) else 0, ROWS):
        out[noise[i : i + ROWS]] = labels[known[squared(x[noise[i : i + ROWS]], x[known]).argmin(axis=1)]]
    return out


def scores(x: np.ndarray, labels: np.ndarray) -> dict[str, float]:
    """Silhouette, Davies-Bouldin and Calinski-Harabasz of one labelling; NaN with fewer than two clusters or one row each."""
    names, code = np.unique(labels, return_inverse=True)
    k, n = len(names), len(x)
    if k < 2 or k >= n:
        return {"silhouette": np.nan, "davies_bouldin": np.nan, "calinski_harabasz": np.nan}
    size, onehot = np.bincount(code), np.eye(k)[code]
    total, length, all_sums = 0.0, lengths(x), np.zeros((n, k))
    for i in range(0, n, SIDE):
        for j in range(i, n, SIDE):  # a distance serves both of its rows
            p, q = slice(i, i + SIDE), slice(j, j + SIDE)
            d = (-2 * x[p]) @ x[q].T
            d += length[p, None]
            d += length[q]
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            all_sums[p] += d @ onehot[q]
            if i != j:
                all_sums[q] += d.T @ onehot[p]
    for i in range(0, n, ROWS):
        at = slice(i, i + ROWS)
        sums, own = all_sums[at], code[at]
        rows = np.arange(len(own))
        a = sums[rows, own] / np.maximum(size[own] - 1, 1)
        other = sums / size
        other[rows, own] = np.inf
        b = other.min(axis=1)
        total += float(np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).sum())
    centre = means(x, code, k)
    off = np.sqrt(((x - centre[code]) ** 2).sum(1))
    inner = np.bincount(code, off) / size
    apart = np.sqrt(squared(centre, centre))
    np.fill_diagonal(apart, np.inf)
    worst = ((inner[:, None] + inner[None, :]) / np.maximum(apart, 1e-300)).max(axis=1)
    between = float((size * ((centre - x.mean(axis=0)) ** 2).sum(1)).sum())
    within = float((off * off).sum())
    return {"silhouette": total / n, "davies_bouldin": float(worst.mean()), "calinski_harabasz": between * (n - k) / max(within * (k - 1), 1e-300)}


def standard(x: np.ndarray) -> np.ndarray:
    """Columns of mean 0 and deviation 1, made in one copy."""
    out = x - x.mean(axis=0)
    s = np.sqrt(np.einsum("ij,ij->j", out, out) / max(len(x), 1))
    out /= np.where(s > 0, s, 1)
    return out


def stratified(labels: np.ndarray, n: int, seed: int = 42, at_least: int = 2) -> np.ndarray:
    """Places of about n rows, proportional by label with at least two of each."""
    rng, out = np.random.default_rng(seed), []
    for name in np.unique(labels):
        own = np.flatnonzero(labels == name)
        out.append(rng.permutation(own)[: max(int(len(own) * min(1.0, n / len(labels))), at_least)])
    return np.sort(rng.permutation(np.concatenate(out))[:n])


def agreement(clusters: np.ndarray, truth: np.ndarray, unknown: str = "Unknown", pure: float = 0.80) -> dict[str, float]:
    """Purities, entropy, mutual information and the number of pure clusters, from the contingency table alone."""
    names, b = np.unique(truth, return_inverse=True)
    _, a = np.unique(clusters, return_inverse=True)
    t = np.zeros((a.max() + 1, len(names)))
    np.add.at(t, (a, b), 1)
    n, size = t.sum(), t.sum(axis=1)
    p = t / size[:, None]
    top, who = p.max(axis=1), names[p.argmax(axis=1)]
    entropy = -(p * np.log2(p + 1e-12)).sum(axis=1)
    i, j = np.nonzero(t)
    h = lambda s: -float((s[s > 0] / n * np.log(s[s > 0] / n)).sum())
    both = h(size) + h(t.sum(axis=0))
    mutual = float((t[i, j] / n * np.log(n * t[i, j] / (size[i] * t.sum(axis=0)[j]))).sum())
    return {
        "weighted_purity": float((top * size).sum() / n),
        "macro_purity": float(top.mean()),
        "weighted_entropy": float((entropy * size).sum() / n),
        "nmi": 2 * mutual / both if both > 0 else 1.0,
        "ami": linalg.adjusted_information(t),
        "pure_clusters": float(((top >= pure) & (who != unknown)).sum()),
    }


class FlagTree:
    """A decision tree on binary columns, from counts of (flags, label): its input is at most 2^flags x labels numbers, whatever the rows."""

    def __init__(self, counts: np.ndarray, depth: int = 5):
        """``counts`` has a row for each combination of flags, in binary order (the first flag is the lowest bit)."""
        self.bits = np.array([[c >> j & 1 for j in range(max(1, len(counts) - 1).bit_length())] for c in range(len(counts))], bool)
        self.leaf = np.zeros(len(counts), int)
        self._split(counts, np.arange(len(counts)), depth)

    @staticmethod
    def _impurity(t: np.ndarray) -> float:
        n = t.sum()
        return float(n - (t * t).sum() / n) if n else 0.0

    def _split(self, counts: np.ndarray, at: np.ndarray, depth: int) -> None:
        whole = counts[at].sum(axis=0)
        base, best = self._impurity(whole), None
        if depth and base > 0:
            for j in range(self.bits.shape[1]):
                on = at[self.bits[at, j]]
                yes = counts[on].sum(axis=0)
                if 0 < yes.sum() < whole.sum():
                    gain = base - self._impurity(yes) - self._impurity(whole - yes)
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, j
        if best is None:
            self.leaf[at] = int(whole.argmax())
            return
        side = self.bits[at, best[1]]
        self._split(counts, at[side], depth - 1)
        self._split(counts, at[~side], depth - 1)


def tree_scores(flags: np.ndarray, labels: np.ndarray, seed: int, test: float = 0.3) -> dict[str, float]:
    """Accuracy, balanced accuracy and macro F1 on held-out rows of a tree that predicts the label from the flags."""
    names, y = np.unique(labels, return_inverse=True)
    cell = (flags > 0) @ (1 << np.arange(flags.shape[1]))
    held = np.random.default_rng(seed).random(len(y)) < test
    counts = np.zeros((1 << flags.shape[1], len(names)))
    np.add.at(counts, (cell[~held], y[~held]), 1)
    t = np.zeros((len(names), len(names)))
    np.add.at(t, (y[held], FlagTree(counts).leaf[cell[held]]), 1)
    true, said, hit = t.sum(axis=1), t.sum(axis=0), np.diag(t)
    seen = true + said > 0
    return {"tree_accuracy": float(hit.sum() / max(1, t.sum())), "tree_balanced_accuracy": float((hit[true > 0] / true[true > 0]).mean()) if (true > 0).any() else 0.0, "tree_macro_f1": float((2 * hit[seen] / (true + said)[seen]).mean()) if seen.any() else 0.0}


def blended(seeds: np.ndarray, guided: np.ndarray, share: float) -> np.ndarray:
    return blend(seeds, guided, share)


def layout(x: np.ndarray, dims: int = 2, neighbours: int = 30, min_dist: float = 0.1, epochs: int = 200, seed: int = 42) -> np.ndarray:
    """A neighbour-graph layout of a bounded sample (uniform manifold approximation): fuzzy weights that sum to log2 of the neighbours around every
    row, joined by probabilistic union, then attraction along edges and repulsion from random rows, by gradient steps on all edges at once.
    """
    n = len(x)
    k = min(neighbours, n - 1)
    if k < 1:
        return np.zeros((n, dims))
    d = np.sqrt(squared(x, x))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, axis=1)
    beyond = np.maximum(dist - dist[:, :1], 0)
    lo, hi = np.full(n, 1e-9), np.full(n, max(float(beyond.max()), 1e-9) * 8 + 1e-9)
    for _ in range(60):  # the width at which a row's weights sum to log2(k)
        mid = (lo + hi) / 2
        much = np.exp(-beyond / mid[:, None]).sum(axis=1) > np.log2(max(k, 2))
        hi, lo = np.where(much, mid, hi), np.where(much, lo, mid)
    w = np.zeros((n, n))
    np.put_along_axis(w, near, np.exp(-beyond / hi[:, None]), axis=1)
    w = w + w.T - w * w.T
    i, j = np.nonzero(np.triu(w))
    weight = w[i, j]
    # 1 / (1 + a r^2b) close to 1 up to min_dist and exp(min_dist - r) from there
    r = np.linspace(1e-3, 3, 300)
    want = np.where(r <= min_dist, 1.0, np.exp(min_dist - r))
    grid = [(a, b) for a in np.linspace(0.5, 3, 26) for b in np.linspace(0.6, 1.4, 17)]
    a, b = min(grid, key=lambda p: float(((1 / (1 + p[0] * r ** (2 * p[1])) - want) ** 2).sum()))
    rng = np.random.default_rng(seed)
    y = rng.uniform(-10, 10, (n, dims))
    share = weight / weight.max()
    for e in range(epochs):
        rate = 1.0 - e / epochs
        on = rng.random(len(i)) < share
        p, q = i[on], j[on]
        gap = y[p] - y[q]
        r2 = (gap * gap).sum(axis=1) + 1e-9
        pull = np.clip((-2 * a * b * r2 ** (b - 1) / (1 + a * r2**b))[:, None] * gap, -4, 4)
        far = rng.integers(0, n, (len(p), 5))
        apart = y[p][:, None] - y[far]
        f2 = (apart * apart).sum(axis=2) + 1e-3
        push = np.clip((2 * b / (f2 * (1 + a * f2**b)))[:, :, None] * apart, -4, 4) * (far != p[:, None])[:, :, None]
        step = np.zeros_like(y)
        np.add.at(step, p, pull + push.sum(axis=1))
        np.add.at(step, q, -pull)
        busy = np.maximum(np.bincount(np.concatenate([p, q]), minlength=n), 1)[:, None]
        y = y + rate * np.clip(step / np.sqrt(busy), -4, 4)
    return y - y.mean(axis=0)
