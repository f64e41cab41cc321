"""K-means from given centres. Centres are a small K x d matrix on the driver; rows never leave the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from ledgerlens.operators.neighbours import distances


def centroids(df: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """(label, dim, val): mean vectors."""
    long = df.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    return long.groupBy(label, "dim").agg(F.avg("x").alias("val"))


def centre_matrix(df: DataFrame, label: str, vector: str = "embedding") -> tuple[list, np.ndarray]:
    rows = centroids(df, label, vector).orderBy(label, "dim").collect()  # K x d values
    names = sorted({r[0] for r in rows})
    return names, np.array([r["val"] for r in rows]).reshape(len(names), -1)


def vectors(batch: pa.RecordBatch, vector: str) -> np.ndarray:
    """The vectors of a batch, without a Python object per row."""
    column = batch.column(vector)
    if column.null_count or len(pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("vectors must be there and of one length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(batch), -1)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of tied ones, and its distance, both as ``distances`` gives them. Products tell the
    nearest; only rows for which another one is as near but for rounding are measured to all centres by differences."""
    size, own = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", centres, centres)
    d = x @ np.ascontiguousarray(-2 * centres.T)
    d += own
    at = d.argmin(axis=1)
    least = d[np.arange(len(x)), at]
    open_ = ~np.isfinite(least) | ((d <= (least + 1e-9 * (size + own.max()))[:, None]).sum(axis=1) > 1)
    if open_.any():
        at[open_] = distances(x[open_], centres).argmin(axis=1)
    dist = np.zeros(len(x))
    for j in range(x.shape[1]):
        r = x[:, j] - centres[at, j]
        dist += r * r
    return at, np.sqrt(dist)


def assign(df: DataFrame, centres: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, dist): the nearest centre, the first of tied ones."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centres, np.float64))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at, dist = nearest_centre(vectors(batch, vector), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(at.astype(np.int32)), pa.array(dist)], [key, "cluster", "dist"])

    return df.select(key, vector).mapInArrow(nearest, f"{key} {df.schema[key].dataType.simpleString()}, cluster int, dist double")


def step(df: DataFrame, centres: np.ndarray, vector: str = "embedding") -> tuple[np.ndarray, float]:
    """One Lloyd step: new centres and the inertia of the old ones. Partial sums of each partition are K x d; an empty
    cluster keeps its centre."""
    k, dim = centres.shape
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centres, np.float64))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, inertia = np.zeros((k, dim)), np.zeros(k), np.zeros(k)
        for batch in batches:
            if len(batch):
                x = vectors(batch, vector)
                at, dist = nearest_centre(x, shared.value)
                sums += np.column_stack([np.bincount(at, x[:, j], minlength=k) for j in range(dim)])
                n += np.bincount(at, minlength=k)
                inertia += np.bincount(at, dist**2, minlength=k)
        found = {"cluster": np.repeat(np.arange(k, dtype=np.int32), dim), "dim": np.tile(np.arange(dim, dtype=np.int32), k), "s": sums.ravel(), "n": np.repeat(n, dim), "i": np.repeat(inertia, dim)}
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.values()], list(found))

    rows = df.select(vector).mapInArrow(partial, "cluster int, dim int, s double, n double, i double").groupBy("cluster", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("i").alias("i")).collect()
    new, inertia = centres.copy(), 0.0
    for r in rows:
        if r.n:
            new[r.cluster, r.dim] = r.s / r.n
        if r.dim == 0:
            inertia += r.i
    return new, inertia


def seeded_kmeans(df: DataFrame, centres: np.ndarray, iterations: int = 20, tolerance: float = 1e-6, vector: str = "embedding") -> tuple[np.ndarray, list[float]]:
    """Lloyd from given centres; returns centres and the inertia before each step. Nothing is sent but K x d sums, so lineage
    doesn't grow."""
    history: list[float] = []
    for _ in range(iterations):
        new, inertia = step(df, centres, vector)
        history.append(inertia)
        moved, centres = float(np.abs(new - centres).max()), new
        if moved < tolerance:
            break
    return centres, history


def plain_kmeans(df: DataFrame, k: int, seed: int = 42, restarts: int = 1, vector: str = "embedding", iterations: int = 50) -> np.ndarray:
    """k-means++ (parallel form) by Spark ML, the best of several seeds."""
    data = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    models = [KMeans(k=k, seed=seed + i, maxIter=iterations).fit(data) for i in range(restarts)]
    return np.array(min(models, key=lambda m: m.summary.trainingCost).clusterCenters())


def allocate_seeds(sizes: dict[str, int], k: int, at_least: int = 500) -> dict[str, int]:
    """Seeds per family: proportional (halves to even), at least one; then the largest shares shrink or the largest families grow
    until they sum to k. Families below ``at_least`` rows and Unknown get none."""
    used = {f: n for f, n in sizes.items() if n >= at_least and f != "Unknown"}
    if not used:
        return {}
    total = sum(used.values())
    out = {f: max(1, round(k * n / total)) for f, n in used.items()}
    while sum(out.values()) > k and max(out.values()) > 1:
        f = min((f for f in out if out[f] > 1), key=lambda f: (-out[f], used[f], f))
        out[f] -= 1
    while sum(out.values()) < k:
        out[max(used, key=lambda f: (used[f], f))] += 1
    return out


def seed_centres(df: DataFrame, family: str, allocation: dict[str, int], vector: str = "embedding", seed: int = 42, tasks: int | None = None) -> np.ndarray:
    """The mean of a family with one seed, k-means centres of a family with more, searched by at most so many ``tasks`` at once."""
    parts = []
    for f, n in sorted(allocation.items()):
        own = df.where(F.col(family) == f)
        parts.append(centre_matrix(own, family, vector)[1] if n == 1 else plain_kmeans(own.coalesce(tasks) if tasks else own, n, seed, vector=vector))
    return np.concatenate(parts)


def blend(seeds: np.ndarray, guided: np.ndarray, share: float = 0.60) -> np.ndarray:
    """share * seed + (1 - share) * the centre assigned to it one to one at least squared distance."""
    from ledgerlens.operators.linalg import hungarian

    if seeds.shape != guided.shape:
        raise ValueError("centre sets must have one shape")
    return share * seeds + (1 - share) * guided[hungarian(distances(seeds, guided) ** 2)]
