"""Diagonal Gaussian mixture by EM; each step is one pass with K x d sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _log_density(x: np.ndarray, mean: np.ndarray, var: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = np.log(weight) - 0.5 * np.log(2 * np.pi * var).sum(axis=1)
    return out - 0.5 * ((x[:, None, :] - mean[None]) ** 2 / var[None]).sum(axis=2)


def diagonal_mixture(df: DataFrame, means: np.ndarray, iterations: int = 20, floor: float = 1e-5, vector: str = "embedding", tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """(means, variances, weights, mean log-likelihoods) from given means."""
    k, dim = means.shape
    var, weight, history = np.ones((k, dim)), np.full(k, 1 / k), []
    sc = df.sparkSession.sparkContext
    for _ in range(iterations):
        shared = sc.broadcast((means, var, weight))

        def partial(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            n, s, q, like, rows = np.zeros(k), np.zeros((k, dim)), np.zeros((k, dim)), 0.0, 0
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                    p = _log_density(x, *shared.value)
                    top = p.max(axis=1, keepdims=True)
                    total = top[:, 0] + np.log(np.exp(p - top).sum(axis=1))
                    r = np.exp(p - total[:, None])
                    n, s, q, like, rows = n + r.sum(0), s + r.T @ x, q + r.T @ (x * x), like + total.sum(), rows + len(x)
            yield pd.DataFrame({"k": np.repeat(np.arange(k), dim), "j": np.tile(np.arange(dim), k), "n": np.repeat(n, dim), "s": s.ravel(), "q": q.ravel(), "l": like, "m": float(rows)})

        rows = df.select(vector).mapInPandas(partial, "k int, j int, n double, s double, q double, l double, m double").groupBy("k", "j").agg(*[F.sum(c).alias(c) for c in "nsqlm"]).toPandas().sort_values(["k", "j"])
        n, s, q = (rows[c].to_numpy().reshape(k, dim) for c in "nsq")
        n = np.maximum(n, 1e-12)
        means, weight = s / n, n[:, 0] / n[:, 0].sum()
        var = np.maximum(q / n - means**2, 0) + floor
        history.append(float(rows["l"].iloc[0] / rows["m"].iloc[0]))
        if len(history) > 1 and abs(history[-1] - history[-2]) < tolerance:
            break
    return means, var, weight, history


def assign_mixture(df: DataFrame, means: np.ndarray, var: np.ndarray, weight: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((means, var, weight))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                p = _log_density(np.stack(pdf[vector].to_numpy()).astype(np.float64), *shared.value)
                yield pd.DataFrame({key: pdf[key], "cluster": p.argmax(axis=1).astype(np.int32)})

    return df.select(key, vector).mapInPandas(run, f"{key} bigint, cluster int")
