"""Nearest neighbours of vectors, and distances within a sample.

Neighbours are searched block against block and merged, for any number of rows on both sides. Pairwise metrics take a bounded sample, which
is broadcast as one matrix after a check of its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_REFERENCE = 20_000
BLOCK = 4_096  # rows of a block of either side
MAX_CELLS = 4_000_000  # distances held at once


def reference_matrix(refs: DataFrame, key: str, vector: str, limit: int = MAX_REFERENCE) -> tuple[np.ndarray, np.ndarray]:
    rows = refs.select(key, vector).orderBy(key).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a reference set has at most {limit} rows")
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)


def distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Euclidean, by differences: exact for equal vectors."""
    out = np.zeros((len(q), len(r)))
    for j in range(q.shape[1]):
        d = q[:, j, None] - r[None, :, j]
        out += d * d
    return np.sqrt(out)


def blocks(pdf: pd.DataFrame, n_refs: int) -> Iterator[pd.DataFrame]:
    step = max(1, MAX_CELLS // max(1, n_refs))
    for i in range(0, len(pdf), step):
        yield pdf.iloc[i : i + step]


def nearest_of(src: np.ndarray, q: np.ndarray, ids: np.ndarray, r: np.ndarray, k: int, exclude_self: bool) -> pd.DataFrame:
    """(src, dst, dist): the k nearest rows of r of each row of q, ties by id. Products tell which can be among them, within their own
    rounding; the distances of those are by differences, as in ``distances``."""
    qq, rr = (q * q).sum(axis=1)[:, None], (r * r).sum(axis=1)[None, :]
    d, slack = qq + rr - 2 * (q @ r.T), 1e-12 * (qq + rr)
    if exclude_self:
        d[src[:, None] == ids[None, :]] = np.inf
    far = np.partition(d + slack, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
    i, j = np.nonzero((d - slack <= far[:, None]) & np.isfinite(d))
    exact = np.zeros(len(i))
    for c in range(q.shape[1]):
        x = q[i, c] - r[j, c]
        exact += x * x
    out = pd.DataFrame({"src": src[i], "dst": ids[j], "dist": np.sqrt(exact)})
    order = np.lexsort((out["dst"], out["dist"], i))
    out, i = out.iloc[order], i[order]
    return out[np.arange(len(i)) - np.searchsorted(i, i) < k]


def k_nearest(queries: DataFrame, refs: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", exclude_self: bool = True, block: int = BLOCK) -> DataFrame:
    """(src, dst, rank, dist): the k nearest references of each query, ties by key; a row isn't its own neighbour, by key. Keys are unique.

    Both sides are cut into blocks of about ``block`` rows by the key's hash and each pair of blocks is searched in a group of its own, so no
    side has a limit and no row passes the driver; the best of the blocks are then merged. The work grows with queries x references.
    """
    n_q, n_r = (max(1, math.ceil(df.count() / block)) for df in (queries, refs))

    def cut(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.select(F.col(key).alias("id"), F.col(vector).alias("x"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"src": [], "dst": [], "dist": []})]
        if len(left) and len(right):
            ids, matrix = right["id"].to_numpy(), np.stack(right["x"].to_numpy()).astype(np.float64)
            found = [nearest_of(p["id"].to_numpy(), np.stack(p["x"].to_numpy()).astype(np.float64), ids, matrix, k, exclude_self) for p in blocks(left, len(ids))]
        return pd.concat(found)

    q, r = cut(queries, "_q", n_q, "_r", n_r), cut(refs, "_r", n_r, "_q", n_q)
    near = q.groupBy("_q", "_r").cogroup(r.groupBy("_q", "_r")).applyInPandas(search, "src bigint, dst bigint, dist double")
    rank = F.row_number().over(W.partitionBy("src").orderBy("dist", "dst"))  # k rows of each reference block
    return near.select("src", "dst", rank.alias("rank"), "dist").where(F.col("rank") <= k)


def mean_distances(df: DataFrame, label: str, key: str = "vec_id", vector: str = "embedding", limit: int = MAX_REFERENCE) -> DataFrame:
    """(key, own, other, members, total): for each row and each label the sum of distances to that label's rows."""
    rows = df.select(key, vector, label).orderBy(key).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"pairwise metrics take a sample of at most {limit} rows")
    matrix = np.array([r[1] for r in rows], np.float64)
    names, code = np.unique([r[2] for r in rows], return_inverse=True)
    shared = df.sparkSession.sparkContext.broadcast((matrix, names, code))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, names, code = shared.value
        onehot = np.eye(len(names))[code]
        size = onehot.sum(axis=0)
        for whole in batches:
            for pdf in blocks(whole, len(matrix)):
                d = distances(np.stack(pdf[vector].to_numpy()).astype(np.float64), matrix) @ onehot
                n, m = d.shape
                yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), m), "own": np.repeat(pdf[label].to_numpy(), m), "other": np.tile(names, n), "members": np.tile(size, n).astype(np.int64), "total": d.ravel()})

    kind = df.schema[label].dataType.simpleString()
    return df.select(key, vector, label).mapInPandas(measure, f"{key} bigint, own {kind}, other {kind}, members bigint, total double")
