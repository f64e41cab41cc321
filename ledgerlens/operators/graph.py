"""Similarity graphs as edge tables: weights, Laplacians and what is read from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import bounded


def similarity_edges(neighbours: DataFrame, floor: float = 0.01) -> DataFrame:
    """(src, dst, w) from (src, dst, dist): exp(-d^2 / s^2) with s^2 the mean of the positive squared distances. Both
    directions are added up, so mutual neighbours count twice."""
    scale = neighbours.agg(F.greatest(F.coalesce(F.avg(F.when(F.col("dist") > 0, F.col("dist") * F.col("dist"))), F.lit(floor)), F.lit(floor)).alias("s2"))
    w = neighbours.join(F.broadcast(scale), how="cross").select("src", "dst", F.exp(-F.col("dist") * F.col("dist") / F.col("s2")).alias("w"))
    both = w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def anchor_graph(spark: SparkSession, x: np.ndarray, anchors: int, k: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(src, dst, w) and (node, dim, val) of a bounded sample's anchors, its mini-batch centres: a pair of neighbours weighs
    exp(-d^2 / 2 s^2) sqrt(n_i n_j), with n the rows of an anchor and s the median positive distance; one-way pairs count half."""
    centres = bounded.stream_kmeans(x, bounded.spread_start(x, anchors, np.random.default_rng(seed)), 50_000, 40, seed)
    n = np.bincount(bounded.nearest(x, centres), minlength=anchors).astype(float)
    centres, n = centres[n > 0], n[n > 0]
    d = bounded.squared(centres, centres)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(centres) - 1)
    j = np.argsort(d, axis=1, kind="stable")[:, :k]
    i = np.repeat(np.arange(len(centres)), k)
    j = j.ravel()
    dist = np.sqrt(d[i, j])
    scale = max(float(np.median(dist[dist > 0])), 1e-6) if (dist > 0).any() else 1.0
    w = np.exp(-dist * dist / (2 * scale * scale)) * np.sqrt(n[i] * n[j]) / 2
    edges = spark.createDataFrame(pd.DataFrame({"src": np.concatenate([i, j]), "dst": np.concatenate([j, i]), "w": np.concatenate([w, w])})).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    dim = centres.shape[1]
    values = pd.DataFrame({"node": np.repeat(np.arange(len(centres)), dim), "dim": np.tile(np.arange(dim, dtype=np.int32), len(centres)), "val": centres.ravel()})
    return edges, spark.createDataFrame(values)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum("w").alias("degree")).withColumnRenamed("src", "node")


def normalised_laplacian(edges: DataFrame) -> DataFrame:
    """(src, dst, val): I - D^-1/2 W D^-1/2, with the diagonal as edges of a node to itself."""
    d = degrees(edges).where("degree > 0")
    off = edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("di")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dj")), "dst")
    off = off.select("src", "dst", (-F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("val"))
    return d.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("val")).unionByName(off)


def _on_edges(edges: DataFrame, values: DataFrame) -> DataFrame:
    a = values.select(F.col("node").alias("src"), "dim", F.col("val").alias("fi"))
    b = values.select(F.col("node").alias("dst"), "dim", F.col("val").alias("fj"))
    return edges.join(a, "src").join(b, ["dst", "dim"])


def laplacian_scores(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(dim, laplacian_score) of features given as (node, dim, val): f'Lf / f'Df with f centred by degree. A constant feature has
    no score (null)."""
    d = degrees(edges)
    weighed = values.join(d, "node").groupBy("dim").agg(F.sum("degree").alias("sd"), F.sum(F.col("degree") * F.col("val")).alias("sf"), F.sum(F.col("degree") * F.col("val") * F.col("val")).alias("sff"))
    energy = _on_edges(edges, values).groupBy("dim").agg((F.sum(F.col("w") * (F.col("fi") - F.col("fj")) * (F.col("fi") - F.col("fj"))) / 2).alias("energy"))
    spread = F.col("sff") - F.col("sf") * F.col("sf") / F.col("sd")
    return energy.join(weighed, "dim").select("dim", F.when(spread > 1e-12, F.col("energy") / spread).alias("laplacian_score"))


def rayleigh_quotients(laplacian: DataFrame, values: DataFrame) -> DataFrame:
    """(dim, rayleigh): v'Lv / (v'v + 1e-12)."""
    top = _on_edges(laplacian.withColumnRenamed("val", "w"), values).groupBy("dim").agg(F.sum(F.col("w") * F.col("fi") * F.col("fj")).alias("top"))
    norm = values.groupBy("dim").agg(F.sum(F.col("val") * F.col("val")).alias("norm"))
    return top.join(norm, "dim").select("dim", (F.col("top") / (F.col("norm") + F.lit(1e-12))).alias("rayleigh"))


def rescue_isolated(edges: DataFrame, nodes: DataFrame, vectors: DataFrame, weight: float = 0.01) -> DataFrame:
    """Edges with an edge of fixed weight from every node without one to its nearest connected node, in both directions."""
    from ledgerlens.operators.neighbours import k_nearest

    active = edges.select(F.col("src").alias("vec_id")).distinct()
    lone = vectors.join(nodes, "vec_id", "left_semi").join(active, "vec_id", "left_anti")
    near = k_nearest(lone, vectors.join(active, "vec_id", "left_semi"), 1).select("src", "dst", F.lit(weight).alias("w"))
    return edges.unionByName(near).unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def eigengap_summary(values: DataFrame) -> DataFrame:
    """(n_dims, min_value, max_value, mean_value, max_gap, gap_dim) of (dim, eigenvalue); the first of tied gaps."""
    from pyspark.sql import Window as W

    one = W.partitionBy(F.lit(0)).orderBy("dim")
    gap = F.col("eigenvalue") - F.lag("eigenvalue").over(one)
    v = values.withColumn("gap", F.coalesce(gap, F.lit(0.0)))
    return v.agg(F.count("*").alias("n_dims"), F.min("eigenvalue").alias("min_value"), F.max("eigenvalue").alias("max_value"), F.avg("eigenvalue").alias("mean_value"), F.max("gap").alias("max_gap"), F.max_by("dim", F.struct("gap", -F.col("dim"))).alias("gap_dim"))
