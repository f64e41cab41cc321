"""Fitted parameters as Parquet: named arrays and numbers, without pickles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

_SCHEMA = "name string, shape array<int>, values array<double>"


def save_model(spark: SparkSession, path: str, parameters: dict[str, np.ndarray | float]) -> None:
    """One row per parameter; they are bounded (centres, scales, matrices of features)."""
    rows = [(n, list(np.shape(v)), np.asarray(v, float).ravel().tolist()) for n, v in sorted(parameters.items())]
    spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> dict[str, np.ndarray | float]:
    out = {}
    for r in spark.read.schema(_SCHEMA).parquet(path).collect():
        v = np.array(r["values"], float).reshape(r["shape"])
        out[r["name"]] = float(v) if v.ndim == 0 else v
    return out
