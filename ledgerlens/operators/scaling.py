"""Scaling of feature columns. Parameters are one-row frames, joined by broadcast; nothing is fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.columns import log_amount
from ledgerlens.operators.skew import quantile_row


def log_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: log_amount(c) for c in columns})


def _apply(df: DataFrame, columns: list[str], params: DataFrame) -> DataFrame:
    """(x - centre) / spread, where a spread of 0 counts as 1."""
    spread = {c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    out = df.join(F.broadcast(params), how="cross")  # one row of parameters
    return out.withColumns({c: (F.col(c) - F.col(f"_c_{c}")) / spread[c] for c in columns}).drop(*[f"_{k}_{c}" for k in "cs" for c in columns])


def robust_scale(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Median and interquartile range, exact. Spark's own scaler would map columns without range to 0 and uses approximate quantiles."""
    q = quantile_row(df if fit_on is None else fit_on, columns, [0.25, 0.5, 0.75])
    return _apply(df, columns, q.select(*[F.col(c)[1].alias(f"_c_{c}") for c in columns], *[(F.col(c)[2] - F.col(c)[0]).alias(f"_s_{c}") for c in columns]))


def standard_scale(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Mean and population deviation."""
    source = df if fit_on is None else fit_on
    return _apply(df, columns, source.agg(*[F.avg(c).alias(f"_c_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]))


def minmax_scale(df: DataFrame, column: str, out: str) -> DataFrame:
    """(x - min) / (max - min + 1e-9)."""
    p = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.join(F.broadcast(p), how="cross").withColumn(out, (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(1e-9))).drop("_lo", "_hi")


def apply_weights(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(float(w)) for c, w in weights.items()})
