"""Choosing among candidates by several metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.functions.columns import improvement

METRICS = {"silhouette": True, "davies_bouldin": False, "calinski_harabasz": True}  # whether higher is better


def rank_candidates(candidates: DataFrame, baseline: dict[str, float]) -> DataFrame:
    """Adds a rank per metric, their sum, how many metrics beat the baseline, and the place: candidates that beat it in all
    come first, then wins, rank sum, silhouette, and the name."""
    one = W.partitionBy(F.lit(0))  # a handful of candidates
    out = candidates
    for m, high in METRICS.items():
        out = out.withColumn(f"rank_{m}", F.row_number().over(one.orderBy(F.desc(m) if high else F.asc(m), "name")))
    better = [(F.col(m) > baseline[m] if high else F.col(m) < baseline[m]).cast("int") for m, high in METRICS.items()]
    out = out.withColumn("rank_sum", F.col("rank_silhouette") + F.col("rank_davies_bouldin") + F.col("rank_calinski_harabasz")).withColumn("wins", better[0] + better[1] + better[2]).withColumn("beats_all", F.col("wins") == 3)
    order = [F.desc("beats_all"), F.desc("wins"), F.asc("rank_sum"), F.desc("silhouette"), F.asc("davies_bouldin"), F.desc("calinski_harabasz"), F.asc("name")]
    return out.withColumn("place", F.row_number().over(one.orderBy(*order)))


def metric_winners(candidates: DataFrame) -> DataFrame:
    """(metric, winner, value); ties go to the first name."""
    rows = candidates.agg(*[F.min_by(F.struct(F.lit(m).alias("metric"), F.col("name").alias("winner"), F.col(m).alias("value")), F.struct(-F.col(m) if high else F.col(m), F.col("name"))).alias(m) for m, high in METRICS.items()])
    return rows.select(F.explode(F.array(*METRICS)).alias("r")).select("r.*")


def improvements(pairs: DataFrame) -> DataFrame:
    """(metric, new, old, improvement_pct, wins) from (metric, new, old, higher)."""
    pct = F.when(F.col("higher"), improvement(F.col("new"), F.col("old"))).otherwise(improvement(F.col("new"), F.col("old"), False))
    return pairs.withColumn("improvement_pct", pct).withColumn("wins", F.when(F.col("higher"), F.col("new") > F.col("old")).otherwise(F.col("new") < F.col("old")))


def repeat_summary(runs: DataFrame, by: str, metrics: list[str], digits: int = 6) -> DataFrame:
    """Mean and sample deviation of each metric over repeated runs."""
    return runs.groupBy(by).agg(*[F.round(f(m), digits).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
