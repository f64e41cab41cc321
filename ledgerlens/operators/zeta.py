"""Rank weights: rank^-s over its sum up to the number of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Exponents of the sensitivity sweep by column, and those of the fused rank.
SWEEP = {"w_s10": 1.0, "w_s15": 1.5, "w_s20": 2.0, "w_s30": 3.0}
LAPLACIAN_SHARE, INFORMATION_SHARE, FLAG_PENALTY = 0.70, 0.30, 10.0


def normaliser(n: int, s: float) -> float:
    """The finite sum that makes the weights of ranks 1..n sum to 1."""
    return sum(k**-s for k in range(1, n + 1))


def zeta(s: float, terms: int = 32) -> float:
    """The infinite sum, by Euler-Maclaurin; infinite for s <= 1."""
    if s <= 1:
        return float("inf")
    head = sum(k**-s for k in range(1, terms))
    return head + terms ** (1 - s) / (s - 1) + terms**-s / 2 + s * terms ** (-s - 1) / 12 - s * (s + 1) * (s + 2) * terms ** (-s - 3) / 720


def score_rank(score: str = "mi_score") -> Column:
    """Ties share a rank; NaN and null scores come last. The feature table is small, so one partition is right for it."""
    s = F.when(~F.isnan(score), F.col(score))
    return F.rank().over(W.partitionBy(F.lit(0)).orderBy(s.desc_nulls_last()))


def rank_weight(rank: Column, n: Column, s: float) -> Column:
    """With the normaliser as an expression over the number of features."""
    total = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda acc, k: acc + F.pow(k.cast("double"), F.lit(-s)))
    return F.pow(rank.cast("double"), F.lit(-s)) / total


def weigh_features(features: DataFrame, exponents: dict[str, float]) -> DataFrame:
    """Adds mi_rank and one weight column per exponent. With ties the weights don't sum to 1; ``weight_sum`` tells."""
    n = F.count("*").over(W.partitionBy(F.lit(0)))
    return features.withColumn("mi_rank", score_rank()).withColumns({c: rank_weight(F.col("mi_rank"), n, s) for c, s in exponents.items()})


def fuse_ranks(features: DataFrame) -> DataFrame:
    """(feature, lap_rank, mi_rank, flag_penalty, geom_rank_score, rank, geom_zeta_weight) from feature, laplacian_score, mi_rank."""
    one = W.partitionBy(F.lit(0))
    name = F.col("feature")
    flag = name.startswith("is_") | name.startswith("has_") | (name == "rbf_enabled")
    out = features.withColumn("lap_rank", F.row_number().over(one.orderBy("laplacian_score", "feature"))).withColumn("flag_penalty", F.when(flag, FLAG_PENALTY).otherwise(0.0))
    out = out.withColumn("geom_rank_score", LAPLACIAN_SHARE * F.col("lap_rank") + INFORMATION_SHARE * F.col("mi_rank") + F.col("flag_penalty"))
    out = out.withColumn("rank", F.row_number().over(one.orderBy("geom_rank_score", "laplacian_score", "mi_rank", "feature")))
    return out.withColumn("geom_zeta_weight", rank_weight(F.col("rank"), F.count("*").over(one), 1.5))
