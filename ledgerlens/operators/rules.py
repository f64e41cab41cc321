"""Profile labels from flags, and names of clusters from their members' labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Flag and label, in order of precedence.
RULES = (
    ("has_coinbase", "Coinbase"),
    ("is_coinjoin_like", "Coinjoin_Mixer"),
    ("is_batch_payment", "Batch_Payment"),
    ("is_consolidation", "Consolidation"),
    ("is_distribution", "Distribution"),
    ("is_peer_to_peer", "Standard_P2P"),
    ("has_op_return", "OP_Return"),
    ("rbf_enabled", "RBF_Enabled"),
)
UNKNOWN = "Unknown"


def _chain(rules, columns) -> Column:
    out = None
    for flag, label in rules:
        if flag in columns:
            hit = F.coalesce(F.col(flag).cast("int") > 0, F.lit(False))
            out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(UNKNOWN) if out is None else out.otherwise(UNKNOWN)


def first_match(columns: list[str]) -> Column:
    """The label of the first rule that holds; rules without a column are skipped."""
    return _chain(RULES, columns)


def last_match(columns: list[str]) -> Column:
    """The label of the last rule that holds."""
    return _chain(RULES[::-1], columns)


def majority(df: DataFrame, cluster: str, label: str, exclude: str | None = None) -> DataFrame:
    """(cluster, label, n): the most frequent label of each cluster; ties go to the first in the alphabet."""
    rows = df.where(F.col(label).isNotNull())
    rows = rows if exclude is None else rows.where(F.col(label) != exclude)
    counts = rows.groupBy(cluster, label).agg(F.count("*").alias("n"))
    return counts.withColumn("_r", F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("n"), label))).where("_r = 1").drop("_r")


def semantic_names(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, cluster_name): majority labels; a label's second cluster and further ones are numbered in cluster order.
    Clusters without any known label are Empty_<cluster> and take no number."""
    best = majority(df, cluster, label, UNKNOWN).select(cluster, F.col(label).alias("best"))
    named = df.select(cluster).where(F.col(cluster).isNotNull()).distinct().join(best, cluster, "left")
    k = F.row_number().over(W.partitionBy("best").orderBy(cluster)) - 1  # a row per cluster
    return named.withColumn("_k", k).select(cluster, F.when(F.col("best").isNull(), F.concat(F.lit("Empty_"), F.col(cluster).cast("string"))).when(F.col("_k") == 0, F.col("best")).otherwise(F.concat_ws("_", "best", F.col("_k").cast("string"))).alias("cluster_name"))
