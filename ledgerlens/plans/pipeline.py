"""The whole pipeline in one application: load, audit, transform, scale, weigh, cluster, name, score, report, verify.

Steps are functions of frames; what several steps read is staged once. Clusters are never changed by anomaly scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.operators import bounded, kmeans, linalg, manifest, metrics, report, resample, rules, scaling, zeta
from ledgerlens.plans.transactions import AMOUNTS, COUNTS, FLAGS, transactions
from ledgerlens.sources.tables import Stage, read_table

CLUSTERS = 30
SEED_MIN_ROWS, SEED_ROWS = 500, 100_000  # of a rule family: the least for a seed, and the sample that its seeds are searched on
SEED_TASKS = 2  # at once on such a sample: its many short steps cost more by the task than by the row


def feature_frame(spark: SparkSession, d: str, stage: Stage, with_raw: bool = False) -> DataFrame:
    """(_rid, profile, flags..., x): robustly scaled, weighted and standardised features of every row, nulls as 0; ``raw`` are those before scaling and weights."""
    df = scaling.log_transform(transactions(spark, d), AMOUNTS)
    columns = AMOUNTS + COUNTS + FLAGS
    df = df.withColumn("profile", rules.first_match(df.columns)).select("_rid", "profile", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns], *[F.col(c).alias(f"raw_{c}") for c in FLAGS])
    if with_raw:
        df = df.withColumn("raw", F.array(*columns))
    scaled = scaling.robust_scale(stage.put(df), columns)
    ranks = zeta.weigh_features(read_table(spark, d, "feature_ranks").select("feature", "mi_score"), {"w": 1.5}).select("feature", "w").collect()  # a row per feature
    weights = {r.feature: r.w for r in ranks}
    least = min(weights.values(), default=1.0)
    weighed = scaling.standard_scale(scaling.apply_weights(scaled, {c: weights.get(c, least) for c in columns}), columns)
    return stage.put(weighed.select("_rid", "profile", F.array(*columns).alias("x"), *(["raw"] if with_raw else []), *[F.col(f"raw_{c}").cast("double").alias(c) for c in FLAGS]))


def fit_rows(frame: DataFrame, rows: int) -> DataFrame:
    """A sample of at most ``rows`` rows in hash order."""
    return frame.orderBy(resample.hash_key("_rid", 42), "_rid").limit(rows)


def seed_allocation(frame: DataFrame, k: int) -> tuple[dict[str, int], dict[str, int]]:
    """(seeds, rows) by rule family, counted over all rows. Where no family reaches ``SEED_MIN_ROWS``, which the surveyed pipeline refuses,
    every family of two rows counts."""
    sizes = {r.profile: r["count"] for r in frame.groupBy("profile").count().collect()}  # a row per family
    return kmeans.allocate_seeds(sizes, k, SEED_MIN_ROWS) or kmeans.allocate_seeds(sizes, k, 2), sizes


def seeded_labels(frame: DataFrame, stage: Stage, k: int = CLUSTERS, iterations: int = 10) -> DataFrame:
    """(_rid, cluster, dist): Lloyd on all rows from centres of the rule families. Only the centres of a family of more than ``SEED_ROWS``
    rows start from a sample of about so many, as surveyed."""
    allocation, sizes = seed_allocation(frame, k)
    if not allocation:
        raise ValueError("no rule family is large enough for a seed")
    share = F.element_at(F.create_map(*[F.lit(v) for f in allocation for v in (f, SEED_ROWS / sizes[f])]), F.col("profile"))
    rows = frame.where(F.col("profile").isin(*allocation)).where(F.pmod(F.xxhash64("_rid"), F.lit(1 << 30)) < share * (1 << 30))
    seeds = kmeans.seed_centres(stage.put(rows.select("_rid", "profile", "x")), "profile", allocation, "x", tasks=SEED_TASKS)
    centres, _ = kmeans.seeded_kmeans(frame, seeds, iterations, vector="x")
    return kmeans.assign(frame, centres, "_rid", "x")


def anomaly_scores(frame: DataFrame, trees: int = 200, rows: int = 200_000) -> DataFrame:
    """(_rid, anomaly_score): isolation scores of all rows from trees grown on a bounded sample."""
    forest = frame.sparkSession.sparkContext.broadcast(linalg.IsolationForest(bounded.matrix(fit_rows(frame, rows), "x"), trees))

    def score(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"_rid": pdf["_rid"], "anomaly_score": forest.value.score(np.stack(pdf["x"].to_numpy()))})

    return frame.select("_rid", "x").mapInPandas(score, "_rid string, anomaly_score double")


def run(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All results by name. Raises if the parts don't have the same rows."""
    stage = Stage(spark)
    frame = feature_frame(spark, d, stage)
    labels = stage.put(seeded_labels(frame, stage))
    scores = stage.put(report.anomaly_flag(anomaly_scores(frame), "anomaly_score"))
    rows = frame.count(), labels.count(), scores.count()
    if len(set(rows)) != 1:
        raise ValueError(f"features, labels and scores differ in rows: {rows}")
    working = frame.select("_rid", "profile", *FLAGS).join(labels.select("_rid", "cluster"), "_rid").join(scores.select("_rid", "anomaly_score", F.col("flag").alias("is_anomaly")), "_rid")
    names = rules.semantic_names(working, "cluster", "profile")
    working = stage.put(working.join(F.broadcast(names), "cluster"))  # a row per cluster
    return {
        "working": working,
        "names": names,
        "statistics": report.profile_statistics(working, "cluster_name", {c: F.col(c) for c in FLAGS}, "is_anomaly", "anomaly_score"),
        "agreement": metrics.purity(working, "cluster", "profile"),
    }


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the named clusters that the pipeline finds."""
    return run(spark, d)["statistics"]


def column_manifest(spark: SparkSession, d: str) -> DataFrame:
    """(role, column_name) of the delivered table."""
    m = manifest.build_manifest(read_table(spark, d, "dataset")).as_dict()
    return spark.createDataFrame([(role, c) for role, cols in m.items() if role != "total_rows" for c in cols], "role string, column_name string")


QUERIES = {"pipeline_profiles": profiles, "column_manifest": column_manifest}
