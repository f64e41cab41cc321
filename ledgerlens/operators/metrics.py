"""Quality of clusterings, and agreement of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.operators.kmeans import centroids
from ledgerlens.operators.neighbours import MAX_REFERENCE, mean_distances


def silhouette(df: DataFrame, label: str, key: str = "vec_id", vector: str = "embedding", limit: int = MAX_REFERENCE) -> DataFrame:
    """(silhouette): plain Euclidean, of a bounded sample; members of singletons count 0."""
    means = mean_distances(df, label, key, vector, limit)
    per = means.groupBy(key).agg(
        F.max(F.when(F.col("own") == F.col("other"), F.col("members"))).alias("size"),
        F.max(F.when((F.col("own") == F.col("other")) & (F.col("members") > 1), F.col("total") / (F.col("members") - 1))).alias("a"),
        F.min(F.when(F.col("own") != F.col("other"), F.col("total") / F.col("members"))).alias("b"),
    )
    s = F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return per.agg(F.avg(s).alias("silhouette"))


def _long(df: DataFrame, label: str, key: str, vector: str) -> DataFrame:
    return df.select(key, label, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))


def scatter_of_members(df: DataFrame, label: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(label, n, spread, ss): mean distance to the centroid, and the sum of its squares."""
    c = centroids(df, label, vector)
    dist = _long(df, label, key, vector).join(c, [label, "dim"]).groupBy(key, label).agg(F.sum((F.col("x") - F.col("val")) * (F.col("x") - F.col("val"))).alias("d2"))
    return dist.groupBy(label).agg(F.count("*").alias("n"), F.avg(F.sqrt("d2")).alias("spread"), F.sum("d2").alias("ss"))


def davies_bouldin(df: DataFrame, label: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(davies_bouldin). Pairs of clusters are K x K."""
    c, s = centroids(df, label, vector), scatter_of_members(df, label, key, vector)
    b = c.select(F.col(label).alias("other"), "dim", F.col("val").alias("val2"))
    apart = c.join(b, "dim").where(F.col(label) != F.col("other")).groupBy(label, "other").agg(F.sqrt(F.sum((F.col("val") - F.col("val2")) * (F.col("val") - F.col("val2")))).alias("m"))
    ratio = apart.join(s.select(label, "spread"), label).join(s.select(F.col(label).alias("other"), F.col("spread").alias("spread2")), "other")
    worst = ratio.groupBy(label).agg(F.max((F.col("spread") + F.col("spread2")) / F.nullif("m", F.lit(0.0))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, label: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(calinski_harabasz)."""
    within = scatter_of_members(df, label, key, vector).agg(F.sum("ss").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    total = _long(df, label, key, vector).groupBy("dim").agg(F.var_pop("x").alias("v"), F.count("*").alias("m")).agg(F.sum(F.col("v") * F.col("m")).alias("t"))
    both = within.join(F.broadcast(total), how="cross")
    return both.select(((F.col("t") - F.col("w")) / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def purity(df: DataFrame, cluster: str, label: str, high: float = 0.80, unknown: str = "Unknown") -> DataFrame:
    """(weighted_purity, macro_purity, weighted_entropy, high_purity_clusters)."""
    own = W.partitionBy(cluster)  # over the contingency table
    t = contingency(df, cluster, label).withColumn("size", F.sum("n").over(own)).withColumn("p", F.col("n") / F.col("size"))
    per = t.groupBy(cluster).agg(F.max("size").alias("size"), F.max("p").alias("purity"), F.sum(-F.col("p") * F.log2(F.col("p") + F.lit(1e-12))).alias("entropy"), F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("top"))
    n = F.sum("size")
    return per.agg(
        (F.sum(F.col("purity") * F.col("size")) / n).alias("weighted_purity"),
        F.avg("purity").alias("macro_purity"),
        (F.sum(F.col("entropy") * F.col("size")) / n).alias("weighted_entropy"),
        F.count_if((F.col("purity") >= high) & (F.col("top") != unknown)).alias("high_purity_clusters"),
    )


def _entropy(p: Column) -> Column:
    return F.sum(-p * F.log(p))


def normalised_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """(mutual_information, nmi): normalised by the mean of the entropies; 1 where both are constant."""
    t = contingency(df, a, b)
    t = t.withColumn("all", F.sum("n").over(W.partitionBy(F.lit(0)))).withColumn("na", F.sum("n").over(W.partitionBy(a))).withColumn("nb", F.sum("n").over(W.partitionBy(b)))
    mi = t.agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n").cast("double") * F.col("all") / (F.col("na").cast("double") * F.col("nb")))).alias("mi"))
    ha = t.groupBy(a).agg(F.first(F.col("na") / F.col("all")).alias("p")).agg(_entropy(F.col("p")).alias("ha"))
    hb = t.groupBy(b).agg(F.first(F.col("nb") / F.col("all")).alias("p")).agg(_entropy(F.col("p")).alias("hb"))
    all_ = mi.join(F.broadcast(ha), how="cross").join(F.broadcast(hb), how="cross")
    return all_.select(F.col("mi").alias("mutual_information"), F.coalesce(F.try_divide(2 * F.col("mi"), F.col("ha") + F.col("hb")), F.lit(1.0)).alias("nmi"))


def classification_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(accuracy, balanced_accuracy, macro_f1): recall over the true labels, F1 over all labels seen."""
    t = contingency(df, truth, predicted)
    rows = t.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("true_n"))
    cols = t.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("pred_n"))
    hit = t.where(F.col(truth) == F.col(predicted)).select(F.col(truth).alias("label"), F.col("n").alias("hits"))
    per = rows.join(cols, "label", "full").join(hit, "label", "left").fillna(0, ["true_n", "pred_n", "hits"])
    f1 = 2 * F.col("hits") / (F.col("true_n") + F.col("pred_n"))
    return per.agg((F.sum("hits") / F.sum("true_n")).alias("accuracy"), F.avg(F.when(F.col("true_n") > 0, F.col("hits") / F.col("true_n"))).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))


def binned_information(df: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """(feature, mi_score): mutual information of equal-width bins and a label, all features in one pass. Nulls are left out."""
    edges = df.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))])
    wide = df.join(F.broadcast(edges), how="cross")

    def cell(c: str) -> Column:
        at = F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * bins), F.lit(bins - 1))
        return F.when(F.col(c).isNull(), None).when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), at).otherwise(0)

    long = wide.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), cell(c).cast("int").alias("bin")) for c in features])).alias("r")).select(label, "r.*").where("bin is not null")
    t = long.groupBy("feature", "bin", label).agg(F.count("*").alias("n"))
    t = t.withColumn("all", F.sum("n").over(W.partitionBy("feature"))).withColumn("na", F.sum("n").over(W.partitionBy("feature", "bin"))).withColumn("nb", F.sum("n").over(W.partitionBy("feature", label)))
    return t.groupBy("feature").agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n").cast("double") * F.col("all") / (F.col("na").cast("double") * F.col("nb")))).alias("mi_score"))
