"""Sampling by hash: exact sizes, no order of rows needed, the same rows in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.functions.columns import md5_int
from ledgerlens.operators.ranks import numbered
from ledgerlens.sources.tables import Stage

CHUNK = 10_000


def hash_key(rid: str, seed: int | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(rid)))


def quota_sample(df: DataFrame, group: str, quota: Column | int, rid: str, seed: int = 42, salts: int = 64) -> DataFrame:
    """The ``quota`` rows of each group with the smallest hashes. The window runs over salted parts first, so a group that
    holds most rows isn't sorted in one task. A quota column must be constant within a group."""
    q = F.lit(quota) if isinstance(quota, int) else quota
    out = df.withColumn("_h", hash_key(rid, seed)).withColumn("_q", q).withColumn("_s", F.pmod(F.xxhash64(rid), F.lit(salts)))
    for by in ([group, "_s"], [group]):
        out = out.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_h", rid))).where(F.col("_r") <= F.col("_q"))
    return out.drop("_h", "_q", "_s", "_r")


def proportional_sample(df: DataFrame, group: str, share: float, rid: str, seed: int = 42, at_least: int = 2, stage: Stage | None = None) -> DataFrame:
    """max(int(share * n), at_least) rows of each group, all of a smaller one. Ranks come from range partitions, as a group's quota
    grows with the table."""
    stage = stage or Stage(df.sparkSession)
    sizes = df.groupBy(group).agg(F.greatest(F.floor(F.count("*") * F.lit(share)), F.lit(at_least)).alias("_quota")).withColumnRenamed(group, "_g")
    ranked = numbered(df.withColumn("_h", hash_key(rid, seed)), ["_h", rid], stage, group=group, name="_rank")
    return ranked.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).where(F.col("_rank") < F.col("_quota")).drop("_g", "_h", "_rank", "_quota")


def split_of(rid: str, parts: dict[str, float], seed: int = 42) -> Column:
    """The part a row falls in; shares in the order given, the last takes the rest."""
    u = md5_int(F.lit(str(seed)), F.col(rid), digits=8) / F.lit(float(16**8))
    names, edge, out = list(parts), 0.0, None
    for n in names[:-1]:
        edge += parts[n]
        out = F.when(u < edge, n) if out is None else out.when(u < edge, n)
    return out.otherwise(names[-1])


def balance_targets(df: DataFrame, stratum: str, share: float = 0.30) -> DataFrame:
    """(stratum, n, target, balanced_n): strata strictly below ``share`` of the largest grow to it."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n"))
    target = F.floor(F.max("n").over(W.partitionBy(F.lit(0))) * F.lit(share))  # a row per stratum
    return sizes.withColumn("target", target).withColumn("balanced_n", F.greatest("n", "target"))


def balanced_resample(df: DataFrame, stratum: str, rid: str, stage: Stage, share: float = 0.30, seed: int = 42) -> DataFrame:
    """(stratum, draw_id, rid): strata below the target are replaced by as many draws with replacement, others stay."""
    targets = stage.put(balance_targets(df, stratum, share))
    small = targets.where("n < target")
    rows = stage.put(df.select(stratum, rid).join(targets.select(stratum, "n", "target"), stratum))
    kept = numbered(rows.where("n >= target").select(stratum, rid), [rid], stage, group=stratum, name="draw_id").select(stratum, "draw_id", rid)
    pool = numbered(rows.where("n < target").select(stratum, rid), [rid], stage, group=stratum, name="src")
    # draws come in chunks, so that no task makes all of a stratum's
    chunks = small.select(stratum, "n", "target", F.explode(F.sequence(F.lit(0), F.floor((F.col("target") - 1) / CHUNK))).alias("c")).repartition(stratum, "c")
    draws = chunks.select(stratum, "n", F.explode(F.sequence(F.col("c") * CHUNK, F.least((F.col("c") + 1) * CHUNK, F.col("target")) - 1)).alias("draw_id"))
    draws = draws.withColumn("src", md5_int(F.lit(str(seed)), F.col(stratum), F.col("draw_id")) % F.col("n"))
    return kept.unionByName(draws.join(pool, [stratum, "src"]).select(stratum, "draw_id", rid))
