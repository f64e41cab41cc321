"""The tables behind reports and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.functions.columns import finite
from ledgerlens.operators.skew import compress_values, interpolated, quantile_row
from ledgerlens.sources.tables import Stage


MANY = 100_000  # groups whose numbers are broadcast


def anomaly_flag(df: DataFrame, score: str, share: float = 0.95) -> DataFrame:
    """Adds ``threshold`` and ``flag``: scores strictly above the exact quantile; null and NaN scores aren't flagged."""
    limit = quantile_row(df.select(finite(score).alias("s")), ["s"], [share]).select(F.col("s")[0].alias("threshold"))
    return df.join(F.broadcast(limit), how="cross").withColumn("flag", F.coalesce((finite(score) > F.col("threshold")).cast("int"), F.lit(0)))


def profile_statistics(df: DataFrame, profile: str, means: dict[str, Column], anomaly: str, score: str) -> DataFrame:
    """(profile, tx_count, pct, anomaly_rate, mean_anomaly_score, mean_*), most frequent first."""
    out = df.groupBy(profile).agg(F.count("*").alias("tx_count"), F.round(F.avg(F.col(anomaly).cast("double")), 6).alias("anomaly_rate"), F.round(F.avg(finite(score)), 6).alias("mean_anomaly_score"), *[F.round(F.avg(c), 6).alias(f"mean_{n}") for n, c in means.items()])
    total = F.sum("tx_count").over(W.partitionBy(F.lit(0)))  # a row per profile
    return out.withColumn("pct", F.round(F.col("tx_count") * F.lit(100.0) / total, 4)).orderBy(F.desc("tx_count"), profile)


def top_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    """The ``n`` most frequent groups with count and rank; ties by name. Nulls aren't a group."""
    top = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(n)
    return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), group)))


def with_other(df: DataFrame, group: str, n: int, other: str = "Other") -> DataFrame:
    """(group, n) of the most frequent groups, and the rest together."""
    top = top_groups(df, group, n).select(F.col(group).alias("_g"), F.lit(True).alias("_top"))
    return df.join(F.broadcast(top), F.col(group) == F.col("_g"), "left").groupBy(F.when(F.col("_top"), F.col(group)).otherwise(other).alias(group)).agg(F.count("*").alias("n"))


def group_means(df: DataFrame, group: str, features: dict[str, Column], digits: int | None = 6) -> DataFrame:
    mean = lambda c: F.avg(c) if digits is None else F.round(F.avg(c), digits)
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(*[mean(c).alias(n) for n, c in features.items()])


def row_minmax(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Each row's values scaled to 0..1 across its columns; a row of equal values becomes 0."""
    lo, hi = F.least(*columns), F.greatest(*columns)
    return df.select(*[c for c in df.columns if c not in columns], *[F.round(F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.when(F.col(c).isNotNull(), 0.0)), digits).alias(c) for c in columns])


def radar(means: DataFrame, group: str, columns: list[str], limit: float = 2.5, digits: int = 6) -> DataFrame:
    """Group means made comparable: log1p of columns whose largest mean is above 1, z-scores over groups, clipped and mapped to
    0..1; with ``spread``, the range over the columns. Groups with a null mean are dropped."""
    one = W.partitionBy(F.lit(0))
    out = means.where(" and ".join(f"`{c}` is not null" for c in columns))
    out = out.withColumns({c: F.when(F.max(c).over(one) > 1, F.log1p(F.greatest(F.col(c), F.lit(0.0)))).otherwise(F.col(c)) for c in columns})
    z = lambda c: (F.col(c) - F.avg(c).over(one)) / F.when(F.stddev_pop(c).over(one) == 0, 1.0).otherwise(F.stddev_pop(c).over(one))
    out = out.withColumns({c: (F.least(F.greatest(z(c), F.lit(-limit)), F.lit(limit)) + limit) / (2 * limit) for c in columns})
    return out.select(group, *[F.round(c, digits).alias(c) for c in columns], F.round(F.greatest(*columns) - F.least(*columns), digits).alias("spread"))


def density(df: DataFrame, value: str, group: str, bins: int, digits: int = 10) -> DataFrame:
    """(group, bin, n, density): equal-width bins over all groups, normalised within each; the last bin is closed."""
    v = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    edges = v.agg(F.min("v").alias("lo"), ((F.max("v") - F.min("v")) / bins).alias("width"))
    at = F.when(F.col("width") > 0, F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.lit(bins - 1))).otherwise(0).cast("int")
    t = v.join(F.broadcast(edges), how="cross").groupBy(group, at.alias("bin")).agg(F.count("*").alias("n"), F.first("width").alias("width"))
    return t.select(group, "bin", "n", F.round(F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy(group)) * F.col("width")), digits).alias("density"))


def box_stats(df: DataFrame, value: str, group: str, digits: int = 6) -> DataFrame:
    """(group, n, q1, median, q3, low_whisker, high_whisker): whiskers are the outermost values within 1.5 ranges of the box."""
    v = df.where(F.col(group).isNotNull()).select(group, finite(value).alias("v")).where("v is not null")
    stage = Stage(df.sparkSession)
    q = interpolated(compress_values(v, F.col(group), F.col("v")), stage, [0.25, 0.5, 0.75])
    q = q.select(F.col("key_value").alias(group), F.col("n_rows").alias("n"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    q = stage.put(q)
    boxes = F.broadcast(q) if q.count() <= MANY else q  # a few numbers a group
    inside = v.join(boxes, group).where(F.col("v").between(F.col("q1") - reach, F.col("q3") + reach))
    w = inside.groupBy(group).agg(F.min("v").alias("low_whisker"), F.max("v").alias("high_whisker"))
    return q.join(w, group).select(group, "n", *[F.round(c, digits).alias(c) for c in ("q1", "median", "q3", "low_whisker", "high_whisker")])


def write_lines(lines: DataFrame, path: str) -> None:
    """A report of (at, line), counted from 0, as one text file; each line has its number in front. Reports are small."""
    lines.select(F.concat(F.format_string("%06d", "at"), F.lit("\t"), "line").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a written report, counted from 1."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select((parts[0].cast("int") + 1).alias("line_no"), parts[1].alias("line"))
