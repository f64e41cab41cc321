"""Per-key results where a few keys hold most rows: value-frequency compression.

Rows are grouped by key *and* value first, which spreads a hot key over as many groups as it has
values and combines repeats before the shuffle. Per-key results come from the weighted values:
counts, extremes and modes by partial aggregation, percentiles by a range-partitioned running
weight. No task ever holds all rows, or all values, of a key.

Nulls: a null key is a key of its own (``null_label``); null and NaN values carry no weight and are
dropped, so a key without any value has no row. An empty table gives an empty result. Ties of a
mode or an extreme go to the smallest value, then the smallest record.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.sources.tables import Stage


def compress_values(df: DataFrame, key: Column, value: Column, record: Column | None = None, null_label: str = "(null)") -> DataFrame:
    """(key_value string, measure double, n, record string): one row per distinct value of a key, with its
    number of rows and the smallest record key that has it."""
    measure = value.cast("double")
    rows = df.select(
        F.coalesce(key.cast("string"), F.lit(null_label)).alias("key_value"),
        F.when(~F.isnan(measure), measure + F.lit(0.0)).alias("measure"),  # -0.0 and 0.0 are one value
        (record.cast("string") if record is not None else F.lit(None).cast("string")).alias("record"),
    ).where(F.col("measure").isNotNull())
    return rows.groupBy("key_value", "measure").agg(F.count("*").alias("n"), F.min("record").alias("record"))


def top_record(compressed: DataFrame) -> DataFrame:
    """(key_value, record_key): the record of each key's largest value."""
    best = compressed.groupBy("key_value").agg(F.max_by("record", "measure").alias("record_key"))
    return best.where(F.col("record_key").isNotNull())


def running_weights(compressed: DataFrame, stage: Stage) -> DataFrame:
    """(key_value, measure, n, cum, total): the weight of a key's values up to each of them, and of all. Values are
    range-partitioned, so a key with most of them is spread over tasks."""
    ranged = stage.put(
        compressed.select("key_value", "measure", "n").repartitionByRange("key_value", "measure").withColumn("part", F.spark_partition_id())
    )
    sums = ranged.groupBy("key_value", "part").agg(F.sum("n").alias("part_n"))  # at most partitions x keys rows
    before = W.partitionBy("key_value").orderBy("part")
    sums = sums.withColumn("offset", F.sum("part_n").over(before) - F.col("part_n")).withColumn("total", F.sum("part_n").over(W.partitionBy("key_value")))
    running = W.partitionBy("part", "key_value").orderBy("measure")
    # the weights within a part, then those of the parts before it
    placed = ranged.withColumn("cum_in", F.sum("n").over(running)).join(sums, ["key_value", "part"])
    return placed.select("key_value", "measure", "n", (F.col("cum_in") + F.col("offset")).alias("cum"), "total")


def key_profile(compressed: DataFrame, stage: Stage, percents: list[int]) -> DataFrame:
    """(key_value, n_rows, n_distinct, mode_value, p<k>...): exact, percentiles as the smallest value whose
    share of rows at or below it reaches k %."""
    return running_weights(compressed, stage).groupBy("key_value").agg(
        F.max("total").alias("n_rows"),
        F.count("*").alias("n_distinct"),
        F.max_by("measure", F.struct("n", -F.col("measure"))).alias("mode_value"),
        *[F.min(F.when(F.col("cum") * 100 >= F.col("total") * p, F.col("measure"))).alias(f"p{p}") for p in percents],
    )


def interpolated(compressed: DataFrame, stage: Stage, shares: list[float]) -> DataFrame:
    """(key_value, n_rows, q array<double>): exact quantiles with linear interpolation between ranks. Unlike an aggregate that
    collects a key's values, no task holds more than its range of them."""
    w = running_weights(compressed, stage)
    ends = []
    for p in shares:
        h = (F.col("total") - 1) * F.lit(float(p))
        ends += [F.min(F.when(F.col("cum") - 1 >= f(h), F.col("measure"))) for f in (F.floor, F.ceil)]
    out = w.groupBy("key_value").agg(F.max("total").alias("n_rows"), *[e.alias(f"e{i}") for i, e in enumerate(ends)])
    h = lambda p: (F.col("n_rows") - 1) * F.lit(float(p))
    return out.select("key_value", "n_rows", F.array(*[F.col(f"e{2 * i}") + (F.col(f"e{2 * i + 1}") - F.col(f"e{2 * i}")) * (h(p) - F.floor(h(p))) for i, p in enumerate(shares)]).alias("q"))


def column_quantiles(df: DataFrame, columns: list[str], shares: list[float], stage: Stage | None = None, accuracy: int = 10_000) -> DataFrame:
    """(key_value, n_rows, q): the same for whole columns; the key is the column's name. Columns without values have no row.

    A first pass gives bounds of every quantile (Spark's sketch errs by at most one in ``accuracy`` of the rows), a second counts the values
    below them, and only the values between them, a few in ``accuracy``, are grouped and sorted. What reaches the driver is some numbers a column.
    """
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + F.lit(0.0)) for c in columns}
    around = [min(1.0, max(0.0, p + s * 2 / accuracy)) for p in shares for s in (-1, 1)]
    found = df.agg(*[f.alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count(x[c])), ("b", F.percentile_approx(x[c], around, accuracy)))]).first()
    ranges = {}  # (column, share): the bounds, which are open at the ends and for few values
    for i, c in enumerate(columns):
        n, b = found[f"n{i}"], found[f"b{i}"]
        for j, p in enumerate(shares if n else []):
            ranges[c, j] = (b[2 * j] if n > 2 * accuracy and p > 4 / accuracy else float("-inf"), b[2 * j + 1] if n > 2 * accuracy and p < 1 - 4 / accuracy else float("inf"))
    sizes = {c: found[f"n{i}"] for i, c in enumerate(columns)}
    kind = "key_value string, n_rows bigint, q array<double>"
    if not ranges:
        return df.sparkSession.createDataFrame([], kind)
    below = df.agg(*[F.count_if(x[c] < F.lit(lo)).alias(f"k{k}") for k, ((c, _), (lo, _)) in enumerate(ranges.items())]).first()
    inside = F.array_compact(F.array(*[F.when((x[c] >= F.lit(lo)) & (x[c] <= F.lit(hi)), F.struct(F.lit(str(k)).alias("key"), x[c].alias("v"))) for k, ((c, _), (lo, hi)) in enumerate(ranges.items())]))
    near = df.select(F.explode(inside).alias("r"))
    w = running_weights(compress_values(near, F.col("r.key"), F.col("r.v")), stage or Stage(df.sparkSession))
    at = {str(k): (below[f"k{k}"], (sizes[c] - 1) * float(shares[j])) for k, (c, j) in enumerate(ranges)}
    lookup = F.create_map(*[F.lit(v) for k, (base, h) in at.items() for v in (k, h - base)])  # a rank within the values between the bounds
    rank = lookup[F.col("key_value")]
    ends = w.groupBy("key_value").agg(*[F.min(F.when(F.col("cum") - 1 >= f(rank), F.col("measure"))).alias(n) for n, f in (("lo", F.floor), ("hi", F.ceil))]).collect()
    ends = {r.key_value: (r.lo, r.hi) for r in ends}
    out: dict[str, list[float]] = {}
    for k, (c, _) in enumerate(ranges):
        (lo, hi), h = ends[str(k)], at[str(k)][1]
        out.setdefault(c, []).append(lo + (hi - lo) * (h - math.floor(h)))
    return df.sparkSession.createDataFrame([(c, sizes[c], q) for c, q in out.items()], kind)


def quantile_row(df: DataFrame, columns: list[str], shares: list[float], stage: Stage | None = None) -> DataFrame:
    """One row with an array column per column; null for a column without values."""
    q = column_quantiles(df, columns, shares, stage)
    return q.agg(*[F.max(F.when(F.col("key_value") == c, F.col("q"))).alias(c) for c in columns])
