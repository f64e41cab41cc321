"""Order-preserving row numbers without a window over a whole table or a whole group.

Rows are range-partitioned and staged with their partition number; the counts per partition give
the offsets, and only the numbering inside a partition is a window. A group that holds most rows
is spread over as many range partitions as it fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.sources.tables import Stage


def numbered(df: DataFrame, order: list[str], stage: Stage, group: str | None = None, name: str = "rank") -> DataFrame:
    """Adds ``name`` (bigint from 0): the place of a row in the order of ``order``, within ``group`` if one is given.

    ``order`` must be total over the rows for a result that doesn't depend on the run; rows that tie in all of
    it get consecutive places in any order. Nulls come first.
    """
    by = ([group] if group else []) + order
    ranged = stage.put(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    keys = [group] if group else []
    sums = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = ranged.withColumn("_at", F.row_number().over(W.partitionBy("_part", *keys).orderBy(*order)))
    match = F.col("_part") == F.col("_p")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(offsets, match).withColumn(name, F.col("_at") + F.col("_off") - 1).drop("_part", "_p", "_at", "_off", *[f"_k_{k}" for k in keys])
