"""Samples that match target shares of categories: systematic unequal-probability sampling.

Units are put in random order (a seeded hash) within the sorted strata. A unit's inclusion probability is its
stratum's quota over the stratum's size; the running sum of the probabilities, with offsets carried across
partitions, is cut at the integers from one random start, and the units at the crossings are taken. Quotas
are whole, so each stratum gives exactly its quota. Floors are repaired by raising the probabilities of
the strata that fall below their minimum. A stratum that holds fewer units than asked gives all it has and
is reported short.

Defined cases: units with a null stratum take no part; a unit counts once however often it is repeated; targets
with a null plan or stratum are ignored, null shares and minima count as 0; targets that name no existing
stratum are short by all they ask; an empty table leaves every positive target short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.functions.columns import md5_int
from ledgerlens.operators.ranks import numbered
from ledgerlens.sources.tables import Stage


def stratum_of(flags: list[str]) -> Column:
    """``a_b_c`` with 0/1; null if any flag is null."""
    ok = F.lit(True)
    for f in flags:
        ok = ok & F.col(f).isNotNull()
    return F.when(ok, F.concat_ws("_", *[F.col(f).cast("int").cast("string") for f in flags]))


def required_rows() -> Column:
    """The larger of min_rows and target_share x sample_rows, whole: floating error is rounded off, a true fraction rounded up."""
    share = F.coalesce(F.when(~F.isnan("target_share"), F.col("target_share")), F.lit(0.0)) * F.coalesce(F.col("sample_rows"), F.lit(0))
    whole = F.when(F.abs(share - F.round(share)) < 1e-6, F.round(share)).otherwise(F.ceil(share)).cast("long")
    return F.greatest(F.coalesce(F.col("min_rows"), F.lit(0)), whole)


class StratifiedDraw:
    """Draws the samples of all plans of ``targets`` (plan_id, stratum, target_share, min_rows, sample_rows) from ``units``
    (unit, stratum)."""

    def __init__(self, units: DataFrame, targets: DataFrame, stage: Stage, seed: int = 42):
        unique = units.where(F.col("stratum").isNotNull() & F.col("unit").isNotNull()).groupBy("unit").agg(F.min("stratum").alias("stratum"))
        placed = numbered(unique.withColumn("_h", md5_int(F.lit(str(seed)), F.col("unit"), digits=15)), ["_h", "unit"], stage, group="stratum")
        self.placed = stage.put(placed.select("unit", "stratum", "rank"))
        sizes = self.placed.groupBy("stratum").agg(F.count("*").alias("available"))
        asked = targets.where(F.col("plan_id").isNotNull() & F.col("stratum").isNotNull()).groupBy("plan_id", "stratum").agg(F.max(required_rows()).alias("required"))
        quota = asked.join(sizes, "stratum", "left").fillna(0, ["available"]).withColumn("quota", F.least("required", "available"))
        # sums of earlier strata; whole, as quotas are. One random start a plan.
        before = W.partitionBy("plan_id").orderBy("stratum").rowsBetween(W.unboundedPreceding, -1)
        self.plan = stage.put(
            quota.withColumn("before", F.coalesce(F.sum("quota").over(before), F.lit(0))).withColumn("start", md5_int(F.lit(str(seed)), F.col("plan_id").cast("string"), digits=5) / F.lit(float(16**5)))
        )

    def sample(self) -> DataFrame:
        """(plan_id, stratum, unit)."""
        terms = self.plan.where("quota > 0").select("plan_id", "stratum", "quota", "available", "before", "start")
        # Running sums in whole numbers: rank * quota div available, so that no rounding can move a crossing.
        whole = lambda r: F.expr(f"before + ({r} * quota) div available")
        part = lambda r: F.expr(f"(({r} * quota) % available) / available")
        at = lambda r: whole(r) + F.floor(part(r) + F.col("start"))
        return self.placed.join(terms, "stratum").where(at("(rank + 1)") > at("rank")).select("plan_id", "stratum", "unit")

    def report(self) -> DataFrame:
        """(plan_id, stratum, required, available, drawn, short)."""
        drawn = self.sample().groupBy("plan_id", "stratum").agg(F.count("*").alias("drawn"))
        out = self.plan.join(drawn, ["plan_id", "stratum"], "left").fillna(0, ["drawn"])
        return out.select("plan_id", "stratum", "required", "available", "drawn", (F.col("required") - F.col("drawn")).alias("short"))
