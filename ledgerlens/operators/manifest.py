"""Column roles and data quality, in one pass over the table each."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.columns import finite
from ledgerlens.operators.skew import column_quantiles

#: Names and prefixes that tell a column's role.
FLAG_PREFIXES = ("is_", "has_", "rbf_")
ARTIFACT_NAMES = ("sample_size", "batch_id", "shard_id", "row_id", "partition", "index", "__index_level_0__")
IDENTIFIER_NAMES = ("txid", "input_addresses", "output_addresses", "input_script_types", "output_script_types", "op_return_data")
TEMPORAL_NAMES = ("block_height", "block_hour", "day_of_week", "week_of_year", "block_month", "block_year", "tx_version", "locktime", "block_time", "ingested_at", "date", "year_month", "month_year")
NEAR_CONSTANT = 1e-6


@dataclass(frozen=True)
class Manifest:
    """Which column plays which role."""

    features: tuple[str, ...]
    dropped: tuple[str, ...]
    all_zero: tuple[str, ...]
    near_constant: tuple[str, ...]
    artifacts: tuple[str, ...]
    identifiers: tuple[str, ...]
    temporal: tuple[str, ...]
    flags: tuple[str, ...]
    total_rows: int

    def as_dict(self) -> dict:
        return asdict(self)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def flag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(FLAG_PREFIXES)]


def unpivot(row: DataFrame, columns: list[str], fields: dict[str, str], name: str = "column_name") -> DataFrame:
    """One row per column from a one-row frame of aggregates named ``{field}__{column}``."""
    structs = [F.struct(F.lit(c).alias(name), *[F.col(f"`{f}__{c}`").cast(t).alias(f) for f, t in fields.items()]) for c in columns]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def flag_prevalence(df: DataFrame) -> DataFrame:
    """(column_name, pct_true, status)."""
    flags = flag_columns(df)
    row = df.agg(*[F.round(F.avg(F.col(c).cast("double")) * 100, 4).alias(f"pct_true__{c}") for c in flags])
    out = unpivot(row, flags, {"pct_true": "double"})
    return out.withColumn("status", F.when(F.col("pct_true") == 0, "ALL ZERO").when(F.col("pct_true") > 90, ">90% TRUE").otherwise("OK"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, null_count)."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_count__{c}") for c in df.columns])
    return unpivot(row, df.columns, {"null_count": "bigint"})


def describe(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles."""
    stats = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min_value": F.min, "max_value": F.max}
    row = df.agg(*[(f(F.col(c)) if s == "n" else F.round(f(F.col(c)), digits)).alias(f"{s}__{c}") for c in columns for s, f in stats.items()])
    moments = unpivot(row, columns, {s: "bigint" if s == "n" else "double" for s in stats})
    q = column_quantiles(df, columns, [0.25, 0.5, 0.75]).select(F.col("key_value").alias("column_name"), *[F.round(F.col("q")[i], digits).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])
    return moments.join(q, "column_name", "left")


def skewness_top(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """(column_name, skewness): bias-corrected, the ``top`` largest in absolute value; ties by name."""

    def corrected(c: str):
        n = F.count(c).cast("double")
        return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))

    row = df.agg(*[F.round(corrected(c), 4).alias(f"skewness__{c}") for c in columns])
    return unpivot(row, columns, {"skewness": "double"}).orderBy(F.abs("skewness").desc_nulls_last(), "column_name").limit(top)


def column_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, min_value, max_value, all_zero, near_constant)."""
    num = {c: finite(F.col(c).cast("int") if isinstance(df.schema[c].dataType, T.BooleanType) else c) for c in columns}
    row = df.agg(*[f(num[c]).alias(f"{s}__{c}") for c in columns for s, f in (("min_value", F.min), ("max_value", F.max), ("std", F.stddev_samp))])
    out = unpivot(row, columns, {"min_value": "double", "max_value": "double", "std": "double"})
    zero = F.coalesce((F.col("min_value") == 0) & (F.col("max_value") == 0), F.lit(False))
    flag = F.lit(False)
    for p in FLAG_PREFIXES:
        flag = flag | F.col("column_name").startswith(p)
    return out.withColumn("all_zero", zero).withColumn("near_constant", F.coalesce(~zero & ~flag & (F.col("std") < NEAR_CONSTANT), F.lit(False))).drop("std")


def build_manifest(df: DataFrame) -> Manifest:
    """Roles from names and types, and one aggregation for the values."""
    numbers = [f.name for f in df.schema if is_number(f.dataType)]
    quality = column_quality(df, numbers).collect() if numbers else []  # a row per column
    zero = sorted(r.column_name for r in quality if r.all_zero)
    near = sorted(r.column_name for r in quality if r.near_constant)
    own = lambda names: tuple(sorted(c for c in df.columns if c in names))
    artifacts, identifiers, temporal = own(ARTIFACT_NAMES), own(IDENTIFIER_NAMES), own(TEMPORAL_NAMES)
    dropped = {*zero, *near, *artifacts, *identifiers, *temporal}
    features = tuple(c for c in numbers if c not in dropped)
    return Manifest(features, tuple(sorted(dropped)), tuple(zero), tuple(near), artifacts, identifiers, temporal, tuple(flag_columns(df)), df.count())
