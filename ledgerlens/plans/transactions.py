"""The working frame of transactions, as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.columns import finite
from ledgerlens.operators.rules import RULES, UNKNOWN
from ledgerlens.sources.tables import read_table

AMOUNTS = ["fee", "total_input_value", "total_output_value", "avg_input_value", "avg_output_value", "fee_rate_sat_per_byte", "fee_rate_sat_per_vbyte", "value_difference", "value_concentration_ratio", "input_output_ratio"]
COUNTS = ["size_bytes", "vsize", "weight", "input_count", "output_count"]
FLAGS = ["has_coinbase", "is_coinjoin_like", "is_batch_payment", "is_consolidation", "is_distribution", "is_peer_to_peer", "has_op_return", "rbf_enabled"]
STRATA = ["is_coinjoin_like", "is_batch_payment", "has_op_return"]


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered row: a row id, finite amounts, flags with null as false, and the stratum."""
    df = read_table(spark, d, "dataset")
    flag = {c: F.coalesce(F.col(c), F.lit(False)) for c in FLAGS}
    return df.select(
        F.md5(F.concat_ws("|", "txid", F.col("batch_id").cast("string"), F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))).alias("_rid"),
        "txid",
        "block_height",
        "block_year",
        "block_hour",
        *[finite(c).alias(c) for c in AMOUNTS],
        *COUNTS,
        *[flag[c].alias(c) for c in FLAGS],
        F.concat_ws("_", *[flag[c].cast("int").cast("string") for c in STRATA]).alias("stratum"),
    )


_CASES = " ".join(f"WHEN {f} THEN '{label}'" for f, label in RULES)
_CASES_BACK = " ".join(f"WHEN {f} THEN '{label}'" for f, label in RULES[::-1])
FIRST_SQL, LAST_SQL = f"CASE {_CASES} ELSE '{UNKNOWN}' END", f"CASE {_CASES_BACK} ELSE '{UNKNOWN}' END"
LOG_SQL = "ln(1 + greatest({0}, 0) + 1e-8)"

TXN = f"""txn AS (SELECT md5(concat_ws('|', txid, CAST(batch_id AS VARCHAR), strftime(ingested_at, '%Y-%m-%d %H:%M:%S.%f'))) AS _rid, txid, block_height, block_year, block_hour,
    {", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in AMOUNTS)}, {", ".join(COUNTS)},
    {", ".join(f"coalesce({c}, false) AS {c}" for c in FLAGS)},
    {" || '_' || ".join(f"CAST(CAST(coalesce({c}, false) AS INT) AS VARCHAR)" for c in STRATA)} AS stratum FROM dataset)"""


def log_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN {LOG_SQL.format(c)} END"


#: The same frame with log amounts.
LOGGED = f"{TXN}, logged AS (SELECT * REPLACE ({', '.join(f'{log_sql(c)} AS {c}' for c in AMOUNTS)}) FROM txn)"
