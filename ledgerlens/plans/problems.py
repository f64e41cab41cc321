"""Queries of the general data problems (skewed keys, packed fields) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.packed import explode_packed
from ledgerlens.operators.skew import compress_values, key_profile, top_record
from ledgerlens.sources.tables import Stage, read_table

BROADCAST_BYTES, ID_BYTES = 32 << 20, 128  # ids up to so many bytes are broadcast
PACKED_FIELDS = ["input_addresses", "output_addresses", "input_script_types", "output_script_types"]


def _compressed(spark: SparkSession, d: str) -> DataFrame:
    flags = compress_values(read_table(spark, d, "dataset"), F.col("is_peer_to_peer"), F.col("fee"), F.col("txid"))
    profiles = compress_values(read_table(spark, d, "profile_statistics"), F.col("tx_profile"), F.col("mean_anomaly_score"), F.col("stat_id"))
    return flags.withColumn("field_name", F.lit("is_peer_to_peer")).unionByName(profiles.withColumn("field_name", F.lit("tx_profile")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """For each value of is_peer_to_peer and tx_profile the record with the largest measure."""
    parts = []
    for name in ("is_peer_to_peer", "tx_profile"):
        own = _compressed(spark, d).where(F.col("field_name") == name)
        parts.append(top_record(own).select(F.lit(name).alias("field_name"), "key_value", "record_key"))
    return parts[0].unionByName(parts[1])


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct values, mode and percentiles of the measure of each key."""
    stage = Stage(spark)
    parts = []
    for name in ("is_peer_to_peer", "tx_profile"):
        own = _compressed(spark, d).where(F.col("field_name") == name)
        parts.append(key_profile(own, stage, [50, 90]).withColumn("field_name", F.lit(name)))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of the packed fields of the audited transactions."""
    asked = read_table(spark, d, "audit_txids").select("txid").distinct()
    if asked.count() * ID_BYTES <= BROADCAST_BYTES:  # else both sides are shuffled
        asked = F.broadcast(asked)
    rows = read_table(spark, d, "dataset").select("txid", *PACKED_FIELDS).join(asked, "txid", "left_semi")
    return explode_packed(rows, ["txid"], PACKED_FIELDS).distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Values and largest position of each packed field, over all rows."""
    items = explode_packed(read_table(spark, d, "dataset"), [], PACKED_FIELDS)
    return items.groupBy("field_name").agg(F.count("*").alias("n_items"), F.max("pos").alias("max_pos"))


_P3_ROWS = """
    SELECT 'is_peer_to_peer' AS field_name, coalesce(CAST(is_peer_to_peer AS VARCHAR), '(null)') AS key_value, fee AS measure, txid AS rec
    FROM dataset WHERE fee IS NOT NULL AND NOT isnan(fee)
    UNION ALL
    SELECT 'tx_profile', coalesce(tx_profile, '(null)'), mean_anomaly_score, CAST(stat_id AS VARCHAR)
    FROM profile_statistics WHERE mean_anomaly_score IS NOT NULL AND NOT isnan(mean_anomaly_score)"""

_TOKENS = r"""regexp_extract_all(CASE WHEN regexp_matches(t, '(?s)^(\[.*\]|\{.*\}|\(.*\))$') THEN t[2:-2] ELSE t END,
        '''(?:[^'']|'''')*''|"(?:[^"]|"")*"|[^;,|/\s]+')"""


def _p5_items(rows: str, keys: str) -> str:
    return rf"""
    SELECT {keys}field_name, CAST(pos AS INTEGER) AS pos, item FROM (
        SELECT {keys}field_name, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM (
            SELECT {keys}field_name, list_filter(list_transform(tokens, lambda x: trim(CASE
                WHEN x[1] = '''' THEN replace(x[2:-2], '''''', '''')
                WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END)), lambda x: x <> '') AS items
            FROM (SELECT {keys}field_name, {_TOKENS} AS tokens FROM (
                SELECT {keys}field_name, regexp_replace(packed, '^\s+|\s+$', '', 'g') AS t FROM (
                    UNPIVOT ({rows}) ON {", ".join(PACKED_FIELDS)} INTO NAME field_name VALUE packed)))))"""


SQL = {
    "p3_found": f"""
    SELECT field_name, key_value, rec AS record_key FROM ({_P3_ROWS})
    QUALIFY row_number() OVER (PARTITION BY field_name, key_value ORDER BY measure DESC, rec) = 1""",
    "p3_profile": f"""
    WITH v AS (SELECT field_name, key_value, measure, count(*) AS n FROM ({_P3_ROWS}) GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY field_name, key_value ORDER BY measure) AS cum, sum(n) OVER (PARTITION BY field_name, key_value) AS total,
        row_number() OVER (PARTITION BY field_name, key_value ORDER BY n DESC, measure) AS rn FROM v)
    SELECT field_name, key_value, CAST(max(total) AS BIGINT) AS n_rows, count(*) AS n_distinct, max(measure) FILTER (rn = 1) AS mode_value,
        min(measure) FILTER (cum * 100 >= total * 50) AS p50, min(measure) FILTER (cum * 100 >= total * 90) AS p90
    FROM c GROUP BY field_name, key_value""",
    "p5_found": "SELECT DISTINCT * FROM (" + _p5_items(f"SELECT txid, {', '.join(PACKED_FIELDS)} FROM dataset WHERE txid IN (SELECT txid FROM audit_txids)", "txid, ") + ")",
    "p5_counts": "SELECT field_name, count(*) AS n_items, max(pos) AS max_pos FROM (" + _p5_items(f"SELECT {', '.join(PACKED_FIELDS)} FROM dataset", "") + ") GROUP BY field_name",
}

QUERIES = {"p3_found": p3_found, "p3_profile": p3_profile, "p5_found": p5_found, "p5_counts": p5_counts}
