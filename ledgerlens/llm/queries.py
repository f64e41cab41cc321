"""Queries of the operators of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, clusters, components, heavy, leaks, minhash, quality, quantiles, sampling
from ledgerlens.operators.packed import explode_packed
from ledgerlens.sources.tables import Stage, read_table

PERCENTILE_FIELDS = ["fee", "fee_rate_sat_per_vbyte", "total_input_value"]
STRATUM_FLAGS = ["is_coinjoin_like", "is_batch_payment", "has_op_return"]
ADDRESS_FIELDS = ["input_addresses", "output_addresses"]
HEAVY_SHARE = 0.006


def _clusters(spark: SparkSession, d: str) -> clusters.Clusters:
    fee, out, ratio = F.col("fee"), F.col("total_output_value"), F.col("value_concentration_ratio")
    valid = (fee > 0) & ~F.isnan(fee) & (out > 0) & ~F.isnan(out) & ~F.isnan(ratio) & ratio.between(0, 1)
    points = read_table(spark, d, "dataset").where(valid).select(F.col("txid").alias("id"), F.log10(fee).alias("x"), F.log10(out).alias("y"), ratio.alias("z"))
    return clusters.Clusters(points, Stage(spark))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Probed pairs of different transactions that lie in one cluster."""
    c = _clusters(spark, d)
    member = c.stage.put(c.members(c.verified()).select("id", "cluster_id"))
    probes = read_table(spark, d, "probe_pairs").select(F.least("txid_a", "txid_b").alias("txid_a"), F.greatest("txid_a", "txid_b").alias("txid_b"), (F.col("txid_a").isNotNull() & F.col("txid_b").isNotNull()).alias("ok")).where("ok and txid_a <> txid_b").select("txid_a", "txid_b").distinct()
    a, b = member.select(F.col("id").alias("txid_a"), F.col("cluster_id").alias("ca")), member.select(F.col("id").alias("txid_b"), F.col("cluster_id").alias("cb"))
    return probes.join(a, "txid_a").join(b, "txid_b").where("ca = cb").select("txid_a", "txid_b")


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size, diameter and most typical transactions of every cluster."""
    c = _clusters(spark, d)
    return clusters.typical(c.stage.put(c.members(c.verified())))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Reported percentiles that are wrong by more than 4 points of rank."""
    return quantiles.wrong_claims(read_table(spark, d, "dataset"), read_table(spark, d, "percentile_reports"), "shard_id", PERCENTILE_FIELDS, Stage(spark))


def p2_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """How many claims the sketches call right and wrong, and how many they leave open to be counted."""
    judged = quantiles.judge_claims(read_table(spark, d, "dataset"), read_table(spark, d, "percentile_reports"), "shard_id", PERCENTILE_FIELDS, Stage(spark))
    return judged.groupBy("verdict").agg(F.count("*").alias("claims"))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Medians and other percentiles of each shard and field."""
    parts = quantiles.build_sketches(read_table(spark, d, "dataset"), "shard_id", PERCENTILE_FIELDS)
    return quantiles.percentiles(quantiles.merge_sketches(parts, "shard_id"), "shard_id", [0.05, 0.25, 0.5, 0.75, 0.95])


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups by all links at one Jaccard similarity, with their sizes and medoids: one threshold, which gives a part of the clusters of ``p1_found`` only."""
    points = _clusters(spark, d).points
    groups = minhash.Groups(points, list(clusters.AXES), Stage(spark), least=0.25)
    return groups.members().groupBy("group").agg(F.count("*").alias("size"), F.first("medoid").alias("medoid"))


def _draw(spark: SparkSession, d: str) -> sampling.StratifiedDraw:
    units = read_table(spark, d, "dataset").select(F.col("txid").alias("unit"), sampling.stratum_of(STRATUM_FLAGS).alias("stratum"))
    return sampling.StratifiedDraw(units, read_table(spark, d, "sample_targets"), Stage(spark))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that could not be met."""
    return _draw(spark, d).report().where("short > 0").select("plan_id", "stratum")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample of every plan."""
    return _draw(spark, d).sample().withColumnRenamed("unit", "txid")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Required, available and drawn rows of every target."""
    return _draw(spark, d).report()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every matched record."""
    return components.link_groups(read_table(spark, d, "match_pairs"), "left_key", "right_key", Stage(spark))


def _heavy(spark: SparkSession, d: str) -> DataFrame:
    items = explode_packed(read_table(spark, d, "dataset"), [], ADDRESS_FIELDS)
    return heavy.heavy_items(items, ADDRESS_FIELDS, HEAVY_SHARE, Stage(spark))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that make up at least 0.6 % of the values of a field."""
    return _heavy(spark, d).select("field_name", F.col("item").alias("address"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """The heavy addresses with their exact counts, and the values of the field."""
    return _heavy(spark, d).select("field_name", F.col("item").alias("address"), "n", "total")


def p7_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The heavy addresses with the sketch's counts, which are never below the exact ones."""
    return _heavy(spark, d).select("field_name", F.col("item").alias("address"), "est", (F.col("est") >= F.col("n")).alias("covers"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_column(read_table(spark, d, "documents"), "doc_id", "text", bpe.read_vocabulary(spark))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether decoding the ids of a document gives the text again."""
    return bpe.roundtrip(read_table(spark, d, "documents"), "doc_id", "text", bpe.read_vocabulary(spark)).select("doc_id", "same")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return leaks.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    return quality.text_statistics(read_table(spark, d, "documents"), Stage(spark)).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and kind of every document; common words are the corpus's own."""
    docs = read_table(spark, d, "documents")
    return quality.text_statistics(docs, Stage(spark), common=quality.common_words(docs))


def p10_counts(spark: SparkSession, d: str) -> DataFrame:
    """Visible characters and lines of every document."""
    return quality.text_statistics(read_table(spark, d, "documents"), Stage(spark)).select("doc_id", "n_chars", "n_lines")


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p1_groups, p2_found, p2_verdicts, p2_percentiles, p4_found, p4_sample, p4_report, p6_found, p7_found, p7_counts, p7_estimates, p8_ids, p8_roundtrip, p9_found, p10_found, p10_statistics, p10_counts)}

_ITEMS = r"""
    SELECT field_name, unnest(list_filter(list_transform(tokens, lambda x: trim(CASE
            WHEN x[1] = '\'' THEN replace(x[2:-2], '\'\'', '\'')
            WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END)), lambda x: x <> '')) AS address
    FROM (SELECT field_name, regexp_extract_all(CASE WHEN regexp_matches(t, '(?s)^(\[.*\]|\{.*\}|\(.*\))$') THEN t[2:-2] ELSE t END,
            '\'(?:[^\']|\'\')*\'|"(?:[^"]|"")*"|[^;,|/\s]+') AS tokens
        FROM (SELECT field_name, regexp_replace(packed, '^\s+|\s+$', '', 'g') AS t
            FROM (UNPIVOT (SELECT input_addresses, output_addresses FROM dataset) ON input_addresses, output_addresses INTO NAME field_name VALUE packed)))""".replace("\\'", "''")

_STRATA = """
    SELECT a || '_' || b || '_' || c AS stratum, count(DISTINCT txid) AS available FROM (
        SELECT txid, CAST(CAST(is_coinjoin_like AS INT) AS VARCHAR) AS a, CAST(CAST(is_batch_payment AS INT) AS VARCHAR) AS b, CAST(CAST(has_op_return AS INT) AS VARCHAR) AS c FROM dataset)
    WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1"""

_REQUIRED = f"""
    SELECT plan_id, stratum, required, coalesce(available, 0) AS available FROM (
        SELECT plan_id, stratum, greatest(min_rows, CAST(round(target_share * sample_rows) AS BIGINT)) AS required FROM sample_targets)
    LEFT JOIN ({_STRATA}) USING (stratum)"""

SQL = {
    "p2_found": """
    WITH v AS (SELECT shard_id, field_name, value FROM (UNPIVOT (SELECT shard_id, fee, fee_rate_sat_per_vbyte, total_input_value FROM dataset)
        ON fee, fee_rate_sat_per_vbyte, total_input_value INTO NAME field_name VALUE value) WHERE NOT isnan(value) AND value >= 0),
    c AS (SELECT report_id, pct_rank, count(*) AS n, count(*) FILTER (value < claimed_value) AS below, count(*) FILTER (value <= claimed_value) AS upto
        FROM percentile_reports JOIN v USING (shard_id, field_name) GROUP BY ALL)
    SELECT report_id FROM c WHERE below * 100 > (pct_rank + 4) * n OR upto * 100 < (pct_rank - 4) * n""",
    "p4_found": f"SELECT plan_id, stratum FROM ({_REQUIRED}) WHERE required > available",
    "p4_report": f"SELECT plan_id, stratum, required, available, least(required, available) AS drawn, required - least(required, available) AS short FROM ({_REQUIRED})",
    "p4_sample": f"""
    WITH u AS (SELECT txid AS unit, min(stratum) AS stratum FROM (SELECT txid, CAST(CAST(is_coinjoin_like AS INT) AS VARCHAR) || '_' || CAST(CAST(is_batch_payment AS INT) AS VARCHAR) || '_' || CAST(CAST(has_op_return AS INT) AS VARCHAR) AS stratum FROM dataset) WHERE stratum IS NOT NULL AND txid IS NOT NULL GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY CAST('0x' || substr(md5('42|' || unit), 1, 15) AS BIGINT), unit) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n FROM u),
    q AS (SELECT plan_id, stratum, available, least(required, available) AS quota FROM (SELECT plan_id, stratum, available, max(required) AS required FROM ({_REQUIRED}) GROUP BY ALL)),
    p AS (SELECT *, CAST(coalesce(sum(quota) OVER (PARTITION BY plan_id ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST('0x' || substr(md5('42|' || plan_id), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS start FROM q)
    SELECT plan_id, stratum, unit AS txid FROM r JOIN p USING (stratum) WHERE quota > 0
        AND before + ((k + 1) * quota) // n + CAST(floor((((k + 1) * quota) % n) / n::DOUBLE + start) AS BIGINT) > before + (k * quota) // n + CAST(floor(((k * quota) % n) / n::DOUBLE + start) AS BIGINT)""",
    "p7_counts": f"""
    WITH i AS ({_ITEMS}), c AS (SELECT field_name, address, count(*) AS n FROM i GROUP BY field_name, address),
    s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY field_name) AS BIGINT) AS total FROM c)
    SELECT field_name, address, n, total FROM s WHERE n >= 0.006 * total""",
    "p8_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "p10_counts": r"""
    WITH t AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '[\r\n\x{0b}\x{0c}\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '[\s\x{0b}\x{85}\x{1c}-\x{1f}\p{Z}]', '', 'g')) AS lines FROM documents)
    SELECT doc_id, coalesce(CAST(list_sum(list_transform(lines, lambda x: length(x))) AS BIGINT), 0) AS n_chars, len(list_filter(lines, lambda x: x <> '')) AS n_lines FROM t""",
    "p6_found": r"""
    WITH RECURSIVE k AS (SELECT DISTINCT CASE WHEN regexp_matches(a, '^[0-9a-fA-F]{64}$') THEN lower(a) ELSE a END AS a, CASE WHEN regexp_matches(b, '^[0-9a-fA-F]{64}$') THEN lower(b) ELSE b END AS b
        FROM (SELECT regexp_replace(left_key, '^\s+|\s+$', '', 'g') AS a, regexp_replace(right_key, '^\s+|\s+$', '', 'g') AS b FROM match_pairs) WHERE a <> '' AND b <> ''),
    e AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
    reach(record_key, other) AS (SELECT a, a FROM e UNION SELECT reach.record_key, e.b FROM reach JOIN e ON reach.other = e.a)
    SELECT record_key, min(other) AS group_key FROM reach GROUP BY record_key""",
    "p7_found": f"""
    WITH i AS ({_ITEMS}), c AS (SELECT field_name, address, count(*) AS n FROM i GROUP BY field_name, address),
    s AS (SELECT *, sum(n) OVER (PARTITION BY field_name) AS total FROM c)
    SELECT field_name, address FROM s WHERE n >= 0.006 * total""",
    "p9_found": r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
    q AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_text IS NOT NULL),
    runs AS (SELECT item_id, least(len(w), 12) AS n, unnest(list_transform(range(greatest(1, len(w) - 11)), lambda s: array_to_string(w[s + 1 : s + 12], ' '))) AS run FROM q WHERE len(w) > 0),
    grams AS (SELECT doc_id, n, unnest(list_transform(range(len(w) - n + 1), lambda s: array_to_string(w[s + 1 : s + n], ' '))) AS run FROM w, (SELECT DISTINCT n FROM runs) WHERE len(w) >= n)
    SELECT DISTINCT doc_id, item_id FROM grams JOIN runs USING (n, run)""",
}
