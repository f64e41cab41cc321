"""Queries on the transaction and profile tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.columns import finite
from ledgerlens.operators import compare, manifest, metrics, report, resample, rules, scaling, zeta
from ledgerlens.plans.transactions import AMOUNTS, COUNTS, FIRST_SQL, FLAGS, LAST_SQL, LOGGED, TXN, transactions
from ledgerlens.sources.tables import Stage, read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _logged(spark: SparkSession, d: str) -> DataFrame:
    return scaling.log_transform(transactions(spark, d), AMOUNTS)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    df = transactions(spark, d)
    return df.withColumn("profile", rules.first_match(df.columns))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """The labelled working frame, with the family of its profile (without a number at the end)."""
    df = read_table(spark, d, "results_labeled")
    return df.withColumn("family", F.regexp_replace("tx_profile", r"_\d+$", ""))


RESULTS = r"""res AS (SELECT *, regexp_replace(tx_profile, '_\d+$', '') AS family FROM results_labeled)"""
LABELLED = f"{TXN}, lab AS (SELECT *, {FIRST_SQL} AS profile FROM txn)"


@query(_union(f"SELECT '{c}' AS column_name, p AS pct_true, CASE WHEN p = 0 THEN 'ALL ZERO' WHEN p > 90 THEN '>90% TRUE' ELSE 'OK' END AS status FROM (SELECT round(avg(CAST({c} AS DOUBLE)) * 100, 4) AS p FROM dataset)" for c in ["has_coinbase", "is_coinjoin_like", "is_batch_payment", "is_consolidation", "is_distribution", "is_peer_to_peer", "has_op_return", "rbf_enabled"]))
def flag_prevalence(spark, d):
    return manifest.flag_prevalence(read_table(spark, d, "dataset"))


_COLUMNS = "txid block_height block_time ingested_at block_year block_month block_hour day_of_week week_of_year tx_version locktime batch_id shard_id size_bytes vsize weight input_count output_count input_address_count output_address_count total_addresses input_script_count output_script_count address_reuse input_output_ratio total_input_value total_output_value fee avg_input_value avg_output_value fee_rate_sat_per_byte fee_rate_sat_per_vbyte value_difference value_concentration_ratio has_coinbase is_coinjoin_like is_batch_payment is_consolidation is_distribution is_peer_to_peer has_op_return rbf_enabled input_addresses output_addresses input_script_types output_script_types op_return_data".split()


@query(_union(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count FROM dataset" for c in _COLUMNS))
def null_counts(spark, d):
    return manifest.null_counts(read_table(spark, d, "dataset"))


@query(f"WITH {LOGGED} " + _union(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min_value, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max_value FROM logged" for c in AMOUNTS))
def numeric_describe(spark, d):
    return manifest.describe(_logged(spark, d), AMOUNTS)


@query(f"WITH {LOGGED} SELECT * FROM (" + _union(f"SELECT '{c}' AS column_name, round(skewness({c}), 4) AS skewness FROM logged" for c in AMOUNTS + COUNTS) + ") ORDER BY abs(skewness) DESC, column_name LIMIT 10")
def skewness_top(spark, d):
    return manifest.skewness_top(_logged(spark, d), AMOUNTS + COUNTS)


@query(
    f"WITH {TXN}, w AS (SELECT *, 0 AS all_zero_column, 7.0::DOUBLE AS constant_column FROM txn), s AS ("
    + _union(f"SELECT '{c}' AS column_name, CAST(min({x}) AS DOUBLE) AS min_value, CAST(max({x}) AS DOUBLE) AS max_value, stddev_samp({x}) AS sd FROM w" for c, x in [(c, c if c not in FLAGS else f"CAST({c} AS INT)") for c in AMOUNTS + COUNTS + FLAGS + ["all_zero_column", "constant_column"]])
    + """) SELECT column_name, min_value, max_value, min_value = 0 AND max_value = 0 AS all_zero,
    NOT (min_value = 0 AND max_value = 0) AND NOT regexp_matches(column_name, '^(is|has|rbf)_') AND sd < 1e-6 AS near_constant FROM s"""
)
def column_quality(spark, d):
    df = transactions(spark, d).withColumn("all_zero_column", F.lit(0)).withColumn("constant_column", F.lit(7.0))
    return manifest.column_quality(df, AMOUNTS + COUNTS + FLAGS + ["all_zero_column", "constant_column"])


@query("SELECT min(block_height) AS min_height, max(block_height) AS max_height, min(block_year) AS min_year, max(block_year) AS max_year, min(block_hour) AS min_hour, max(block_hour) AS max_hour, count(*) AS n FROM dataset WHERE block_height IS NOT NULL AND block_year IS NOT NULL")
def coverage_ranges(spark, d):
    rows = read_table(spark, d, "dataset").where("block_height is not null and block_year is not null")
    return rows.agg(*[f(f"block_{c}").alias(f"{n}_{c}") for c in ("height", "year", "hour") for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n"))


@query(f"WITH {TXN} SELECT stratum, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct FROM txn GROUP BY stratum")
def strata_distribution(spark, d):
    return report.profile_statistics(transactions(spark, d).withColumn("zero", F.lit(0.0)), "stratum", {}, "zero", "zero").select("stratum", F.col("tx_count").alias("n"), "pct")


_BALANCE = f"{TXN}, sizes AS (SELECT stratum, count(*) AS n FROM txn GROUP BY 1), targets AS (SELECT stratum, n, CAST(floor(max(n) OVER () * 0.3::DOUBLE) AS BIGINT) AS target FROM sizes)"


@query(f"WITH {_BALANCE} SELECT *, greatest(n, target) AS balanced_n FROM targets")
def balance_targets(spark, d):
    return resample.balance_targets(transactions(spark, d), "stratum")


@query(f"""WITH {_BALANCE}, ranked AS (SELECT stratum, _rid, row_number() OVER (PARTITION BY stratum ORDER BY _rid) - 1 AS src FROM txn),
    draws AS (SELECT stratum, n, unnest(range(target)) AS draw_id FROM targets WHERE n < target)
    SELECT stratum, src AS draw_id, _rid FROM ranked JOIN targets USING (stratum) WHERE n >= target
    UNION ALL SELECT stratum, draw_id, _rid FROM (SELECT stratum, draw_id, CAST('0x' || substr(md5('42|' || stratum || '|' || draw_id), 1, 8) AS BIGINT) % n AS src FROM draws) JOIN ranked USING (stratum, src)""")
def balanced_resample(spark, d):
    return resample.balanced_resample(transactions(spark, d), "stratum", "_rid", Stage(spark))


@query(f"WITH {LOGGED} SELECT _rid, {', '.join(f'round({c}, 6) AS {c}' for c in AMOUNTS)} FROM logged")
def log_transform(spark, d):
    return _logged(spark, d).select("_rid", *[F.round(c, 6).alias(c) for c in AMOUNTS])


_SCALED = ["fee", "total_output_value", "value_concentration_ratio", "has_op_return", "is_peer_to_peer"]
_NUMERIC = f"{LOGGED}, num AS (SELECT _rid, fee, total_output_value, value_concentration_ratio, CAST(has_op_return AS DOUBLE) AS has_op_return, CAST(is_peer_to_peer AS DOUBLE) AS is_peer_to_peer FROM logged)"


def _numeric(spark, d):
    return _logged(spark, d).select("_rid", *[F.col(c).cast("double").alias(c) for c in _SCALED])


@query(f"WITH {_NUMERIC}, p AS (SELECT {', '.join(f'quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) AS b_{c}' for c in _SCALED)} FROM num) SELECT _rid, {', '.join(f'round(({c} - m_{c}) / CASE WHEN b_{c} = a_{c} THEN 1 ELSE b_{c} - a_{c} END, 6) AS {c}' for c in _SCALED)} FROM num, p")
def robust_scale(spark, d):
    return scaling.robust_scale(_numeric(spark, d), _SCALED).select("_rid", *[F.round(c, 6).alias(c) for c in _SCALED])


@query(f"WITH {_NUMERIC}, p AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _SCALED)} FROM num) SELECT _rid, {', '.join(f'round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}' for c in _SCALED)} FROM num, p")
def standard_scale(spark, d):
    return scaling.standard_scale(_numeric(spark, d), _SCALED).select("_rid", *[F.round(c, 6).alias(c) for c in _SCALED])


@query(f"WITH {LABELLED}, r AS (SELECT profile, _rid, row_number() OVER (PARTITION BY profile ORDER BY md5('42|' || _rid), _rid) AS k, count(*) OVER (PARTITION BY profile) AS n FROM lab) SELECT profile, _rid FROM r WHERE k <= greatest(floor(n * 0.1::DOUBLE), 2)")
def proportional_sample(spark, d):
    return resample.proportional_sample(_labelled(spark, d).select("profile", "_rid"), "profile", 0.1, "_rid")


@query(f"WITH {LABELLED} SELECT profile, _rid FROM lab QUALIFY row_number() OVER (PARTITION BY profile ORDER BY md5('42|' || _rid), _rid) <= 50")
def equal_quota_sample(spark, d):
    return resample.quota_sample(_labelled(spark, d).select("profile", "_rid"), "profile", 50, "_rid")


@query(f"WITH {TXN}, u AS (SELECT _rid, CAST('0x' || substr(md5('42|' || _rid), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM txn) SELECT _rid, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS part FROM u")
def hash_split(spark, d):
    return transactions(spark, d).select("_rid", resample.split_of("_rid", {"train": 0.7, "validation": 0.15, "test": 0.15}).alias("part"))


_MI = ["fee", "total_output_value", "value_concentration_ratio", "input_output_ratio", "fee_rate_sat_per_vbyte"]


@query(
    f"WITH {LOGGED}, lab AS (SELECT *, {FIRST_SQL} AS profile FROM logged), long AS ("
    + _union(f"SELECT profile, '{c}' AS feature, {c} AS x FROM lab WHERE {c} IS NOT NULL" for c in _MI)
    + """), e AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM long GROUP BY 1),
    b AS (SELECT feature, profile, least(floor((x - lo) / (hi - lo) * 10), 9) AS bin FROM long JOIN e USING (feature)),
    t AS (SELECT feature, bin, profile, count(*) AS n FROM b GROUP BY ALL),
    w AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS na, sum(n) OVER (PARTITION BY feature, profile) AS nb FROM t),
    m AS (SELECT feature, sum(n::DOUBLE / t * ln(n::DOUBLE * t / (na::DOUBLE * nb))) AS mi FROM w GROUP BY 1)
    SELECT feature, round(mi, 6) AS mi_score, CAST(rank() OVER (ORDER BY mi DESC) AS INT) AS mi_rank FROM m"""
)
def binned_mi_rank(spark, d):
    df = _logged(spark, d)
    scores = metrics.binned_information(df.withColumn("profile", rules.first_match(df.columns)), _MI, "profile")
    return scores.withColumn("mi_rank", zeta.score_rank()).withColumn("mi_score", F.round("mi_score", 6))


_RANKED = "ranked AS (SELECT feature, mi_score, CAST(rank() OVER (ORDER BY coalesce(CAST(mi_score AS VARCHAR), 'nan') = 'nan', mi_score DESC) AS INT) AS mi_rank, count(*) OVER () AS n FROM feature_ranks)"
_POWER = "pow(mi_rank, -{s}::DOUBLE) / list_sum(list_transform(range(1, n + 1), lambda k: pow(k, -{s}::DOUBLE)))"


@query(f"WITH {_RANKED} SELECT feature, mi_rank, round({_POWER.format(s=1.5)}, 9) AS zeta_weight FROM ranked")
def zeta_weights(spark, d):
    out = zeta.weigh_features(read_table(spark, d, "feature_ranks").select("feature", "mi_score"), {"zeta_weight": 1.5})
    return out.select("feature", "mi_rank", F.round("zeta_weight", 9).alias("zeta_weight"))


@query(f"WITH {_RANKED} SELECT feature, mi_rank, {', '.join(f'round({_POWER.format(s=s)}, 9) AS {c}' for c, s in zeta.SWEEP.items())} FROM ranked")
def zeta_sensitivity(spark, d):
    """The base ranks, joined with the weights of the sweep."""
    features = read_table(spark, d, "feature_ranks").select("feature", "mi_score")
    base = zeta.weigh_features(features, {}).select("feature", "mi_rank")
    sweep = zeta.weigh_features(features, zeta.SWEEP).select("feature", *[F.round(c, 9).alias(c) for c in zeta.SWEEP])
    return base.join(sweep, "feature", "left")


@query(f"""WITH {_RANKED}, l AS (SELECT r.feature, r.mi_rank, r.n, f.w_s10 AS laplacian_score FROM ranked r JOIN feature_ranks f USING (feature)),
    a AS (SELECT *, row_number() OVER (ORDER BY laplacian_score, feature) AS lap_rank, CASE WHEN starts_with(feature, 'is_') OR starts_with(feature, 'has_') OR feature = 'rbf_enabled' THEN 10.0 ELSE 0.0 END AS p FROM l),
    s AS (SELECT *, 0.7::DOUBLE * lap_rank + 0.3::DOUBLE * mi_rank + p::DOUBLE AS g FROM a),
    k AS (SELECT *, row_number() OVER (ORDER BY g, laplacian_score, mi_rank, feature) AS rk FROM s)
    SELECT feature, CAST(lap_rank AS INT) AS lap_rank, mi_rank, p::DOUBLE AS flag_penalty, round(g, 6) AS geom_rank_score, CAST(rk AS INT) AS rank,
    round({_POWER.format(s=1.5).replace('mi_rank', 'rk')}, 9) AS geom_zeta_weight FROM k""")
def geometry_rank_fusion(spark, d):
    table = read_table(spark, d, "feature_ranks")
    features = zeta.weigh_features(table.select("feature", "mi_score", F.col("w_s10").alias("laplacian_score")), {})
    out = zeta.fuse_ranks(features)
    return out.select("feature", "lap_rank", "mi_rank", "flag_penalty", F.round("geom_rank_score", 6).alias("geom_rank_score"), "rank", F.round("geom_zeta_weight", 9).alias("geom_zeta_weight"))


_W = {"fee": 0.5, "total_output_value": 0.3, "value_concentration_ratio": 0.2}


@query(f"WITH {LOGGED} SELECT _rid, {', '.join(f'round({c} * {w}::DOUBLE, 6) AS {c}' for c, w in _W.items())} FROM logged")
def apply_weights(spark, d):
    return scaling.apply_weights(_logged(spark, d).select("_rid", *_W), _W).select("_rid", *[F.round(c, 6).alias(c) for c in _W])


@query(_union(f"SELECT '{c}' AS feature, true AS invariant" for c in _W))
def weight_invariance(spark, d):
    """Whether standardising takes a feature's weight out again."""
    df = _logged(spark, d).select(*[F.col(c) for c in _W], *[(F.col(c) * w).alias(f"w_{c}") for c, w in _W.items()])
    z = scaling.standard_scale(df, [*_W, *[f"w_{c}" for c in _W]])
    row = z.agg(*[(F.max(F.abs(F.col(c) - F.col(f"w_{c}"))) < 1e-6).alias(f"invariant__{c}") for c in _W])
    return manifest.unpivot(row, list(_W), {"invariant": "boolean"}, "feature")


@query(f"WITH {TXN} SELECT _rid, {FIRST_SQL} AS profile FROM txn")
def rule_first_match(spark, d):
    return _labelled(spark, d).select("_rid", "profile")


@query(f"WITH {TXN} SELECT _rid, {LAST_SQL} AS profile FROM txn")
def rule_overwrite_last(spark, d):
    df = transactions(spark, d)
    return df.select("_rid", rules.last_match(df.columns).alias("profile"))


@query(f"WITH {LABELLED} SELECT profile, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct FROM lab GROUP BY 1")
def rule_distribution(spark, d):
    return report.profile_statistics(_labelled(spark, d).withColumn("zero", F.lit(0.0)), "profile", {}, "zero", "zero").select("profile", F.col("tx_count").alias("n"), "pct")


@query("WITH s AS (SELECT cluster_id, count(*) AS n FROM results_labeled WHERE cluster_id IS NOT NULL GROUP BY 1) SELECT cluster_id, n, min(n) OVER () AS smallest, max(n) OVER () AS largest, round(avg(n) OVER (), 6) AS mean_size FROM s")
def cluster_sizes(spark, d):
    from pyspark.sql import Window as W

    one = W.partitionBy(F.lit(0))  # a row per cluster
    sizes = read_table(spark, d, "results_labeled").where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.select("cluster_id", "n", F.min("n").over(one).alias("smallest"), F.max("n").over(one).alias("largest"), F.round(F.avg("n").over(one), 6).alias("mean_size"))


@query(rf"""WITH {RESULTS}, c AS (SELECT cluster_id, family, count(*) AS n FROM res WHERE family <> 'Unknown' GROUP BY ALL),
    b AS (SELECT cluster_id, family AS best FROM c QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, family) = 1),
    a AS (SELECT cluster_id, best FROM (SELECT DISTINCT cluster_id FROM res WHERE cluster_id IS NOT NULL) LEFT JOIN b USING (cluster_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY best ORDER BY cluster_id) - 1 AS k FROM a)
    SELECT cluster_id, CASE WHEN best IS NULL THEN 'Empty_' || cluster_id WHEN k = 0 THEN best ELSE best || '_' || k END AS cluster_name FROM k""")
def semantic_names(spark, d):
    return rules.semantic_names(_results(spark, d), "cluster_id", "family")


_CONT = f"{RESULTS}, t AS (SELECT cluster_id, family, count(*) AS n FROM res WHERE cluster_id IS NOT NULL AND family IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {_CONT}, p AS (SELECT *, sum(n) OVER (PARTITION BY cluster_id) AS size, n / sum(n) OVER (PARTITION BY cluster_id) AS p FROM t),
    c AS (SELECT cluster_id, max(size) AS size, max(p) AS purity, sum(-p * log2(p + 1e-12)) AS h, arg_min(family, (-n, family)) AS top FROM p GROUP BY 1)
    SELECT round(sum(purity * size) / sum(size), 6) AS weighted_purity, round(avg(purity), 6) AS macro_purity, round(sum(h * size) / sum(size), 6) AS weighted_entropy,
    count(*) FILTER (purity >= 0.8 AND top <> 'Unknown') AS high_purity_clusters FROM c""")
def purity_entropy(spark, d):
    out = metrics.purity(_results(spark, d), "cluster_id", "family")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns[:3]], "high_purity_clusters")


@query(f"""WITH {_CONT}, w AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY cluster_id) AS na, sum(n) OVER (PARTITION BY family) AS nb FROM t),
    m AS (SELECT sum(n::DOUBLE / t * ln(n::DOUBLE * t / (na::DOUBLE * nb))) AS mi FROM w),
    a AS (SELECT sum(-p * ln(p)) AS ha FROM (SELECT DISTINCT cluster_id, na::DOUBLE / t AS p FROM w)), b AS (SELECT sum(-p * ln(p)) AS hb FROM (SELECT DISTINCT family, nb::DOUBLE / t AS p FROM w))
    SELECT round(mi, 6) AS mutual_information, round(2 * mi / (ha + hb), 6) AS nmi FROM m, a, b""")
def nmi(spark, d):
    out = metrics.normalised_information(_results(spark, d), "cluster_id", "family")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""WITH {_CONT}, best AS (SELECT cluster_id, family AS pred FROM t QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, family) = 1),
    x AS (SELECT family AS truth, pred, sum(n) AS n FROM t JOIN best USING (cluster_id) GROUP BY ALL),
    l AS (SELECT DISTINCT truth AS l FROM x UNION SELECT DISTINCT pred FROM x),
    s AS (SELECT l, coalesce((SELECT sum(n) FROM x WHERE truth = l), 0) AS tn, coalesce((SELECT sum(n) FROM x WHERE pred = l), 0) AS pn, coalesce((SELECT sum(n) FROM x WHERE truth = l AND pred = l), 0) AS h FROM l)
    SELECT round(sum(h) / sum(tn), 6) AS accuracy, round(avg(h / tn) FILTER (tn > 0), 6) AS balanced_accuracy, round(avg(2 * h / (tn + pn)), 6) AS macro_f1 FROM s""")
def classification_scores(spark, d):
    df = _results(spark, d).where("cluster_id is not null and family is not null")
    best = rules.majority(df, "cluster_id", "family").select("cluster_id", F.col("family").alias("pred"))
    out = metrics.classification_scores(df.join(F.broadcast(best), "cluster_id"), "family", "pred")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_CANDIDATE_METRICS = {"silhouette": "mean_anomaly_score", "davies_bouldin": "pct", "calinski_harabasz": "anomaly_rate"}
_CANDIDATE_COLUMNS = ", ".join(f"round(avg(CASE WHEN isfinite({c}) THEN {c} END), 9) AS {m}" for m, c in _CANDIDATE_METRICS.items())
#: Five candidates and a baseline, with three numbers each taken from the statistics of their shards.
_VALUES = f"c AS (SELECT 'c' || (shard_id % 5) AS name, {_CANDIDATE_COLUMNS} FROM profile_statistics WHERE shard_id IS NOT NULL GROUP BY 1), base AS (SELECT {_CANDIDATE_COLUMNS} FROM profile_statistics)"


def _measured(rows):
    return [F.round(F.avg(finite(c)), 9).alias(m) for m, c in _CANDIDATE_METRICS.items()]


def _candidates(spark, d):
    rows = read_table(spark, d, "profile_statistics").where("shard_id is not null")
    return rows.groupBy(F.concat(F.lit("c"), (F.col("shard_id") % 5).cast("string")).alias("name")).agg(*_measured(rows))


@query(f"""WITH {_VALUES}, r AS (SELECT c.*, row_number() OVER (ORDER BY c.silhouette DESC, name) + row_number() OVER (ORDER BY c.davies_bouldin, name) + row_number() OVER (ORDER BY c.calinski_harabasz DESC, name) AS rank_sum,
    CAST(c.silhouette > base.silhouette AS INT) + CAST(c.davies_bouldin < base.davies_bouldin AS INT) + CAST(c.calinski_harabasz > base.calinski_harabasz AS INT) AS wins FROM c, base)
    SELECT name, CAST(rank_sum AS INT) AS rank_sum, wins, CAST(row_number() OVER (ORDER BY (wins = 3) DESC, wins DESC, rank_sum, silhouette DESC, davies_bouldin, calinski_harabasz DESC, name) AS INT) AS place FROM r""")
def candidate_selection(spark, d):
    base = read_table(spark, d, "profile_statistics")
    base = base.agg(*_measured(base)).first().asDict()  # one row
    return compare.rank_candidates(_candidates(spark, d), base).select("name", "rank_sum", "wins", "place")


@query(f"""WITH {_VALUES} SELECT 'silhouette' AS metric, arg_min(name, (-silhouette, name)) AS winner, max(silhouette) AS value FROM c
    UNION ALL SELECT 'davies_bouldin', arg_min(name, (davies_bouldin, name)), min(davies_bouldin) FROM c
    UNION ALL SELECT 'calinski_harabasz', arg_min(name, (-calinski_harabasz, name)), max(calinski_harabasz) FROM c""")
def metric_winners(spark, d):
    return compare.metric_winners(_candidates(spark, d))


@query(f"""WITH {_VALUES}, p AS (SELECT 'silhouette' AS metric, a.silhouette AS new, b.silhouette AS old, true AS higher FROM c a, c b WHERE a.name = 'c0' AND b.name = 'c1'
    UNION ALL SELECT 'davies_bouldin', a.davies_bouldin, b.davies_bouldin, false FROM c a, c b WHERE a.name = 'c0' AND b.name = 'c1')
    SELECT metric, new, old, higher, round(CASE WHEN higher THEN new - old ELSE old - new END / greatest(abs(old), 1e-12) * 100, 6) AS improvement_pct, CASE WHEN higher THEN new > old ELSE new < old END AS wins FROM p""")
def improvement_pct(spark, d):
    long = _candidates(spark, d).where("name in ('c0', 'c1')").unpivot("name", ["silhouette", "davies_bouldin"], "metric", "v")
    pairs = long.groupBy("metric").pivot("name", ["c0", "c1"]).agg(F.first("v"))
    out = compare.improvements(pairs.select("metric", F.col("c0").alias("new"), F.col("c1").alias("old"), (F.col("metric") == "silhouette").alias("higher")))
    return out.withColumn("improvement_pct", F.round("improvement_pct", 6))


@query("SELECT shard_id, round(avg(pct), 6) AS pct_mean, round(stddev_samp(pct), 6) AS pct_std, round(avg(anomaly_rate), 6) AS anomaly_rate_mean, round(stddev_samp(anomaly_rate), 6) AS anomaly_rate_std FROM (SELECT shard_id, CASE WHEN isfinite(pct) THEN pct END AS pct, CASE WHEN isfinite(anomaly_rate) THEN anomaly_rate END AS anomaly_rate FROM profile_statistics) GROUP BY 1")
def repeat_summary(spark, d):
    runs = read_table(spark, d, "profile_statistics").select("shard_id", finite("pct").alias("pct"), finite("anomaly_rate").alias("anomaly_rate"))
    return compare.repeat_summary(runs, "shard_id", ["pct", "anomaly_rate"])


@query("WITH s AS (SELECT txid, cluster_id, block_height, CASE WHEN isfinite(anomaly_score) THEN CAST(anomaly_score AS DOUBLE) END AS s FROM results_labeled), t AS (SELECT quantile_cont(s, 0.95) AS threshold FROM s) SELECT coalesce(CAST(s > threshold AS INT), 0) AS flag, count(*) AS n, round(min(threshold), 6) AS threshold FROM s, t GROUP BY 1")
def anomaly_flag(spark, d):
    out = report.anomaly_flag(read_table(spark, d, "results_labeled"), "anomaly_score")
    return out.groupBy("flag").agg(F.count("*").alias("n"), F.round(F.min("threshold"), 6).alias("threshold"))


@query("WITH s AS (SELECT txid, CASE WHEN isfinite(anomaly_score) THEN CAST(anomaly_score AS DOUBLE) END AS s FROM results_labeled), p AS (SELECT min(s) AS lo, max(s) AS hi FROM s) SELECT txid, round((s - lo) / (hi - lo + 1e-9), 6) AS score FROM s, p")
def minmax_bridge(spark, d):
    df = read_table(spark, d, "results_labeled").select("txid", finite("anomaly_score").alias("s"))
    return scaling.minmax_scale(df, "s", "score").select("txid", F.round("score", 6).alias("score"))


_MEANS = ["input_count", "output_count", "fee_rate_sat_per_vbyte", "value_concentration_ratio"]
_FIN = lambda c: f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"


@query(f"SELECT tx_profile, count(*) AS tx_count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct, round(avg(CAST(is_anomaly AS DOUBLE)), 6) AS anomaly_rate, round(avg({_FIN('anomaly_score')}), 6) AS mean_anomaly_score, {', '.join(f'round(avg({_FIN(c)}), 6) AS mean_{c}' for c in _MEANS)} FROM results_labeled GROUP BY 1")
def profile_statistics(spark, d):
    return report.profile_statistics(read_table(spark, d, "results_labeled"), "tx_profile", {c: finite(c) for c in _MEANS}, "is_anomaly", "anomaly_score")


_HEAT = [*_MEANS, "block_hour"]
_MEAN_SQL = f"m AS (SELECT tx_profile, {', '.join(f'avg({_FIN(c)}) AS {c}' for c in _HEAT)} FROM results_labeled WHERE tx_profile IS NOT NULL GROUP BY 1)"


@query(f"""WITH {_MEAN_SQL}, top AS (SELECT tx_profile FROM results_labeled WHERE tx_profile IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, tx_profile LIMIT 25),
    r AS (SELECT tx_profile, {', '.join(f'round({c}, 6) AS {c}' for c in _HEAT)} FROM m SEMI JOIN top USING (tx_profile)), e AS (SELECT *, least({', '.join(_HEAT)}) AS lo, greatest({', '.join(_HEAT)}) AS hi FROM r)
    SELECT tx_profile, {', '.join(f'round(CASE WHEN hi > lo THEN ({c} - lo) / (hi - lo) WHEN {c} IS NOT NULL THEN 0 END, 6) AS {c}' for c in _HEAT)} FROM e""")
def profile_heatmap(spark, d):
    df = read_table(spark, d, "results_labeled")
    means = report.group_means(df, "tx_profile", {c: finite(c) for c in _HEAT})
    return report.row_minmax(means.join(F.broadcast(report.top_groups(df, "tx_profile", 25)), "tx_profile", "left_semi"), _HEAT)


_RADAR = f"""WITH {_MEAN_SQL}, a AS (SELECT * FROM m WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _HEAT)}),
    g AS (SELECT tx_profile, {', '.join(f'CASE WHEN max({c}) OVER () > 1 THEN ln(1 + greatest({c}, 0)) ELSE {c} END AS {c}' for c in _HEAT)} FROM a),
    z AS (SELECT tx_profile, {', '.join(f'(least(greatest(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, -2.5), 2.5) + 2.5) / 5 AS {c}' for c in _HEAT)} FROM g)
    SELECT tx_profile, {', '.join(f'round({c}, 6) AS {c}' for c in _HEAT)}, round(greatest({', '.join(_HEAT)}) - least({', '.join(_HEAT)}), 6) AS spread FROM z"""


def radar_sql(tail: str) -> str:
    return f"SELECT tx_profile, spread FROM ({_RADAR}) JOIN (SELECT tx_profile, count(*) AS tx_count FROM results_labeled GROUP BY 1) USING (tx_profile){tail}"


@query(_RADAR)
def radar(spark, d):
    means = report.group_means(read_table(spark, d, "results_labeled"), "tx_profile", {c: finite(c) for c in _HEAT}, None)
    return report.radar(means, "tx_profile", _HEAT)


@query(f"""WITH {_MEAN_SQL}, top AS (SELECT tx_profile, row_number() OVER (ORDER BY count(*) DESC, tx_profile) AS rank FROM results_labeled WHERE tx_profile IS NOT NULL GROUP BY 1 ORDER BY rank LIMIT 8)
    SELECT CAST(rank AS INT) AS rank, tx_profile, {', '.join(f'round({c}, 6) AS {c}' for c in _MEANS)} FROM m JOIN top USING (tx_profile)""")
def group_reindex(spark, d):
    """Group means in the order of the groups' frequency."""
    df = read_table(spark, d, "results_labeled")
    return report.group_means(df, "tx_profile", {c: finite(c) for c in _MEANS}).join(F.broadcast(report.top_groups(df, "tx_profile", 8).select("tx_profile", "rank")), "tx_profile").orderBy("rank")


@query("WITH top AS (SELECT tx_profile AS p FROM results_labeled WHERE tx_profile IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, tx_profile LIMIT 8) SELECT CASE WHEN tx_profile IN (SELECT p FROM top) THEN tx_profile ELSE 'Other' END AS tx_profile, count(*) AS n FROM results_labeled GROUP BY 1")
def top_profiles_other(spark, d):
    return report.with_other(read_table(spark, d, "results_labeled"), "tx_profile", 8)


@query("""WITH v AS (SELECT tx_profile, CAST(block_height AS DOUBLE) AS v FROM results_labeled WHERE block_height IS NOT NULL AND tx_profile IS NOT NULL), e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 80 AS width FROM v),
    b AS (SELECT tx_profile, CAST(least(floor((v - lo) / width), 79) AS INT) AS bin, width FROM v, e), t AS (SELECT tx_profile, bin, count(*) AS n, min(width) AS width FROM b GROUP BY ALL)
    SELECT tx_profile, bin, n, round(n / (sum(n) OVER (PARTITION BY tx_profile) * width), 10) AS density FROM t""")
def temporal_density(spark, d):
    return report.density(read_table(spark, d, "results_labeled"), "block_height", "tx_profile", 80)


@query(f"""WITH v AS (SELECT tx_profile, {_FIN('anomaly_score')} AS v FROM results_labeled WHERE tx_profile IS NOT NULL),
    q AS (SELECT tx_profile, count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS q3 FROM v WHERE v IS NOT NULL GROUP BY 1),
    w AS (SELECT tx_profile, min(v) AS lw, max(v) AS hw FROM v JOIN q USING (tx_profile) WHERE v BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) GROUP BY 1)
    SELECT tx_profile, n, round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3, round(lw, 6) AS low_whisker, round(hw, 6) AS high_whisker FROM q JOIN w USING (tx_profile)""")
def box_stats(spark, d):
    return report.box_stats(read_table(spark, d, "results_labeled"), "anomaly_score", "tx_profile")


_TABLES = ["dataset", "results_labeled", "profile_statistics", "feature_ranks", "documents", "embeddings"]


@query(_union(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES))
def sync_counts(spark, d):
    """Rows of every table; counting reads no column."""
    out = None
    for t in _TABLES:
        one = read_table(spark, d, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT r.txid AS txid, count(*) AS n FROM results_labeled r ANTI JOIN dataset d ON r.txid = d.txid WHERE r.txid IS NOT NULL GROUP BY 1")
def unmatched_labels(spark, d):
    """Labelled transactions that were never delivered, with their rows."""
    return read_table(spark, d, "results_labeled").where("txid is not null").join(read_table(spark, d, "dataset").select("txid"), "txid", "left_anti").groupBy("txid").agg(F.count("*").alias("n"))


@query("SELECT r.txid AS txid, r.tx_profile AS tx_profile, d.rows AS deliveries FROM (SELECT DISTINCT txid, tx_profile FROM results_labeled WHERE txid IS NOT NULL) r JOIN (SELECT txid, count(*) AS rows FROM dataset GROUP BY 1) d ON r.txid = d.txid")
def label_join(spark, d):
    """Labels joined to deliveries by transaction."""
    labels = read_table(spark, d, "results_labeled").where("txid is not null").select("txid", "tx_profile").distinct()
    rows = read_table(spark, d, "dataset").groupBy("txid").agg(F.count("*").alias("deliveries"))
    return labels.join(rows, "txid")


_NAMES = [f"c{i}" for i in range(5)]


@query(f"""WITH {_VALUES}, u AS (UNPIVOT c ON silhouette, davies_bouldin, calinski_harabasz INTO NAME metric VALUE v)
    SELECT metric, {', '.join(f"max(v) FILTER (name = '{n}') AS {n}" for n in _NAMES)} FROM u GROUP BY metric""")
def metrics_pivot(spark, d):
    """Metrics as rows and methods as columns."""
    long = _candidates(spark, d).unpivot("name", list(compare.METRICS), "metric", "v")
    return long.groupBy("metric").pivot("name", _NAMES).agg(F.max("v"))


@query(f"""WITH {_VALUES}, x AS (SELECT CASE name WHEN 'c0' THEN 'A' WHEN 'c1' THEN 'B' WHEN 'c2' THEN 'C' WHEN 'c3' THEN 'D' END AS k, silhouette AS v FROM c WHERE name <> 'c4')
    SELECT n.k || '-' || o.k AS step, round(n.v - o.v, 6) AS delta, round((n.v - o.v) / abs(o.v) * 100, 6) AS pct FROM x n JOIN x o ON (n.k, o.k) IN (('B', 'A'), ('C', 'B'), ('D', 'A'))""")
def component_deltas(spark, d):
    """Changes between conditions after renaming: B against A, C against B, D against A."""
    x = _candidates(spark, d).where("name <> 'c4'").replace({"c0": "A", "c1": "B", "c2": "C", "c3": "D"}, subset=["name"]).select(F.col("name").alias("k"), F.col("silhouette").alias("v"))
    steps = F.broadcast(spark.createDataFrame([("B", "A"), ("C", "B"), ("D", "A")], "n string, o string"))
    pairs = steps.join(x.select(F.col("k").alias("n"), F.col("v").alias("nv")), "n").join(x.select(F.col("k").alias("o"), F.col("v").alias("ov")), "o")  # three rows
    delta = F.col("nv") - F.col("ov")
    return pairs.select(F.concat("n", F.lit("-"), "o").alias("step"), F.round(delta, 6).alias("delta"), F.round(F.try_divide(delta, F.abs("ov")) * 100, 6).alias("pct"))


@query(radar_sql(" ORDER BY spread DESC, tx_count DESC, tx_profile LIMIT 6"))
def radar_top(spark, d):
    """The six groups of the largest spread, larger groups first among equals."""
    df = read_table(spark, d, "results_labeled")
    size = df.groupBy("tx_profile").agg(F.count("*").alias("tx_count"))
    return radar(spark, d).join(size, "tx_profile").orderBy(F.desc("spread"), F.desc("tx_count"), "tx_profile").limit(6).select("tx_profile", "spread")


@query("SELECT DISTINCT tx_profile FROM results_labeled WHERE tx_profile IS NOT NULL UNION SELECT DISTINCT tx_profile FROM profile_statistics WHERE tx_profile IS NOT NULL")
def distinct_profiles(spark, d):
    parts = [read_table(spark, d, t).select("tx_profile").where("tx_profile is not null") for t in ("results_labeled", "profile_statistics")]
    return parts[0].union(parts[1]).distinct()


@query("SELECT count(DISTINCT txid) AS n_txids, count(DISTINCT tx_profile) AS n_profiles, count(DISTINCT cluster_id) AS n_clusters FROM results_labeled")
def distinct_counts(spark, d):
    return read_table(spark, d, "results_labeled").agg(F.countDistinct("txid").alias("n_txids"), F.countDistinct("tx_profile").alias("n_profiles"), F.countDistinct("cluster_id").alias("n_clusters"))


@query("WITH top AS (SELECT tx_profile FROM results_labeled WHERE tx_profile IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, tx_profile LIMIT 15) SELECT count(*) AS n, min(block_height) AS min_height, max(block_height) AS max_height FROM results_labeled WHERE tx_profile IN (SELECT tx_profile FROM top) AND is_anomaly = 1")
def anomalies_of_top_profiles(spark, d):
    df = read_table(spark, d, "results_labeled")
    top = report.top_groups(df, "tx_profile", 15)
    return df.where("is_anomaly = 1").join(F.broadcast(top), "tx_profile", "left_semi").agg(F.count("*").alias("n"), F.min("block_height").alias("min_height"), F.max("block_height").alias("max_height"))
