"""Queries on sources and sinks, schema checks and small operators, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.columns import finite
from ledgerlens.operators import kmeans, manifest, report, resample, zeta
from ledgerlens.plans.runner import Runner, Step
from ledgerlens.plans.tables_queries import RESULTS
from ledgerlens.plans.transactions import AMOUNTS, COUNTS, FLAGS, TXN, transactions
from ledgerlens.plans.vector_queries import CENT, E, vectors
from ledgerlens.sources import models
from ledgerlens.sources.tables import ResultStore, Stage, first_existing, read_csv, read_manifest, read_table, write_csv, write_manifest, write_parquet

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _folder(spark: SparkSession) -> str:
    return f"{Stage(spark).root}/out"


_FAMILIES = f"WITH {RESULTS} SELECT family, count(*) AS n, round(avg(CAST(anomaly_score AS DOUBLE)) FILTER (isfinite(CAST(anomaly_score AS DOUBLE))), 6) AS mean_score FROM res GROUP BY family"


def _families(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "results_labeled").withColumn("family", F.regexp_replace("tx_profile", r"_\d+$", ""))
    return df.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg(finite("anomaly_score")), 6).alias("mean_score"))


@query(_FAMILIES)
def csv_report(spark, d):
    """A report written as CSV and read back under its schema."""
    path = _folder(spark)
    write_csv(_families(spark, d).coalesce(1), path)
    return read_csv(spark, path, "family string, n bigint, mean_score double")


@query(_FAMILIES)
def parquet_report(spark, d):
    """The same by Parquet, partitioned on disk; the null family is its own folder."""
    path = _folder(spark)
    write_parquet(_families(spark, d), path, ["family"])
    return spark.read.schema("n bigint, mean_score double, family string").parquet(path)


@query(f"WITH {RESULTS} SELECT family, count(*) AS n FROM res WHERE is_anomaly = 1 GROUP BY family HAVING count(*) > 1")
def sql_view(spark, d):
    """A frame registered as a view and asked in SQL."""
    read_table(spark, d, "results_labeled").withColumn("family", F.regexp_replace("tx_profile", r"_\d+$", "")).createOrReplaceTempView("labelled_results")
    return spark.sql("SELECT family, count(*) AS n FROM labelled_results WHERE is_anomaly = 1 GROUP BY family HAVING count(*) > 1")


@query("SELECT count(*) AS n_rows FROM dataset")
def fallback_source(spark, d):
    """The first of several paths that exists."""
    return spark.read.parquet(first_existing(spark, f"{d}/dataset_new.parquet", f"{d}/dataset.parquet")).agg(F.count("*").alias("n_rows"))


_DTYPES = "CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'double' ELSE lower(column_type) END"


@query(f"SELECT {_DTYPES} AS dtype, count(*) AS n_columns FROM (DESCRIBE dataset) GROUP BY 1")
def dtype_histogram(spark, d):
    """Columns by type, from the schema alone."""
    kinds = [(f.dataType.simpleString().replace("timestamp_ntz", "timestamp"),) for f in read_table(spark, d, "dataset").schema]
    return spark.createDataFrame(kinds, "dtype string").groupBy("dtype").agg(F.count("*").alias("n_columns"))


def _names(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_QUALITY = " UNION ALL ".join(f"SELECT '{c}' AS column_name, coalesce(min({x}) = 0 AND max({x}) = 0, false) AS zero, coalesce(NOT (min({x}) = 0 AND max({x}) = 0) AND stddev_samp({x}) < 1e-6, false) AS near FROM dataset" for c in ["batch_id", "block_height", "block_hour", "block_month", "block_year", "day_of_week", "input_address_count", "input_count", "input_script_count", "locktime", "output_address_count", "output_count", "output_script_count", "shard_id", "size_bytes", "total_addresses", "tx_version", "vsize", "week_of_year", "weight", *AMOUNTS, *FLAGS, "address_reuse"] for x in [f"CASE WHEN isfinite(CAST(CAST({c} AS INT) AS DOUBLE)) THEN CAST({c} AS INT) END" if c in (*FLAGS, "address_reuse") else f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"])
_ROLES = f"""WITH q AS ({_QUALITY}), names AS (SELECT column_name, column_type FROM (DESCRIBE dataset)), flags AS (SELECT column_name FROM names WHERE regexp_matches(column_name, '^(is|has|rbf)_')),
    near AS (SELECT column_name FROM q WHERE near AND column_name NOT IN (SELECT * FROM flags)), zero AS (SELECT column_name FROM q WHERE zero),
    art AS (SELECT column_name FROM names WHERE column_name IN {_names(manifest.ARTIFACT_NAMES)}), ident AS (SELECT column_name FROM names WHERE column_name IN {_names(manifest.IDENTIFIER_NAMES)}),
    tmp AS (SELECT column_name FROM names WHERE column_name IN {_names(manifest.TEMPORAL_NAMES)}), gone AS (SELECT * FROM zero UNION SELECT * FROM near UNION SELECT * FROM art UNION SELECT * FROM ident UNION SELECT * FROM tmp),
    feat AS (SELECT column_name, column_type FROM names WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'BOOLEAN') AND column_name NOT IN (SELECT * FROM gone))"""
SQL["column_manifest"] = f"""{_ROLES} SELECT 'features' AS role, column_name FROM feat UNION ALL SELECT 'dropped', * FROM gone UNION ALL SELECT 'all_zero', * FROM zero UNION ALL SELECT 'near_constant', * FROM near
    UNION ALL SELECT 'artifacts', * FROM art UNION ALL SELECT 'identifiers', * FROM ident UNION ALL SELECT 'temporal', * FROM tmp UNION ALL SELECT 'flags', * FROM flags"""


@query(f"{_ROLES} SELECT column_name AS feature, {_DTYPES} AS dtype, true AS usable FROM feat")
def verified_features(spark, d):
    """The manifest, written and read as JSON, against the types its columns have now."""
    df = read_table(spark, d, "dataset")
    path = _folder(spark)
    write_manifest(spark, path, manifest.build_manifest(df).as_dict())
    kinds = dict(df.dtypes)
    rows = [(c, kinds.get(c), manifest.is_number(df.schema[c].dataType) if c in kinds else False) for c in read_manifest(spark, path)["features"]]
    return spark.createDataFrame(rows, "feature string, dtype string, usable boolean")


_META = ["block_height", "block_year", "block_hour", "day_of_week", "txid"]


@query(f"{_ROLES}, c AS (SELECT column_name FROM names WHERE column_name NOT IN (SELECT * FROM gone) OR column_name IN {_names(_META)}) SELECT column_name, (SELECT count(*) FROM dataset) AS n_rows FROM c")
def kept_columns(spark, d):
    """The columns left when the manifest's drop list goes, except protected ones, and the rows they have."""
    df = read_table(spark, d, "dataset")
    left = df.drop(*[c for c in manifest.build_manifest(df).dropped if c not in _META])
    n = left.agg(F.count("*").alias("n_rows"))
    return n.select(F.explode(F.array(*[F.lit(c) for c in left.columns])).alias("column_name"), "n_rows")


_NUMBERS = AMOUNTS + COUNTS


@query()
def filled_nulls(spark, d):
    """Null and NaN cells of the number columns before they are filled with 0, and after."""
    df = read_table(spark, d, "dataset").select(*_NUMBERS)
    empty = lambda rows: sum((F.count_if(F.col(c).isNull()) for c in _NUMBERS), F.lit(0))
    nan = sum((F.count_if(F.isnan(F.col(c).cast("double"))) for c in _NUMBERS), F.lit(0))
    after = df.na.fill(0).agg(F.lit(0).cast("bigint").alias("z"), (empty(df) + nan).cast("bigint").alias("left_cells"))
    return df.agg(empty(df).cast("bigint").alias("null_cells"), nan.cast("bigint").alias("nan_cells")).join(F.broadcast(after.drop("z")), how="cross")


SQL["filled_nulls"] = f"SELECT CAST({' + '.join(f'(count(*) - count({c}))' for c in _NUMBERS)} AS BIGINT) AS null_cells, CAST({' + '.join(f'count(*) FILTER (isnan(CAST({c} AS DOUBLE)))' for c in _NUMBERS)} AS BIGINT) AS nan_cells, CAST(0 AS BIGINT) AS left_cells FROM dataset"


_MATRIX = ["fee", "vsize", "input_count", "has_op_return"]


@query(f"WITH {TXN} SELECT _rid, CAST(dim AS INT) AS dim, val FROM (SELECT _rid, unnest(range(4)) AS dim, unnest([coalesce(fee, 0), coalesce(CAST(vsize AS DOUBLE), 0), coalesce(CAST(input_count AS DOUBLE), 0), CAST(CAST(has_op_return AS INT) AS DOUBLE)]) AS val FROM txn)")
def feature_matrix(spark, d):
    """Ordered columns as one vector a row, here one row a cell."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in _MATRIX])
    return transactions(spark, d).select("_rid", F.posexplode(x).alias("dim", "val"))


@query(f"WITH {CENT}, dd AS (SELECT vec_id, list(list_distance(v, c) ORDER BY cv.label) AS w FROM e, cv GROUP BY 1), j AS (SELECT vec_id, list_concat(v, w) AS x FROM e JOIN dd USING (vec_id)) SELECT vec_id, CAST(len(x) AS INT) AS dims, round(list_sum(x), 6) AS total, round(x[65], 6) AS first_added FROM j")
def enriched_matrix(spark, d):
    """Vectors with the distances to all class means added behind, joined by key."""
    v = vectors(spark, d)
    centres = kmeans.centre_matrix(v, "label")[1]
    far = F.array(*[F.sqrt(F.aggregate(F.zip_with("embedding", F.lit(c.tolist()), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)) for c in centres])
    x = v.select("vec_id", "embedding").join(v.select("vec_id", far.alias("w")), "vec_id").select("vec_id", F.concat("embedding", "w").alias("x"))
    return x.select("vec_id", F.size("x").alias("dims"), F.round(F.aggregate("x", F.lit(0.0), lambda s, a: s + a), 6).alias("total"), F.round(F.get("x", F.lit(64)), 6).alias("first_added"))


@query(f"WITH {CENT} SELECT label, CAST(dim AS INT) AS dim, round(val, 6) AS val FROM cent")
def saved_model(spark, d):
    """Fitted centres, saved and loaded."""
    names, centres = kmeans.centre_matrix(vectors(spark, d), "label")
    path = _folder(spark)
    models.save_model(spark, path, {"centres": centres, "k": float(len(names))})
    found = models.load_model(spark, path)
    return spark.createDataFrame([(names[i], j, round(float(x), 6)) for i in range(int(found["k"])) for j, x in enumerate(found["centres"][i])], f"label {vectors(spark, d).schema['label'].dataType.simpleString()}, dim int, val double")


_PART = "CAST('0x' || substr(md5('9|' || vec_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"WITH {E}, p AS (SELECT *, {_PART} < 0.1::DOUBLE AS noise FROM s), n AS (SELECT a.vec_id, b.label FROM p a JOIN p b ON NOT b.noise WHERE a.noise QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) = 1) SELECT vec_id, label, true AS was_noise FROM n UNION ALL SELECT vec_id, label, false FROM p WHERE NOT noise")
def noise_to_nearest(spark, d):
    """Rows without a cluster (here a tenth, by hash) take that of the nearest row that has one."""
    from ledgerlens.operators.neighbours import k_nearest

    v = vectors(spark, d).withColumn("part", resample.split_of("vec_id", {"noise": 0.1, "kept": 0.9}, 9))
    kept, noise = v.where("part = 'kept'"), v.where("part = 'noise'")
    near = k_nearest(noise, kept, 1).join(kept.select(F.col("vec_id").alias("dst"), "label"), "dst")
    return near.select(F.col("src").alias("vec_id"), "label", F.lit(True).alias("was_noise")).unionByName(kept.select("vec_id", "label", F.lit(False).alias("was_noise")))


@query("SELECT s, round(zeta, 6) AS zeta, round((SELECT sum(1.0::DOUBLE / power(k, s)) FROM range(1, 28) r(k)), 6) AS truncated FROM (VALUES (1.5::DOUBLE, 2.612375348685488::DOUBLE), (2.0::DOUBLE, 1.6449340668482264::DOUBLE), (3.0::DOUBLE, 1.2020569031595942::DOUBLE)) t(s, zeta) UNION ALL SELECT 1.0::DOUBLE, CAST('inf' AS DOUBLE), round((SELECT sum(1.0::DOUBLE / k) FROM range(1, 28) r(k)), 6)")
def zeta_truncation(spark, d):
    """The zeta function at each exponent against its sum up to the number of features."""
    n = read_table(spark, d, "feature_ranks").count()
    rows = [(s, round(zeta.zeta(s), 6) if s > 1 else float("inf"), round(zeta.normaliser(n, s), 6)) for s in (1.0, 1.5, 2.0, 3.0)]
    return spark.createDataFrame(rows, "s double, zeta double, truncated double")


@query("SELECT tx_profile, arg_min(mean_fee_rate_sat_per_vbyte, (run_ts, stat_id)) AS first_rate FROM profile_statistics WHERE mean_fee_rate_sat_per_vbyte IS NOT NULL AND NOT isnan(mean_fee_rate_sat_per_vbyte) AND tx_profile IS NOT NULL GROUP BY 1")
def first_present(spark, d):
    """Each profile's first rate that isn't missing, in the order of runs."""
    rate = finite("mean_fee_rate_sat_per_vbyte")
    rows = read_table(spark, d, "profile_statistics").where("tx_profile is not null").where(rate.isNotNull())
    return rows.groupBy("tx_profile").agg(F.min_by(rate, F.struct("run_ts", "stat_id")).alias("first_rate"))


@query("SELECT CAST(i AS INT) AS i, round(2 * pi() * i / 7, 9) AS angle FROM range(7) t(i)")
def even_angles(spark, d):
    """Evenly spaced angles of a radar's axes."""
    return spark.range(7).select(F.col("id").cast("int").alias("i"), F.round(2 * F.pi() * F.col("id") / 7, 9).alias("angle"))


@query("SELECT txid, batch_id, CAST(year(block_time) AS INT) AS y, CAST(month(block_time) AS INT) AS m, CAST(hour(block_time) AS INT) AS h, CAST(date_diff('day', block_time::DATE, ingested_at::DATE) AS INT) AS lag_days FROM dataset WHERE block_time IS NOT NULL")
def time_parts(spark, d):
    """Parts of the block time, and the days until delivery."""
    df = read_table(spark, d, "dataset").where("block_time is not null")
    return df.select("txid", "batch_id", F.year("block_time").alias("y"), F.month("block_time").alias("m"), F.hour("block_time").alias("h"), F.datediff("ingested_at", "block_time").alias("lag_days"))


@query("""WITH q AS (SELECT quantile_cont(s, 0.01) AS lo, quantile_cont(s, 0.99) AS hi FROM (SELECT CASE WHEN isfinite(CAST(anomaly_score AS DOUBLE)) THEN CAST(anomaly_score AS DOUBLE) END AS s FROM results_labeled) WHERE s IS NOT NULL)
    SELECT txid, round(CAST(umap_x AS DOUBLE), 5) AS px, round(CAST(umap_y AS DOUBLE), 5) AS py, round(least(greatest(CAST(anomaly_score AS DOUBLE), lo), hi), 6) AS shown FROM results_labeled, q WHERE isfinite(CAST(anomaly_score AS DOUBLE)) AND umap_x IS NOT NULL""")
def anomaly_overlay(spark, d):
    """Coordinates with the score cut to its 1st to 99th percentile, for the colour range. The surveyed figure samples; all rows come out."""
    from ledgerlens.operators.skew import quantile_row

    s = finite("anomaly_score")
    df = read_table(spark, d, "results_labeled").select("txid", "umap_x", "umap_y", s.alias("s"))
    q = quantile_row(df.select("s"), ["s"], [0.01, 0.99]).select(F.col("s")[0].alias("lo"), F.col("s")[1].alias("hi"))
    shown = F.least(F.greatest("s", "lo"), "hi")
    return df.where("s is not null and umap_x is not null").join(F.broadcast(q), how="cross").select("txid", F.round(F.col("umap_x").cast("double"), 5).alias("px"), F.round(F.col("umap_y").cast("double"), 5).alias("py"), F.round(shown, 6).alias("shown"))


@query("WITH top AS (SELECT tx_profile AS p FROM results_labeled WHERE tx_profile IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, tx_profile LIMIT 8) SELECT txid, round(CAST(umap_x AS DOUBLE), 5) AS px, round(CAST(umap_y AS DOUBLE), 5) AS py, CASE WHEN tx_profile IN (SELECT p FROM top) THEN tx_profile ELSE 'Other' END AS shown FROM results_labeled")
def profile_scatter(spark, d):
    """Coordinates by profile, the eight largest and the others."""
    df = read_table(spark, d, "results_labeled")
    top = report.top_groups(df, "tx_profile", 8).select(F.col("tx_profile").alias("p"))
    return df.join(F.broadcast(top), F.col("tx_profile") == F.col("p"), "left").select("txid", F.round(F.col("umap_x").cast("double"), 5).alias("px"), F.round(F.col("umap_y").cast("double"), 5).alias("py"), F.coalesce("p", F.lit("Other")).alias("shown"))


@query("""WITH c AS (SELECT count(*) AS n, count(DISTINCT txid) AS t, count(*) FILTER (fee IS NULL) AS f, min(block_height) AS lo, max(block_height) AS hi FROM dataset)
    SELECT 1 AS line_no, 'DATA QUALITY' AS line UNION ALL SELECT 2, 'rows: ' || n FROM c UNION ALL SELECT 3, 'transactions: ' || t FROM c UNION ALL SELECT 4, 'rows without fee: ' || f FROM c UNION ALL SELECT 5, 'heights: ' || lo || ' to ' || hi FROM c""")
def quality_report(spark, d):
    """A text report, written as one file and read back with its line numbers."""
    df = read_table(spark, d, "dataset")
    c = df.agg(F.count("*").alias("n"), F.countDistinct("txid").alias("t"), F.count_if(F.col("fee").isNull()).alias("f"), F.min("block_height").alias("lo"), F.max("block_height").alias("hi"))
    lines = [F.lit("DATA QUALITY"), F.concat(F.lit("rows: "), "n"), F.concat(F.lit("transactions: "), "t"), F.concat(F.lit("rows without fee: "), "f"), F.concat(F.lit("heights: "), "lo", F.lit(" to "), "hi")]
    path = _folder(spark)
    report.write_lines(c.select(F.posexplode(F.array(*lines)).alias("at", "line")), path)
    return report.read_lines(spark, path)


@query("SELECT tx_profile AS method, CAST(min(cluster_id) AS INT) AS n_clusters, round(avg(CAST(umap_x AS DOUBLE)), 6) AS silhouette FROM results_labeled WHERE tx_profile IS NOT NULL GROUP BY 1")
def stored_results(spark, d):
    """Results appended to the typed store in two parts and read back; missing fields are null, every row is stamped."""
    rows = read_table(spark, d, "results_labeled").where("tx_profile is not null").groupBy(F.col("tx_profile").alias("method")).agg(F.min("cluster_id").alias("n_clusters"), F.round(F.avg(F.col("umap_x").cast("double")), 6).alias("silhouette"))
    full = Stage(spark).put(rows.withColumns({"davies_bouldin": F.lit(None).cast("double"), "calinski_harabasz": F.lit(None).cast("double")}))
    store = ResultStore(spark, _folder(spark))
    for part in (0, 1):
        store.append("comparison_results", full.where(F.pmod(F.xxhash64("method"), F.lit(2)) == part))
    return store.read("comparison_results").where("run_ts is not null").select("method", "n_clusters", "silhouette")


@query("SELECT * FROM (VALUES (1, 'audit', 'ran'), (1, 'clean', 'ran'), (1, 'summary', 'ran'), (2, 'audit', 'kept'), (2, 'clean', 'kept'), (2, 'summary', 'kept'), (3, 'audit', 'kept'), (3, 'clean', 'ran'), (3, 'summary', 'ran')) t(run, step, status)")
def resumed_run(spark, d):
    """Three runs of three steps: all run; all are kept; one is asked for again, and what needs it runs as well."""
    steps = [
        Step("audit", lambda _: manifest.null_counts(read_table(spark, d, "dataset"))),
        Step("clean", lambda _: transactions(spark, d)),
        Step("summary", lambda t: t["clean"].groupBy("stratum").count(), ("clean",)),
    ]
    runner = Runner(spark, _folder(spark), steps)
    rows = [(i, s, how) for i, again in ((1, ()), (2, ()), (3, ("clean",))) for s, how in runner.run(again)]
    return spark.createDataFrame(rows, "run int, step string, status string")


@query()
def size_audit(spark, d):
    """(table_name, n_rows, n_bytes): rows and bytes on disk of every table."""
    jvm, out = spark.sparkContext._jvm, None
    for t in ("dataset", "results_labeled", "profile_statistics", "documents", "embeddings"):
        path = jvm.org.apache.hadoop.fs.Path(f"{d}/{t}.parquet")
        size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        one = read_table(spark, d, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows", F.lit(size).cast("bigint").alias("n_bytes"))
        out = one if out is None else out.unionByName(one)
    return out
