"""Edge cases of the table operators: nulls, NaN, ties, constants, empty tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.functions.columns import clip, improvement, log_amount, safe_div
from ledgerlens.operators import manifest, metrics, neighbours, report, resample, rules, scaling, zeta
from ledgerlens.plans import pipeline, vector_queries
from ledgerlens.sources import tables


def one(df):
    return tuple(df.collect()[0])


def test_columns(spark):
    df = spark.createDataFrame([(None, 0.0), (-5.0, 0.0), (float("nan"), 2.0)], "a double, b double")
    logs = [r[0] for r in df.select(log_amount("a")).collect()]
    assert logs[0] is None and abs(logs[1]) < 1e-7 and logs[2] is None
    assert [r[0] for r in df.select(clip("a", 0, 1)).collect()][0] is None
    assert [r[0] for r in df.select(safe_div(F.lit(1.0), F.col("b"))).collect()] == [None, None, 0.5]
    assert math.isclose(one(df.limit(1).select(improvement(F.lit(0.8), F.lit(1.0), False)))[0], 20)


def test_robust_scale_keeps_columns_without_range(spark):
    df = spark.createDataFrame([(float(i == 9), float(i)) for i in range(10)], "flag double, x double")
    rows = scaling.robust_scale(df, ["flag", "x"]).collect()
    assert sorted({r.flag for r in rows}) == [0.0, 1.0]


def test_rules(spark):
    df = spark.createDataFrame([(True, True, None), (False, True, False), (None, None, None)], "is_coinjoin_like boolean, rbf_enabled boolean, is_batch_payment boolean")
    got = [tuple(r) for r in df.select(rules.first_match(df.columns), rules.last_match(df.columns)).collect()]
    assert got == [("Coinjoin_Mixer", "RBF_Enabled"), ("RBF_Enabled", "RBF_Enabled"), ("Unknown", "Unknown")]


def test_names_number_repeats_and_empty_clusters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "Unknown"), (4, None), (None, "a"), (5, "b"), (5, "a")], "c int, l string")
    got = {r.c: r.cluster_name for r in rules.semantic_names(df, "c", "l").collect()}
    assert got == {1: "a", 2: "a_1", 3: "Empty_3", 4: "Empty_4", 5: "a_2"}


def test_balance_replaces_only_small_strata(spark, stage):
    df = spark.createDataFrame([("a", f"a{i}") for i in range(100)] + [("b", f"b{i}") for i in range(30)] + [("c", f"c{i}") for i in range(4)], "s string, rid string")
    got = {r.s: r.n for r in resample.balanced_resample(df, "s", "rid", stage).groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 100, "b": 30, "c": 30}


def test_samples(spark):
    df = spark.createDataFrame([("a", str(i)) for i in range(50)] + [("b", "x")], "g string, rid string")
    got = {r.g: r.n for r in resample.proportional_sample(df, "g", 0.1, "rid").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 5, "b": 1}
    assert resample.quota_sample(df, "g", 7, "rid").count() == 8


def test_ties_share_a_rank_and_break_the_sum(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", float("nan"))], "feature string, mi_score double")
    rows = zeta.weigh_features(df, {"w": 1.0}).collect()
    assert {r.feature: r.mi_rank for r in rows} == {"a": 1, "b": 2, "c": 2, "d": 4}
    assert abs(sum(r.w for r in rows) - 1) > 1e-4


def test_manifest(spark):
    df = spark.createDataFrame([(1.0, 0, True, "t", 5, 7.0), (2.0, 0, False, "u", 6, 7.0)], "fee double, zero int, is_x boolean, txid string, batch_id int, same double")
    m = manifest.build_manifest(df)
    assert m.features == ("fee", "is_x") and m.all_zero == ("zero",) and m.near_constant == ("same",) and m.artifacts == ("batch_id",) and m.total_rows == 2


def test_agreement_of_equal_and_constant_labels(spark):
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "a int, b int")
    assert math.isclose(one(metrics.normalised_information(same, "a", "b"))[1], 1.0)
    flat = spark.createDataFrame([(1, 1)] * 3, "a int, b int")
    assert one(metrics.normalised_information(flat, "a", "b"))[1] == 1.0


def test_flag_is_strictly_above(spark):
    df = spark.createDataFrame([(1.0,)] * 20 + [(None,), (float("nan"),)], "s double")
    assert report.anomaly_flag(df, "s").agg(F.sum("flag")).first()[0] == 0


def test_neighbours_exclude_self_by_key(spark):
    df = spark.createDataFrame([(i, [0.0, 0.0] if i < 3 else [1.0, 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = {r.src: r.dst for r in neighbours.k_nearest(df, df, 1).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0}


def test_neighbours_of_blocks_are_those_of_all_rows(spark):
    x = np.random.default_rng(3).integers(0, 4, (60, 3)).astype(float)  # with ties and equal rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    d = neighbours.distances(x, x)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), r + 1) for i in range(60) for r, j in enumerate(np.argsort(d[i], kind="stable")[:4])}
    for block in (7, 1000):
        assert {(r.src, r.dst, r.rank) for r in neighbours.k_nearest(df, df, 4, block=block).collect()} == want
    assert neighbours.k_nearest(df, df.where("vec_id < 3"), 4, block=7).count() == 57 * 3 + 3 * 2
    assert neighbours.k_nearest(df.where("false"), df, 4).count() == 0 and neighbours.k_nearest(df, df.where("false"), 4).count() == 0


def test_graphs_and_propagation_take_all_rows(spark, tmp_path):
    n = vector_queries.SAMPLE + 100
    x = np.random.default_rng(5).normal(size=(n, 8))
    spark.createDataFrame([(i, v.tolist(), f"c{i % 3}") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    d = f"file://{tmp_path}"
    assert vector_queries.knn_graph(spark, d).groupBy("src").count().where(f"count = {vector_queries.K}").count() == n
    assert vector_queries.normalised_laplacian(spark, d).where("src = dst").count() == n
    refs = vector_queries.vectors(spark, d).where(resample.split_of("vec_id", {"ref": 0.2, "rest": 0.8}, 7) == "ref").count()
    assert vector_queries.nearest_propagation(spark, d).count() == n - refs


def test_small_families_of_large_tables_get_seeds(spark, stage):
    n, rare = 30_000, 600  # the rare family has 500 rows of all, but not of a sample
    profile = F.when(F.col("id") % (n // rare) == 0, "Rare").otherwise("Common")
    x = F.when(profile == "Rare", F.array(F.lit(6.0), F.lit(6.0))).otherwise(F.array(F.lit(0.0), F.col("id") % 2 * 4.0))
    frame = stage.put(spark.range(n).select(F.col("id").cast("string").alias("_rid"), profile.alias("profile"), x.alias("x")))
    assert pipeline.seed_allocation(frame, 2)[0] == {"Common": 1, "Rare": 1}
    sizes = pipeline.seeded_labels(frame, stage, 2).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in sizes) == [rare, n - rare]


def test_whitening_and_scatter_take_the_whole_vector(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 5
    spark.createDataFrame([(i, v.tolist(), f"c{i % 3}") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    d = f"file://{tmp_path}"
    white = np.array([r.whitened for r in vector_queries.pca_whiten(spark, d).collect()])
    assert white.shape == (300, 12) and np.allclose(np.cov(white.T), np.eye(12))
    v = vector_queries.vectors(spark, d)
    y = np.arange(300) % 3
    means = np.array([x[y == c].mean(0) for c in range(3)])
    within = (x - means[y]).T @ (x - means[y])
    between = sum(100 * np.outer(m - x.mean(0), m - x.mean(0)) for m in means)
    for r in vector_queries.scatter_matrices(v.withColumn("wt", F.lit(1.0)), "label", "wt", 12).collect():
        assert math.isclose(within[r.i, r.j], r.within, abs_tol=1e-6) and math.isclose(between[r.i, r.j], r.between, abs_tol=1e-6)


def test_gaps_are_those_of_the_given_vectors(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(60, 4)) + np.arange(60)[:, None] % 3 * 100  # three parts that share no edge
    spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = vector_queries.spectral_gaps(spark, f"file://{tmp_path}").first()
    assert got.n_dims == 10 and abs(got.min_value) < 1e-9 and got.gap_dim == 4


def test_resamples_are_of_the_surveyed_number(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(40, 4)) + np.arange(40)[:, None] % 2 * 9
    spark.createDataFrame([(i, v.tolist(), f"c{i % 2}") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    d = f"file://{tmp_path}"
    got = {r.metric: r for r in vector_queries.bootstrap_ci(spark, d).collect()}
    assert set(got) == {"silhouette", "davies_bouldin", "calinski_harabasz"}
    assert all(r.n_iterations == 200 and r.ci_low <= r["mean"] <= r.ci_high for r in got.values())
    got = vector_queries.permutation_p(spark, d).first()
    assert got.n_permutations == 300 and got.p_value < 0.01 and got.observed > 0.5


def test_stores(spark, tmp_path):
    store = tables.ResultStore(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("silhouette", 0.5, 0.4, 0.6, 10)], "metric string, mean double, ci_low double, ci_high double, n_iterations int")
    store.append("bootstrap_results", rows)
    store.append("bootstrap_results", rows)
    assert store.read("bootstrap_results").count() == 2
    tables.write_manifest(spark, f"file://{tmp_path}/m", {"a": [1]})
    assert tables.read_manifest(spark, f"file://{tmp_path}/m") == {"a": [1]}
    tables.write_csv(rows, f"file://{tmp_path}/csv")
    assert tables.read_csv(spark, f"file://{tmp_path}/csv", rows.schema).count() == 1
    assert tables.first_existing(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/csv").endswith("csv")
