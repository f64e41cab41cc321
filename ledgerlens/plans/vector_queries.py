"""Queries on vectors: graphs, centres, clusterings and their quality, each with its SQL where there is one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import bounded, graph, kmeans, linalg, metrics, mixture, resample, rules
from ledgerlens.operators.skew import quantile_row
from ledgerlens.operators.neighbours import k_nearest, reference_matrix
from ledgerlens.plans.transactions import FLAGS, transactions
from ledgerlens.sources.tables import Stage, read_table

QUERIES, SQL = {}, {}
K = 15  # neighbours, as surveyed
SAMPLE = 2_000  # rows of the bounded samples that pairwise steps take; the same hash order at every scale
COMPARED, SCORED = 10_000, 60_000  # the surveyed samples: of method comparisons, and of silhouettes
POOL = 200_000  # rows that resamples are drawn from, as surveyed
METRICS = ["silhouette", "davies_bouldin", "calinski_harabasz"]
INFORMED = 5_000  # the survey's bound of the neighbour estimator on the driver


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


def sample(spark: SparkSession, d: str, rows: int = SAMPLE) -> DataFrame:
    """A sample of fixed size, by hash, for operators that work on samples by definition."""
    return vectors(spark, d).orderBy(resample.hash_key("vec_id", 42), "vec_id").limit(rows)


E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT * FROM e)"
NN = f"{E}, nn AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.v, b.v) AS dist FROM s a JOIN s b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY dist, b.vec_id) <= {K})"
EDGES = f"""{NN}, s2 AS (SELECT greatest(avg(dist * dist) FILTER (dist > 0), 0.01) AS s2 FROM nn), w1 AS (SELECT src, dst, exp(-dist * dist / s2) AS w FROM nn, s2),
    edges AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM w1 UNION ALL SELECT dst, src, w FROM w1) GROUP BY ALL), deg AS (SELECT src AS node, sum(w) AS g FROM edges GROUP BY 1)"""
LAP = f"{EDGES}, lap AS (SELECT node AS src, node AS dst, 1.0::DOUBLE AS val FROM deg UNION ALL SELECT src, dst, -w / sqrt(a.g * b.g) FROM edges JOIN deg a ON src = a.node JOIN deg b ON dst = b.node)"
VALS = "vals AS (SELECT vec_id AS node, unnest(range(8)) AS dim, unnest(v[1:8]) AS val FROM s)"
CENT = f"{E}, long AS (SELECT vec_id, label, unnest(range(len(v))) AS dim, unnest(v) AS x FROM e), cent AS (SELECT label, dim, avg(x) AS val FROM long GROUP BY ALL), cv AS (SELECT label, list(val ORDER BY dim) AS c FROM cent GROUP BY 1)"


def _neighbours(spark, d):
    v = vectors(spark, d)
    return k_nearest(v, v, K)


def _edges(spark, d):
    """Staged twice: the search runs once, however often the graph is read."""
    stage = Stage(spark)
    return stage.put(graph.similarity_edges(stage.put(_neighbours(spark, d))))


def _values(spark, d, dims: int = 8):
    return vectors(spark, d).select(F.col("vec_id").alias("node"), F.posexplode(F.slice("embedding", 1, dims)).alias("dim", "val"))


@query(f"WITH {NN} SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS INT) AS rank, round(dist, 6) AS dist FROM nn")
def knn_graph(spark, d):
    return _neighbours(spark, d).withColumn("dist", F.round("dist", 6))


@query(f"WITH {EDGES} SELECT src, dst, round(w, 6) AS w FROM edges")
def symmetrised_edges(spark, d):
    return _edges(spark, d).withColumn("w", F.round("w", 6))


@query(f"WITH {LAP} SELECT src, dst, round(val, 6) AS val FROM lap")
def normalised_laplacian(spark, d):
    return graph.normalised_laplacian(_edges(spark, d)).withColumn("val", F.round("val", 6))


@query(f"""WITH {EDGES}, {VALS}, n AS (SELECT dim, sum(w * (a.val - b.val) * (a.val - b.val)) / 2 AS en FROM edges JOIN vals a ON src = a.node JOIN vals b USING (dim) WHERE dst = b.node GROUP BY 1),
    q AS (SELECT dim, sum(g) AS sd, sum(g * val) AS sf, sum(g * val * val) AS sff FROM vals JOIN deg USING (node) GROUP BY 1)
    SELECT CAST(dim AS INT) AS dim, round(en / (sff - sf * sf / sd), 6) AS laplacian_score FROM n JOIN q USING (dim)""")
def laplacian_score(spark, d):
    return graph.laplacian_scores(_edges(spark, d), _values(spark, d)).withColumn("laplacian_score", F.round("laplacian_score", 6))


@query(f"""WITH {LAP}, {VALS}, n AS (SELECT dim, sum(lap.val * a.val * b.val) AS t FROM lap JOIN vals a ON src = a.node JOIN vals b USING (dim) WHERE dst = b.node GROUP BY 1), q AS (SELECT dim, sum(val * val) AS n FROM vals GROUP BY 1)
    SELECT CAST(dim AS INT) AS dim, round(t / (q.n + 1e-12), 6) AS rayleigh FROM n JOIN q USING (dim)""")
def rayleigh(spark, d):
    lap = graph.normalised_laplacian(_edges(spark, d))
    return graph.rayleigh_quotients(lap, _values(spark, d)).withColumn("rayleigh", F.round("rayleigh", 6))


_PART = "CAST('0x' || substr(md5('7|' || vec_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"WITH {E}, p AS (SELECT *, {_PART} < 0.2::DOUBLE AS ref FROM s) SELECT a.vec_id, b.vec_id AS source_id, b.label FROM p a JOIN p b ON b.ref WHERE NOT a.ref QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) = 1")
def nearest_propagation(spark, d):
    """Rows outside of the fitted sample take the label of its nearest row."""
    s = vectors(spark, d)
    ref = s.where(resample.split_of("vec_id", {"ref": 0.2, "rest": 0.8}, 7) == "ref")
    rest = s.join(ref.select("vec_id"), "vec_id", "left_anti")
    near = k_nearest(rest, ref, 1)
    return near.join(ref.select(F.col("vec_id").alias("dst"), "label"), "dst").select(F.col("src").alias("vec_id"), F.col("dst").alias("source_id"), "label")


@query(f"WITH {E}, g AS (SELECT vec_id, v FROM s WHERE {_PART} < 0.9::DOUBLE), r AS (SELECT * FROM s ANTI JOIN g USING (vec_id)) SELECT count(*) AS n_edges, round(sum(0.01::DOUBLE), 6) AS weight FROM (SELECT vec_id FROM r UNION ALL SELECT vec_id FROM r)")
def rescued_isolated(spark, d):
    """Edges added for nodes without one."""
    s = vectors(spark, d)
    inside = s.where(resample.split_of("vec_id", {"in": 0.9, "out": 0.1}, 7) == "in")
    edges = inside.select(F.col("vec_id").alias("src"), F.col("vec_id").alias("dst"), F.lit(1.0).alias("w"))
    out = graph.rescue_isolated(edges, s.select("vec_id"), s)
    return out.where("w < 1").agg(F.count("*").alias("n_edges"), F.round(F.sum("w"), 6).alias("weight"))


@query(f"WITH {E}, t AS (SELECT unnest(range(8)) + 1 AS dim, unnest(v[1:8]) AS x FROM e), v AS (SELECT dim, var_pop(x) AS eigenvalue FROM t GROUP BY 1), g AS (SELECT *, coalesce(eigenvalue - lag(eigenvalue) OVER (ORDER BY dim), 0) AS gap FROM v) SELECT count(*) AS n_dims, round(min(eigenvalue), 6) AS min_value, round(max(eigenvalue), 6) AS max_value, round(avg(eigenvalue), 6) AS mean_value, round(max(gap), 6) AS max_gap, CAST(arg_max(dim, (gap, -dim)) AS INT) AS gap_dim FROM g")
def eigengap_summary(spark, d):
    """The gap summary of a spectrum that SQL has as well, the variances of the first coordinates; ``spectral_gaps`` has the graph's own."""
    x = vectors(spark, d).select(F.posexplode(F.slice("embedding", 1, 8)).alias("dim", "x"))
    values = x.groupBy((F.col("dim") + 1).cast("int").alias("dim")).agg(F.var_pop("x").alias("eigenvalue"))
    return graph.eigengap_summary(values).select("n_dims", *[F.round(c, 6).alias(c) for c in ("min_value", "max_value", "mean_value", "max_gap")], "gap_dim")


@query(f"WITH {CENT} SELECT label, CAST(dim AS INT) AS dim, round(val, 6) AS val FROM cent")
def centroids(spark, d):
    return kmeans.centroids(vectors(spark, d), "label").withColumn("val", F.round("val", 6))


@query(f"WITH {CENT} SELECT vec_id, cv.label AS centre, round(list_distance(v, c), 6) AS dist FROM e, cv")
def centre_distances(spark, d):
    """Distances of every row to all centres, in Spark's own arrays: centres are a few rows."""
    v = vectors(spark, d)
    c = kmeans.centroids(v, "label").groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "val"))), lambda x: x["val"]).alias("c"))
    d2 = F.aggregate(F.zip_with("embedding", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return v.drop("label").join(F.broadcast(c), how="cross").select("vec_id", F.col("label").alias("centre"), F.round(F.sqrt(d2), 6).alias("dist"))


_ASSIGN = f"{CENT}, ids AS (SELECT label, c, row_number() OVER (ORDER BY label) - 1 AS k FROM cv), best AS (SELECT vec_id, k, list_distance(v, c) AS dist FROM e, ids QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, k) = 1)"


@query(f"WITH {_ASSIGN} SELECT vec_id, CAST(k AS INT) AS cluster, round(dist, 6) AS dist FROM best")
def kmeans_assign(spark, d):
    v = vectors(spark, d)
    return kmeans.assign(v, kmeans.centre_matrix(v, "label")[1]).withColumn("dist", F.round("dist", 6))


@query(f"WITH {_ASSIGN} SELECT CAST(k AS INT) AS cluster, CAST(dim AS INT) AS dim, round(avg(x), 6) AS val FROM long JOIN best USING (vec_id) GROUP BY ALL")
def kmeans_one_step(spark, d):
    v = vectors(spark, d)
    new, _ = kmeans.step(v, kmeans.centre_matrix(v, "label")[1])
    rows = [(c, j, round(float(x), 6)) for c, r in enumerate(new) for j, x in enumerate(r)]
    return spark.createDataFrame(rows, "cluster int, dim int, val double")


_D4 = "l4 AS (SELECT vec_id, label, 1.0::DOUBLE + vec_id % 3 AS wt, unnest(range(4)) AS dim, unnest(v[1:4]) AS x FROM e), m AS (SELECT label, dim, sum(wt * x) / sum(wt) AS mu, sum(wt) AS n FROM l4 GROUP BY ALL), g AS (SELECT dim, sum(wt * x) / sum(wt) AS mu FROM l4 GROUP BY 1)"


def scatter_matrices(df: DataFrame, label: str, weight: str, dims: int) -> DataFrame:
    """(i, j, within, between): weighted scatter of classes of at least two rows and some weight, over the first dims."""
    long = df.select("vec_id", label, weight, F.posexplode(F.slice("embedding", 1, dims)).alias("dim", "x"))
    own = long.groupBy(label, "dim").agg((F.sum(F.col(weight) * F.col("x")) / F.sum(weight)).alias("mu"), F.sum(weight).alias("sw"), F.count("*").alias("n")).where("n >= 2 and sw > 1e-8")
    centred = long.join(F.broadcast(own), [label, "dim"]).select("vec_id", label, weight, "dim", (F.col("x") - F.col("mu")).alias("r"))
    # a row's few coordinates side by side, then the products within the row: no join
    rows = centred.groupBy("vec_id", label, weight).agg(F.sort_array(F.collect_list(F.struct("dim", "r"))).alias("a"))
    pairs = rows.select(weight, F.explode("a").alias("p"), "a").select(weight, "p", F.explode("a").alias("q"))
    within = pairs.groupBy(F.col("p.dim").alias("i"), F.col("q.dim").alias("j")).agg(F.sum(F.col(weight) * F.col("p.r") * F.col("q.r")).alias("within"))
    grand = own.groupBy("dim").agg((F.sum(F.col("mu") * F.col("sw")) / F.sum("sw")).alias("gm"))
    dev = own.join(F.broadcast(grand), "dim").select(label, "dim", "sw", (F.col("mu") - F.col("gm")).alias("r"))
    other = dev.select(label, F.col("dim").alias("j"), F.col("r").alias("r2"))
    between = dev.join(other, label).groupBy(F.col("dim").alias("i"), "j").agg(F.sum(F.col("sw") * F.col("r") * F.col("r2")).alias("between"))
    return within.join(between, ["i", "j"])


@query(f"""WITH {E}, {_D4}, c AS (SELECT vec_id, label, wt, dim, x - mu AS r FROM l4 JOIN m USING (label, dim)),
    sw AS (SELECT a.dim AS i, b.dim AS j, sum(a.wt * a.r * b.r) AS w FROM c a JOIN c b USING (vec_id) GROUP BY ALL),
    dv AS (SELECT label, dim, n, m.mu - g.mu AS r FROM m JOIN g USING (dim)), sb AS (SELECT a.dim AS i, b.dim AS j, sum(a.n * a.r * b.r) AS b FROM dv a JOIN dv b USING (label) GROUP BY ALL)
    SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(w, 6) AS within, round(b, 6) AS between FROM sw JOIN sb USING (i, j)""")
def weighted_scatter(spark, d):
    out = scatter_matrices(vectors(spark, d).withColumn("wt", F.lit(1.0) + F.col("vec_id") % 3), "label", "wt", 4)
    return out.select("i", "j", F.round("within", 6).alias("within"), F.round("between", 6).alias("between"))


@query(f"""WITH {CENT}, dd AS (SELECT vec_id, list_sort(list(list_distance(v, c))) AS q FROM e, cv GROUP BY 1), mg AS (SELECT vec_id, (q[2] - q[1]) / greatest(q[2], 1e-6) AS m FROM dd),
    p AS (SELECT quantile_cont(m, 0.3) AS f, max(m) AS t FROM mg) SELECT vec_id, round(m, 6) AS margin, round(least(greatest((m - f) / greatest(t - f, 1e-12), 0), 1) + 0.05, 6) AS confidence FROM mg, p""")
def confidence_weights(spark, d):
    """How much nearer the nearest centre is than the second, above the 30 % quantile."""
    v = vectors(spark, d)
    names, centres = kmeans.centre_matrix(v, "label")
    far = F.array(*[F.sqrt(F.aggregate(F.zip_with("embedding", F.lit(c.tolist()), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)) for c in centres])
    m = v.select("vec_id", F.array_sort(far).alias("q")).select("vec_id", ((F.col("q")[1] - F.col("q")[0]) / F.greatest(F.col("q")[1], F.lit(1e-6))).alias("m"))
    p = quantile_row(m, ["m"], [0.3, 1.0]).select(F.col("m")[0].alias("f"), F.col("m")[1].alias("t"))
    c = F.least(F.greatest((F.col("m") - F.col("f")) / F.greatest(F.col("t") - F.col("f"), F.lit(1e-12)), F.lit(0.0)), F.lit(1.0)) + 0.05
    return m.join(F.broadcast(p), how="cross").select("vec_id", F.round("m", 6).alias("margin"), F.round(c, 6).alias("confidence"))


@query(f"""WITH {E}, p AS (SELECT a.vec_id, a.label, b.label AS other, avg(list_distance(a.v, b.v)) AS m FROM s a JOIN s b ON a.vec_id <> b.vec_id GROUP BY ALL),
    q AS (SELECT vec_id, max(m) FILTER (label = other) AS a, min(m) FILTER (label <> other) AS b FROM p GROUP BY 1) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM q""")
def silhouette(spark, d):
    return metrics.silhouette(sample(spark, d, SCORED), "label", limit=SCORED).select(F.round("silhouette", 6).alias("silhouette"))


_SPREAD = f"{CENT}, dc AS (SELECT vec_id, label, list_distance(v, c) AS r FROM e JOIN cv USING (label)), sp AS (SELECT label, count(*) AS n, avg(r) AS s, sum(r * r) AS ss FROM dc GROUP BY 1)"


@query(f"WITH {_SPREAD}, r AS (SELECT a.label, max((x.s + y.s) / list_distance(a.c, b.c)) AS r FROM cv a JOIN cv b ON a.label <> b.label JOIN sp x ON x.label = a.label JOIN sp y ON y.label = b.label GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def davies_bouldin(spark, d):
    return metrics.davies_bouldin(vectors(spark, d), "label").select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(f"WITH {_SPREAD}, w AS (SELECT sum(ss) AS w, sum(n) AS n, count(*) AS k FROM sp), t AS (SELECT sum(vp) AS t FROM (SELECT var_pop(x) * count(*) AS vp FROM long GROUP BY dim)) SELECT round((t - w) / (k - 1) / (w / (n - k)), 6) AS calinski_harabasz FROM w, t")
def calinski_harabasz(spark, d):
    return metrics.calinski_harabasz(vectors(spark, d), "label").select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


# --- without SQL: iterative or random steps, tested against brute force and invariants


@query()
def seeded_kmeans(spark, d):
    """Clusters grown from the labels' means."""
    v = vectors(spark, d)
    return kmeans.assign(v, kmeans.seeded_kmeans(v, kmeans.centre_matrix(v, "label")[1], 15)[0])


@query()
def ward_guided_kmeans(spark, d):
    """Centres of micro-clusters merged by Ward, blended with the labels' means, then refined."""
    v = vectors(spark, d)
    names, seeds = kmeans.centre_matrix(v, "label")
    guided = linalg.ward_guided_centres(kmeans.plain_kmeans(v, 40, iterations=10), len(names))
    return kmeans.assign(v, kmeans.seeded_kmeans(v, kmeans.blend(seeds, guided), 10)[0])


@query()
def ward_clusters(spark, d):
    ids, x = reference_matrix(sample(spark, d, COMPARED), "vec_id", "embedding")
    return spark.createDataFrame(pd.DataFrame({"vec_id": ids, "cluster": linalg.ward(x, 10).astype(np.int32)}))


@query()
def density_clusters(spark, d):
    ids, x = reference_matrix(sample(spark, d, COMPARED).where("label is not null"), "vec_id", "embedding")
    return spark.createDataFrame(pd.DataFrame({"vec_id": ids, "cluster": linalg.density_clusters(x, 10, 5).astype(np.int32)}))


@query()
def gmm_diag(spark, d):
    v = vectors(spark, d)
    means, var, weight, _ = mixture.diagonal_mixture(v, kmeans.centre_matrix(v, "label")[1], 10)
    return mixture.assign_mixture(v, means, var, weight)


@query()
def iforest_scores(spark, d):
    """Isolation scores of all rows; trees are grown on a bounded sample."""
    forest = spark.sparkContext.broadcast(linalg.IsolationForest(bounded.matrix(sample(spark, d, POOL), "embedding"), 200))

    def score(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "score": forest.value.score(np.stack(pdf["embedding"].to_numpy()))})

    return vectors(spark, d).select("vec_id", "embedding").mapInPandas(score, "vec_id bigint, score double")


def _spectrum(spark, d, dims: int = 10):
    """Nodes, eigenvalues and eigenvectors of the sample's graph."""
    s = sample(spark, d)
    edges = graph.normalised_laplacian(graph.similarity_edges(k_nearest(s, s, K))).toPandas()  # K edges a row of the bounded sample
    ids = np.unique(edges["src"])
    at = {v: i for i, v in enumerate(ids)}
    return ids, *linalg.spectral_embedding(edges["src"].map(at).to_numpy(), edges["dst"].map(at).to_numpy(), edges["val"].to_numpy(), dims)


@query()
def spectral(spark, d):
    """Spectral embedding of the sample's graph: node, dim, value."""
    ids, _, v = _spectrum(spark, d)
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.repeat(ids, 10), "dim": np.tile(np.arange(10, dtype=np.int32), len(ids)), "val": v.ravel()}))


def moments(df: DataFrame, mean: np.ndarray, vector: str = "embedding") -> np.ndarray:
    """Sum over all rows of the products of all pairs of coordinates less their mean. Partial sums of a partition are d x d."""
    dim = len(mean)
    shared = df.sparkSession.sparkContext.broadcast(mean)

    def partial(batches):
        total = np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()) - shared.value
                total += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(dim), dim), "j": np.tile(np.arange(dim), dim), "s": total.ravel()})

    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("x"))
    out = np.zeros((dim, dim))
    for r in rows.mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # d x d
        out[r.i, r.j] = r.s
    return out


@query()
def spectral_gaps(spark, d):
    """The summary of the gaps between the eigenvalues that the embedding has."""
    values = [(i + 1, float(x)) for i, x in enumerate(_spectrum(spark, d)[1])]
    return graph.eigengap_summary(spark.createDataFrame(values, "dim int, eigenvalue double"))


@query()
def scree(spark, d):
    """(dim, eigenvalue, gap): the table behind the scree plot."""
    values = _spectrum(spark, d)[1]
    return spark.createDataFrame([(i + 1, float(x), float(x - values[i - 1]) if i else 0.0) for i, x in enumerate(values)], "dim int, eigenvalue double, gap double")


@query()
def layout_2d(spark, d):
    """(vec_id, x, y): a neighbour-graph layout of a sample, for display; other rows lie at the mean of their nearest sampled rows."""
    stage = Stage(spark)
    s = stage.put(sample(spark, d).select("vec_id", "embedding"))
    ids, x = reference_matrix(s, "vec_id", "embedding")
    placed = stage.put(spark.createDataFrame(pd.DataFrame({"vec_id": ids, "x": (y := bounded.layout(x))[:, 0], "y": y[:, 1]})))
    rest = vectors(spark, d).select("vec_id", "embedding").join(F.broadcast(placed.select("vec_id")), "vec_id", "left_anti")  # of SAMPLE rows
    near = k_nearest(rest, s, K).join(F.broadcast(placed.withColumnRenamed("vec_id", "dst")), "dst")
    return placed.unionByName(near.groupBy(F.col("src").alias("vec_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")))


@query()
def pca_whiten(spark, d):
    """Whitened coordinates of the whole vector: moments are aggregated over all rows, the d x d step runs on the driver."""
    v = vectors(spark, d)
    dim = v.agg(F.max(F.size("embedding"))).first()[0]
    row = v.agg(F.count("embedding").alias("n"), *[F.avg(F.col("embedding")[i]).alias(f"m{i}") for i in range(dim)]).first()
    mean = np.array([row[f"m{i}"] for i in range(dim)])
    shared = spark.sparkContext.broadcast(linalg.whiten_from_moments(mean, moments(v, mean) / max(1, row["n"] - 1)))

    def whiten(batches):
        mean, m = shared.value
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "whitened": list((np.stack(pdf["embedding"].to_numpy()) - mean) @ m)})

    return v.select("vec_id", "embedding").mapInPandas(whiten, "vec_id bigint, whitened array<double>")


@query("SELECT CAST(i AS INT) AS dim, 0.0::DOUBLE AS off_mean, 1.0::DOUBLE AS variance FROM range(64) t(i)")
def whitened_moments(spark, d):
    """Mean and variance of every whitened coordinate, over all rows."""
    long = pca_whiten(spark, d).select(F.posexplode("whitened").alias("dim", "x"))
    return long.groupBy("dim").agg(F.round(F.abs(F.avg("x")), 6).alias("off_mean"), F.round(F.var_samp("x"), 6).alias("variance"))


def _pool(spark, d, n: int):
    """Vectors and labels that resamples are drawn from, and one row a run."""
    rows = sample(spark, d, POOL).where("label is not null").select("embedding", "label").toArrow()
    x = np.asarray(rows.column(0).combine_chunks().flatten(), np.float64).reshape(rows.num_rows, -1)
    return spark.sparkContext.broadcast((x, np.unique(rows.column(1).to_pylist(), return_inverse=True)[1])), spark.range(n, numPartitions=min(n, 100))


@query()
def bootstrap_ci(spark, d, runs: int = 200, size: int = 5_000):
    """Mean and 95 % interval of the three metrics over bootstrap samples."""
    shared, it = _pool(spark, d, runs)

    def run(batches):
        x, y = shared.value
        for pdf in batches:
            draws = [np.random.default_rng(1000 + i).choice(len(x), min(size, len(x))) for i in pdf["id"]]
            yield pd.DataFrame([bounded.scores(x[at], y[at]) for at in draws], columns=METRICS)

    s = it.mapInPandas(run, ", ".join(f"{m} double" for m in METRICS)).unpivot([], METRICS, "metric", "value")
    return s.groupBy("metric").agg(F.avg("value").alias("mean"), F.percentile("value", 0.025).alias("ci_low"), F.percentile("value", 0.975).alias("ci_high"), F.count("*").cast("int").alias("n_iterations"))


@query()
def permutation_p(spark, d, runs: int = 300, size: int = 5_000):
    """Share of label permutations whose silhouette reaches the observed one."""
    shared, it = _pool(spark, d, runs + 1)

    def run(batches):
        x, y = shared.value
        at = np.random.default_rng(0).permutation(len(x))[:size]  # the pool is in key order
        x, y = x[at], y[at]
        for pdf in batches:
            yield pd.DataFrame({"run": pdf["id"], "silhouette": [bounded.scores(x, y if i == 0 else np.random.default_rng(i).permutation(y))["silhouette"] for i in pdf["id"]]})

    s = it.mapInPandas(run, "run bigint, silhouette double")
    obs = s.where("run = 0").select(F.col("silhouette").alias("observed"))
    null = s.where("run > 0").join(F.broadcast(obs), how="cross")
    return null.agg(F.first("observed").alias("observed"), F.avg("silhouette").alias("null_mean"), F.stddev_pop("silhouette").alias("null_std"), F.avg((F.col("silhouette") >= F.col("observed")).cast("double")).alias("p_value"), F.count("*").cast("int").alias("n_permutations"))


@query()
def ami(spark, d):
    """Adjusted mutual information of clusters and profile families; the contingency table is clusters x families."""
    df = read_table(spark, d, "results_labeled").withColumn("family", F.regexp_replace("tx_profile", r"_\d+$", ""))
    t = metrics.contingency(df, "cluster_id", "family").toPandas().pivot(index="cluster_id", columns="family", values="n").fillna(0).to_numpy()
    return spark.createDataFrame([(linalg.adjusted_information(t),)], "ami double")


@query()
def rule_tree(spark, d):
    """Scores of a depth-5 tree that predicts the rule label from the flags, on held-out rows."""
    df = transactions(spark, d)
    rows = df.select("_rid", rules.first_match(df.columns).alias("profile"), *[F.col(c).cast("double").alias(c) for c in FLAGS], resample.split_of("_rid", {"train": 0.7, "test": 0.3}).alias("part"))
    steps = Pipeline(stages=[StringIndexer(inputCol="profile", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep"), VectorAssembler(inputCols=FLAGS, outputCol="x"), DecisionTreeClassifier(labelCol="y", featuresCol="x", maxDepth=5, impurity="gini", minInstancesPerNode=1)])
    model = steps.fit(rows.where("part = 'train'"))
    return metrics.classification_scores(model.transform(rows.where("part = 'test'")), "y", "prediction")


@query()
def knn_information(spark, d):
    """Mutual information of amounts and the rule label's rank, by nearest neighbours on a bounded sample."""
    df = transactions(spark, d)
    s = df.select("_rid", F.log1p(F.greatest("fee", F.lit(0.0))).alias("fee"), F.log1p(F.greatest("total_output_value", F.lit(0.0))).alias("total_output_value"), rules.first_match(df.columns).alias("profile")).where("fee is not null and total_output_value is not null").orderBy(resample.hash_key("_rid", 42)).limit(INFORMED).toPandas()
    y = s["profile"].astype("category").cat.codes.to_numpy(float)
    return spark.createDataFrame([(c, linalg.neighbour_information(s[c].to_numpy(), y)) for c in ("fee", "total_output_value")], "feature string, mi_score double")
