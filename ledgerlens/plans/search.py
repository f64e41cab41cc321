"""Searches over clusterings and metrics, and their validation, on the engine's own features.

What is compared pairwise or refitted many times is a sample of a fixed size, the surveyed one or else the whole table; labels of all rows
come from the pipeline. Nothing is read from literals: ranks, winners and differences are those of the clusterings made here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import bounded, compare, graph, linalg, resample
from ledgerlens.plans.pipeline import CLUSTERS, anomaly_scores, feature_frame, seeded_labels
from ledgerlens.plans.transactions import AMOUNTS, COUNTS, FLAGS
from ledgerlens.sources.tables import Stage

FIT, METRIC_FIT, ANCHOR_FIT = 500_000, 90_000, 250_000  # the surveyed samples
COMPARED, ABLATED, CONTEXT = 10_000, 20_000, 120_000
EVALUATED = 10_000  # rows of a validation split on which pairwise scores are taken
SEEDS = (11, 22, 33, 44, 55)
PART = 65_536  # rows fetched at once
METRICS = ["silhouette", "davies_bouldin", "calinski_harabasz"]
_ROW = "name string, silhouette double, davies_bouldin double, calinski_harabasz double"


def first_by_hash(frame: DataFrame, rows: int, seed: int) -> Iterator[pa.Table]:
    """The ``rows`` rows of the least hash of ``_rid``, in its order, in parts of about ``PART`` rows. What is fetched is only those below a
    bound that some more rows than asked for are expected to meet, and the rest if they turn out to be fewer."""
    n = frame.count()
    left, top = min(rows, n), 16**8
    keyed = frame.withColumn("_rid", resample.hash_key("_rid", seed))
    share = min(1.0, (left + 6 * left**0.5 + 100) / max(n, 1))
    parts = max(1, -(-left // PART))
    cuts = [int(share * top * i / parts) for i in range(parts + 1)]
    for low, high in zip(cuts, cuts[1:] + [top]):  # the last is empty where the share is 1
        if low and left <= 0:
            return
        own = keyed.where(F.col("_rid") >= f"{low:08x}")
        table = (own.where(F.col("_rid") < f"{high:08x}") if high < top else own).toArrow()
        yield table.take(pc.sort_indices(table, [("_rid", "ascending")])[: max(left, 0)]).drop_columns("_rid")
        left -= len(table)


class Space:
    """A sample of the feature frame as arrays: standardised features, rule labels, flags, and columns joined to it."""

    def __init__(self, frame: DataFrame, rows: int, seed: int = 42):
        columns = ["x", "profile", *FLAGS, *[c for c in ("raw", "cluster", "flag") if c in frame.columns]]
        found: dict[str, list[np.ndarray]] = {c: [] for c in columns}
        for table in first_by_hash(frame.select("_rid", *columns), rows, seed):
            for c in columns:
                own = table.column(c).combine_chunks()
                if c in ("x", "raw"):
                    found[c].append(np.array(own.flatten(), np.float64).reshape(len(own), -1))
                elif c == "profile":
                    own = own.dictionary_encode()
                    found[c].append(np.array(own.dictionary.to_pylist(), str)[own.indices.to_numpy()] if len(own) else np.empty(0, str))
                else:
                    found[c].append(own.to_numpy(zero_copy_only=False).astype(np.int8) if c in FLAGS else own.to_numpy(zero_copy_only=False).copy())
            del table, own
        whole = lambda c: np.concatenate(found.pop(c)) if c in found else None
        self.x = bounded.standard(whole("x"))
        self.raw = bounded.standard(whole("raw")) if "raw" in found else self.x
        self.profile, self.flags = whole("profile"), np.column_stack([whole(c) for c in FLAGS])
        self.cluster, self.anomaly = whole("cluster"), whole("flag")

    def split(self, held: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
        order = np.random.default_rng(seed).permutation(len(self.x))
        return order[held:], order[:held]


def _rows(spark: SparkSession, scored: dict[str, dict[str, float]]) -> DataFrame:
    return spark.createDataFrame([(n, *[float(s[m]) for m in METRICS]) for n, s in scored.items()], _ROW)


def search_metric(spark: SparkSession, x: np.ndarray, k: int, seed: int = 42) -> tuple[dict[str, np.ndarray], dict[str, dict[str, float]], dict[str, float]]:
    """Metrics by name, the scores of the clusters they give on held-out rows, and those of the teacher, k-means in the plain space."""
    order = np.random.default_rng(seed).permutation(len(x))
    held = min(8_000, max(50 * k, len(x) // 10), len(x) // 2)
    fit, val = x[order[held:]], x[order[:held]]
    with bounded.Shared(spark, fit) as fitted, bounded.Shared(spark, val) as judged:
        teacher = fitted.best_kmeans(k, 20, seed)[0]
        near = np.sort(np.sqrt(np.concatenate([bounded.squared(fit[i : i + 20_000], teacher) for i in range(0, len(fit), 20_000)])), axis=1)[:, :2]
        margin = (near[:, 1] - near[:, 0]) / np.maximum(near[:, 1], 1e-6)
        least = np.quantile(margin, 0.30)
        weight = np.clip((margin - least) / max(margin.max() - least, 1e-6), 0, 1) + 0.05
        within, between = weighted_scatter(fit, bounded.nearest(fit, teacher), weight)
        metrics = linalg.metric_grid(within, between)
        centres = fitted.best_kmeans(k, 10, seed, tuple(metrics.values()))
        *scored, taught = judged.run([*[(_judged, None, c, m) for m, c in zip(metrics.values(), centres)], (_judged, None, teacher)])
    return metrics, dict(zip(metrics, scored)), taught


def _judged(x: np.ndarray, centres: np.ndarray, m: np.ndarray | None = None) -> dict[str, float]:
    """Scores in the plain space of the labels that centres in the metric ``m`` give."""
    return bounded.scores(x, bounded.nearest(x if m is None else x @ m, centres))


def weighted_scatter(x: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within and between scatter per unit of weight, of classes of two rows and some weight."""
    d = x.shape[1]
    within, between, total = np.zeros((d, d)), np.zeros((d, d)), 0.0
    grand = weight @ x / weight.sum()
    for c in np.unique(labels):
        own = labels == c
        w = weight[own]
        if own.sum() < 2 or w.sum() <= 1e-8:
            continue
        mean = w @ x[own] / w.sum()
        r = x[own] - mean
        within += (r * w[:, None]).T @ r
        between += w.sum() * np.outer(mean - grand, mean - grand)
        total += w.sum()
    return within / total, between / total


def chosen(ranked: DataFrame) -> str:
    return ranked.where("place = 1").first()["name"]


def metric_search(spark: SparkSession, d: str, rows: int = METRIC_FIT, k: int = CLUSTERS) -> DataFrame:
    """Metrics learnt from a confident teacher's classes, all dimensions, by rank fusion against the teacher."""
    space = Space(feature_frame(spark, d, Stage(spark)), rows)
    _, scored, teacher = search_metric(spark, space.x, k)
    return compare.rank_candidates(_rows(spark, scored), teacher)


def metric_applied(spark: SparkSession, d: str, rows: int = METRIC_FIT, k: int = CLUSTERS) -> DataFrame:
    """(_rid, z): all rows in the metric that the search chooses: ((x - mean) / deviation) times its matrix."""
    frame = feature_frame(spark, d, Stage(spark))
    metrics, scored, teacher = search_metric(spark, Space(frame, rows).x, k)
    m = metrics[chosen(compare.rank_candidates(_rows(spark, scored), teacher))]
    dim = len(m)
    row = frame.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(dim) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, spread = (np.array([row[f"{n}{i}"] for i in range(dim)]) for n in "ms")
    shared = spark.sparkContext.broadcast((mean, np.where(spread > 0, spread, 1), m))  # d x d

    def turn(batches):
        mean, spread, m = shared.value
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"_rid": pdf["_rid"], "z": list(((np.stack(pdf["x"].to_numpy()) - mean) / spread) @ m)})

    return frame.select("_rid", "x").mapInPandas(turn, "_rid string, z array<double>")


def search_candidates(spark: SparkSession, space: Space, k: int, seed: int = 42) -> tuple[dict[str, dict[str, float]], dict[str, float]]:
    """Scores on held-out rows of seven clusterings, and of the baseline, the best of ten k-means.

    Four start from the rule families, from Ward's merged micro-clusters, or a blend of both; three do the same in the metric that the
    search finds, and are scored in the plain space. Runs that don't wait for each other are tasks of one job."""
    fit, val = space.split(min(50_000, len(space.x) // 5), seed)
    x, y = space.x[fit], space.x[val[:EVALUATED]]
    space.x = space.raw = None  # one copy of the sample is enough
    metrics, scored, _ = search_metric(spark, x[:METRIC_FIT], k, seed)
    order = sorted(scored, key=lambda n: (-scored[n]["silhouette"], n))
    m = metrics[order[0]]
    w = y @ m
    seeds = bounded.family_centres(x, space.profile[fit], k)
    with bounded.Shared(spark, x) as sample:
        (streamed, refined), guided, guided_z, *runs = sample.run([(_streamed, None, seeds, seed), (bounded.guided_centres, None, k), (bounded.guided_centres, m, k), *[(bounded.one_kmeans, turn, k, seed + s) for turn in (None, m) for s in range(10)]])
        plain, plain_z = bounded.least_inertia(runs[:10]), bounded.least_inertia(runs[10:])
        blend, ward, ward_z, blend_z = sample.run(
            [(bounded.stream_kmeans, None, bounded.blended(seeds, guided, 0.60), 20_000, 400, seed), (bounded.lloyd, None, guided, 120), (bounded.lloyd, m, guided_z, 120), (bounded.lloyd, m, bounded.blended(plain_z, guided_z, 0.50), 120)]
        )
    found = {
        "baseline": bounded.nearest(y, plain),
        "families streamed": bounded.nearest(y, streamed),
        "families refined": bounded.nearest(y, refined),
        "ward refined": bounded.nearest(y, ward),
        "blend streamed": bounded.nearest(y, blend),
        "metric plain": bounded.nearest(w, plain_z),
        "metric ward refined": bounded.nearest(w, ward_z),
        "metric blend refined": bounded.nearest(w, blend_z),
    }
    with bounded.Shared(spark, y) as sample:
        baseline, *judged = sample.run([(bounded.scores, None, labels) for labels in found.values()])
    return dict(zip(list(found)[1:], judged)), baseline


def _streamed(x: np.ndarray, seeds: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres streamed from the seeds, and these refined."""
    centres = bounded.stream_kmeans(x, seeds, steps=400, seed=seed)
    return centres, bounded.lloyd(x, centres, 120)


def candidate_search(spark: SparkSession, d: str, rows: int = FIT, k: int = CLUSTERS) -> DataFrame:
    """The seven candidates with their scores, ranks and places."""
    scored, baseline = search_candidates(spark, Space(feature_frame(spark, d, Stage(spark)), rows), k)
    return compare.rank_candidates(_rows(spark, scored), baseline)


def compared(spark: SparkSession, d: str, rows: int = COMPARED, k: int = CLUSTERS) -> DataFrame:
    """(name, n_clusters, scores...): seven methods on one stratified sample, scored in one space."""
    stage = Stage(spark)
    frame = feature_frame(spark, d, stage)
    labels = stage.put(seeded_labels(frame, stage, k).select("_rid", "cluster"))
    space = Space(frame.join(labels, "_rid"), 20 * rows)
    at = bounded.stratified(space.cluster, rows)
    x, k = space.x[at], min(k, len(at) - 1)
    start = bounded.spread_start(x, k, np.random.default_rng(42))
    density = bounded.attach_noise(x, linalg.density_clusters(x, max(min(200, len(x) // 10), len(x) // 200), 20))
    methods = {
        "seeded": space.cluster[at],
        "mini-batch": bounded.nearest(x, bounded.stream_kmeans(x, start)),
        "k-means": bounded.nearest(x, bounded.best_kmeans(x, k, 20)),
        "density": density,
        "mixture": bounded.mixture(x, bounded.best_kmeans(x, k, 1)),
        "ward-guided": bounded.nearest(x, bounded.lloyd(x, bounded.guided_centres(x, k), 120)),
        "ward": linalg.ward(x, k),
    }
    rows_ = [(n, int(len(np.unique(lab))), *[float(s[m]) for m in METRICS]) for n, lab in methods.items() for s in [bounded.scores(x, lab)]]
    return spark.createDataFrame(rows_, "name string, n_clusters int, silhouette double, davies_bouldin double, calinski_harabasz double")


def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Seven methods by three metrics."""
    return compared(spark, d)


def comparison_winners(spark: SparkSession, d: str) -> DataFrame:
    """The best method by each metric. A method with one cluster only has no scores and takes no part."""
    return compare.metric_winners(compared(spark, d).where(~F.isnan("silhouette")))


def ablation(spark: SparkSession, d: str, rows: int = ABLATED, k: int = CLUSTERS) -> DataFrame:
    """(condition, silhouette, davies_bouldin, calinski_harabasz, anomaly_rate): A without weights and seeds; B with weights; C from the rule
    flags' means, filled up with mini-batch centres; D as C, with the anomaly flag, which leaves the clusters as they are. All are scored in
    the weighted space."""
    stage = Stage(spark)
    frame = feature_frame(spark, d, stage, True)
    labels = stage.put(seeded_labels(frame, stage, k).select("_rid", "cluster"))
    scored = anomaly_scores(frame)
    from ledgerlens.operators.report import anomaly_flag

    flags = stage.put(anomaly_flag(scored, "anomaly_score").select("_rid", F.col("flag").cast("int").alias("flag")))
    space = Space(frame.join(labels, "_rid").join(flags, "_rid"), 10 * rows)
    at = bounded.stratified(space.cluster, rows, 55)
    x, raw, k = space.x[at], space.raw[at], min(k, len(at) - 1)
    rng = lambda: np.random.default_rng(42)
    stream = lambda data: min((bounded.stream_kmeans(data, bounded.spread_start(data, k, np.random.default_rng(42 + s)), seed=s) for s in range(10)), key=lambda c: bounded.squared(data, c).min(axis=1).sum())
    ruled = [FLAGS.index(c) for c in ("is_coinjoin_like", "is_batch_payment", "is_consolidation", "is_distribution", "is_peer_to_peer")]
    c = bounded.scores(x, bounded.nearest(x, bounded.stream_kmeans(x, bounded.flag_centres(x, space.flags[at][:, ruled], k))))
    found = [("A plain", bounded.scores(x, bounded.nearest(raw, stream(raw))), None), ("B weighted", bounded.scores(x, bounded.nearest(x, stream(x))), None), ("C rule seeds", c, None), ("D anomaly flag", c, float(space.anomaly[at].mean() * 100))]
    return spark.createDataFrame([(n, *[float(s[m]) for m in METRICS], r) for n, s, r in found], "condition string, silhouette double, davies_bouldin double, calinski_harabasz double, anomaly_rate double")


def ablation_deltas(spark: SparkSession, d: str) -> DataFrame:
    """(step, metric, old, new, delta, pct): what each component changes: B against A, C against B, D against A; pct is positive where better."""
    rows = Stage(spark).put(ablation(spark, d))
    long = rows.select(F.substring("condition", 1, 1).alias("c"), F.expr("stack(3, 'silhouette', silhouette, 'davies_bouldin', davies_bouldin, 'calinski_harabasz', calinski_harabasz) as (metric, value)"))
    steps = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "D")], "old_c string, new_c string")
    old, new = long.select(F.col("c").alias("old_c"), "metric", F.col("value").alias("old")), long.select(F.col("c").alias("new_c"), "metric", F.col("value").alias("new"))
    both = F.broadcast(steps).join(old, "old_c").join(new, ["new_c", "metric"])  # nine rows
    delta = F.col("new") - F.col("old")
    better = F.when(F.col("metric") == "davies_bouldin", -delta).otherwise(delta)
    return both.select(F.concat("new_c", F.lit("-"), "old_c").alias("step"), "metric", "old", "new", delta.alias("delta"), (F.try_divide(better, F.abs("old")) * 100).alias("pct"))


def context_runs(spark: SparkSession, d: str, seeds: tuple[int, ...] = SEEDS, rows: int = CONTEXT, k: int = CLUSTERS) -> DataFrame:
    """(seed, method, metrics...): the pipeline's labels and k-means of each sample, by agreement with the rules and by a tree on the flags."""
    stage = Stage(spark)
    frame = feature_frame(spark, d, stage)
    labels = stage.put(seeded_labels(frame, stage, k).select("_rid", "cluster"))
    joined = stage.put(frame.join(labels, "_rid"))
    out = []
    for seed in seeds:
        space = Space(joined, rows, seed)
        with bounded.Shared(spark, space.x) as sample:
            plain = bounded.nearest(space.x, sample.best_kmeans(min(k, len(space.x)), 20, seed)[0])
        for method, lab in (("seeded", space.cluster), ("k-means", plain)):
            out.append({"seed": seed, "method": method} | bounded.agreement(lab, space.profile) | bounded.tree_scores(space.flags, lab, seed))
    return spark.createDataFrame(pd.DataFrame(out))


CONTEXT_METRICS = ["weighted_purity", "macro_purity", "weighted_entropy", "nmi", "ami", "pure_clusters", "tree_accuracy", "tree_balanced_accuracy", "tree_macro_f1"]


def contextual_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of every metric, and of the seed as surveyed, by method."""
    return compare.repeat_summary(Stage(spark).put(context_runs(spark, d)), "method", ["seed", *CONTEXT_METRICS])


def contextual_improvements(spark: SparkSession, d: str) -> DataFrame:
    """(metric, new, old, improvement_pct, wins): the pipeline's labels against k-means."""
    means = Stage(spark).put(context_runs(spark, d)).groupBy("method").agg(*[F.avg(m).alias(m) for m in CONTEXT_METRICS])
    long = means.unpivot("method", CONTEXT_METRICS, "metric", "value")
    pairs = long.groupBy("metric").pivot("method", ["seeded", "k-means"]).agg(F.first("value"))
    return compare.improvements(pairs.select("metric", F.col("seeded").alias("new"), F.col("k-means").alias("old"), (F.col("metric") != "weighted_entropy").alias("higher")))


def anchor_laplacian(spark: SparkSession, d: str, rows: int = ANCHOR_FIT, anchors: int = 2_048, k: int = 15) -> DataFrame:
    """(feature, laplacian_score, rank): how well each feature keeps to the graph of the sample's anchors."""
    space = Space(feature_frame(spark, d, Stage(spark)), rows)
    edges, values = graph.anchor_graph(spark, space.x, min(anchors, max(2, len(space.x) // 4)), k)
    names = spark.createDataFrame(list(enumerate(AMOUNTS + COUNTS + FLAGS)), "dim int, feature string")
    scored = graph.laplacian_scores(edges, values).join(F.broadcast(names), "dim")
    from pyspark.sql import Window as W

    return scored.select("feature", "laplacian_score", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("laplacian_score"), "feature")).alias("rank"))  # a row per feature


QUERIES = {f.__name__: f for f in (metric_search, metric_applied, candidate_search, method_comparison, comparison_winners, ablation, ablation_deltas, contextual_comparison, contextual_improvements, anchor_laplacian)}
