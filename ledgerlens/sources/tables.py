"""Parquet, CSV, JSON and text sources and sinks, and tables staged between jobs."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where that is unset (tests, local mode)."""
    found = spark.conf.get(CHECKPOINT_CONF, None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Stage:
    """Tables written to the shared folder to cut lineage; they outlive a lost executor.

    ``drop`` removes a table early; whatever is left goes when the driver exits, because a
    returned DataFrame may still read it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        self.written = 0
        atexit.register(self.close)

    def put(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and returns the written table; its path is in ``path_of``."""
        path = f"{self.root}/{self.written}"
        self.written += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path  # for drop()
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_stage_path", None)
        if path:
            remove_path(self.spark, path)

    def close(self) -> None:
        try:
            remove_path(self.spark, self.root)
        except Exception:  # the session is gone; a local folder then stays in the system's temporary space
            pass


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of ``paths`` that exists; raises FileNotFoundError if none does."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return p
    raise FileNotFoundError(", ".join(paths))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    out = df.write.mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header under an explicit schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header. For report-sized frames; the number of files is that of the frame's partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """One JSON object, as a one-line text file."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


#: The typed result tables of the validation store.
RESULT_SCHEMAS = {
    "bootstrap_results": "metric string, mean double, ci_low double, ci_high double, n_iterations int, run_ts timestamp",
    "permutation_test": "observed double, null_mean double, null_std double, p_value double, n_permutations int, run_ts timestamp",
    "comparison_results": "method string, n_clusters int, silhouette double, davies_bouldin double, calinski_harabasz double, run_ts timestamp",
    "ablation_results": "condition string, silhouette double, davies_bouldin double, calinski_harabasz double, anomaly_rate double, run_ts timestamp",
}


class ResultStore:
    """Append-only Parquet store of validation results; every row is stamped with ``run_ts``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, name: str, rows: DataFrame) -> None:
        schema = T._parse_datatype_string(RESULT_SCHEMAS[name])
        stamped = rows.withColumn("run_ts", F.current_timestamp())
        stamped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(RESULT_SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def clear(self, name: str) -> None:
        remove_path(self.spark, f"{self.root}/{name}")
