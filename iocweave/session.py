"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What the plans rely on. All are run-time settings; the number of shuffle partitions is left to the cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Digests in hexadecimal, of which these tables are full, stay as long as they are under the default codec.
    "spark.sql.parquet.compression.codec": "zstd",
    # Of a JSON key that occurs twice the last value counts; otherwise the whole text would be refused.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# How much one task takes. A scan is otherwise cut by the cores of the cluster, so that what a task sorts or aggregates
# before an exchange grows with the input; and an exchange has the same number of parts at any size.
TASK_SETTINGS = {
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "480",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def bound_tasks(spark: SparkSession) -> SparkSession:
    """Tasks of a bounded size, however large the tables are."""
    for key, value in TASK_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_local_roots: dict[str, str] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder of the cluster.

    Only a local session without that setting gets a temporary folder of the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _local_roots.setdefault(app, "") or tempfile.mkdtemp(prefix="run-")
        _local_roots[app] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """``DataFrame.checkpoint`` needs a folder; point it into the shared one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(spark, "checkpoint"))


def spread(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Deal rows to ``parts`` tasks before heavy row-wise work; without it they stay as the scan splits them."""
    return df if parts is None else df.repartition(parts, key)
