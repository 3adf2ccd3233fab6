"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_BUCKET = "gaugeframe.rowsPerBucket"
DEFAULT_ROWS_PER_BUCKET = 2_000_000

# Runtime re-planning does the work of splitting hot join partitions, so it must be on.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def rows_per_bucket(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_BUCKET, str(DEFAULT_ROWS_PER_BUCKET)))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where the session names none, one inside the warehouse.

    A warehouse on a local disk is only accepted when the executors share it, which is a local master.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("file:", "/")) and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{warehouse.rstrip('/')}/gaugeframe-scratch"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one written table."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
