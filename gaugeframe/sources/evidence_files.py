"""Manifests, saved predictions, score spools and metric evidence as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.operators.integrity import frame_digest
from gaugeframe.schemas import EVALUATION


def read_predictions(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Saved evaluation documents flattened to one row per prediction."""
    documents = spark.read.schema(EVALUATION).json(path, multiLine=multi_line)
    return documents.select("checkpoint_sha256", "threshold", F.explode("predictions").alias("p")).select(
        "checkpoint_sha256", "threshold", "p.*")


def write_predictions(predictions: DataFrame, path: str, rows_per_document: int = 1000) -> None:
    """Evaluation documents of a bounded number of predictions each, as JSON lines."""
    keys = ["checkpoint_sha256", "threshold"]
    fields = [c for c in predictions.columns if c not in keys]
    sizes = predictions.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_document).alias("__parts"))
    chunk = F.pmod(F.xxhash64(*fields), F.col("__parts"))
    documents = (predictions.join(sizes, keys).groupBy(*keys, chunk.alias("__chunk"))
                 .agg(F.count(F.lit(1)).alias("images"), F.collect_list(F.struct(*fields)).alias("predictions")))
    documents.drop("__chunk").write.mode("errorifexists").json(path)


def write_manifest(records: DataFrame, path: str) -> DataFrame:
    """Persist the splits once. The same record set may be declared again; a different one is refused."""
    spark = records.sparkSession
    names = sorted(records.columns)
    try:
        existing = spark.read.schema(records.schema).parquet(path)
        present = existing.limit(1).count() > 0
    except AnalysisException:
        present = False
    if not present:
        records.write.mode("errorifexists").partitionBy("split").parquet(path)
        return read_manifest(spark, path, records)
    old, new = (frame_digest(f.select(*names), names).first()["digest"] for f in (existing, records))
    if old != new:
        raise ValueError(f"declared manifest differs: {path}")
    return existing


def read_manifest(spark: SparkSession, path: str, like: DataFrame, splits: Sequence[str] | None = None) -> DataFrame:
    """The named splits only, none for an empty list, all for None; the folders of the others are pruned and never opened."""
    manifest = spark.read.schema(like.schema).parquet(path)
    return manifest.filter(F.col("split").isin(*splits)) if splits is not None else manifest


def spool_scores(pixels: DataFrame, path: str) -> None:
    """Pixel scores at float precision, laid out by condition and label."""
    (pixels.select("condition", "label", F.col("score").cast("float").alias("score"))
     .write.mode("append").partitionBy("condition", "label").parquet(path))


def read_spool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("score float, condition string, label int").parquet(path)


def write_metrics(metrics: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Each wide metric row also as one JSON document, next to its keys."""
    metrics.select(*keys, F.to_json(F.struct(*metrics.columns), {"ignoreNullFields": "false"}).alias("document")).write.mode(
        "errorifexists").parquet(path)


def long_metrics(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [c for c in metrics.columns if c not in keys]
    return metrics.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        list(keys), names, "metric", "value")
