"""File trees as tables of parsed paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_tree(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """One row per file below ``root``, parsed from category/split/defect/stem; content is not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
             .load(root).select("path", F.col("length").alias("size_bytes")))
    return parse_paths(files)


def parse_paths(files: DataFrame) -> DataFrame:
    parts = F.split(F.col("path"), "/")
    stem = F.regexp_extract(F.element_at(parts, -1), r"^(.*)\.[^.]+$", 1)
    return files.select(
        "path", "size_bytes", F.try_element_at(parts, F.lit(-4)).alias("category"), F.try_element_at(parts, F.lit(-3)).alias("split"),
        F.try_element_at(parts, F.lit(-2)).alias("defect"), stem.alias("stem"), partner_kind(stem).alias("kind"),
        F.regexp_replace(stem, r"(_GT|_mask)$", "").alias("record"))


def partner_kind(stem: Column) -> Column:
    return (F.when(stem.rlike(r"^\d+$"), "image").when(stem.rlike(r"(_GT|_mask)$"), "mask")
            .when(stem.rlike(r" \(copy\)$"), "copy").otherwise("other"))


def read_content(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """Path, size and content hash; the bytes stay on the executors."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
            .load(root).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash")))


def parse_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    u = F.col(url)
    return pages.withColumns({
        "host": F.regexp_extract(u, r"^https?://([^/]+)/", 1), "section": F.regexp_extract(u, r"^https?://[^/]+/([^/?#]*)", 1),
        "stem": F.regexp_extract(u, r"^https?://[^/]+/[^/]+/(\d+)", 1)})
