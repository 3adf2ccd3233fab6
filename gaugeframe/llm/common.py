"""Helpers shared by the corpus operators: batch limits, word splitting, joins that keep rows whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.scalar import draw, unit

# One Arrow batch holds whole texts, so its size is bounded by bytes where Spark can, and by rows.
BATCH_ROWS = "2000"
BATCH_BYTES = str(16 * 1024 * 1024)


def bounded_batches(spark: SparkSession) -> None:
    """Keep batches of whole texts small; a caller's own smaller setting stays."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= int(BATCH_ROWS):
        spark.conf.set(rows, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def raw_text(text: str = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))


def per_batch(frame: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int | None = None) -> DataFrame:
    """Apply ``make()``, built once per task, to every Arrow batch of the frame, or to slices of at most ``rows`` rows of it."""
    bounded_batches(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows or batch.num_rows or 1):
                yield work(batch.slice(start, rows))

    return frame.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int, seed: str) -> DataFrame:
    """place (a second hash of the id, in [0, 1)), label, raw: the texts of at most ``rows`` labelled ids, chosen by a hash of the id.

    Null ids and labels are left out. An id counts once, with its largest label and its smallest text, so the
    bound holds for rows too, however often an id occurs.
    """
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).alias("label"))
    chosen = (known.groupBy("__id").agg(F.max("label").alias("label")).orderBy(draw(seed, F.col("__id")), "__id").limit(rows)
              .withColumn("place", unit(draw(f"{seed} place", F.col("__id")))))
    texts = docs.select(F.col(doc_id).alias("__id"), raw_text(text).alias("raw")).join(F.broadcast(chosen), "__id")
    return texts.groupBy("__id", "label", "place").agg(F.min("raw").alias("raw")).select("place", "label", "raw")


def words_of(raw: bytes) -> list[bytes]:
    """Words between the bytes 20 and 09-0D, with A-Z lowered; bytes.split and bytes.lower know ASCII only."""
    return raw.lower().split()


def drop_rows(frame: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not listed; columns and their order stay."""
    return frame.join(dropped.select(F.col(key)), key, "left_anti").select(*[F.col(f"`{c}`") for c in frame.columns])


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name
