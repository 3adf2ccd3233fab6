"""Decisions on arriving records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gaugeframe.functions.scalar import size_reason
from gaugeframe.runtime import cut


def read_arrivals(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def decide(arrivals: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Refuse by size, then by unknown category, then decide at the category's frozen threshold.

    ``thresholds`` is a static table of one row per category.
    """
    refused = size_reason(F.col("size_bytes"), F.col("width"), F.col("height"))
    joined = arrivals.join(thresholds.select("category", "threshold"), "category", "left")
    outcome = (F.when(refused.isNotNull(), F.concat(F.lit("refused: "), refused))
               .when(F.col("threshold").isNull(), "refused: category")
               .when(F.col("score") >= F.col("threshold"), "defective").otherwise("normal"))
    return joined.withColumn("outcome", outcome)


def first_only(arrivals: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """An existing result is never overwritten: later arrivals of a key within the delay are dropped."""
    return arrivals.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def drain(decisions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived to the sink and stop."""
    query = (decisions.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(path))
    query.awaitTermination()
    return query


def drain_once(decisions: DataFrame, key: str, time: str, delay: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the first decision of every key to ``folder``/decisions and every other row to ``folder``/refused, and stop.

    A key that has a decision keeps it for good, however late it comes again. A row older than the newest of the earlier batches
    less ``delay`` is refused as late, any other row of a decided key, or behind another row of its batch, as repeated; both are
    written with their reason, never dropped. A batch owns its partition of each table and looks only at the partitions
    of earlier ones, so a batch that is run again after a failure writes the same rows in the same place. Of the rows of one batch the earliest
    counts, then the smallest by all columns. The sink is read by key and the times by batch, so a batch costs one pass over the key column.
    """
    columns = decisions.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in decisions.schema)
    schemas = {"decisions": f"{kinds}, batch long", "refused": f"{kinds}, reason string, batch long", "clock": "latest timestamp, batch long"}

    def table(spark: SparkSession, name: str, batch: int) -> DataFrame:
        try:
            return spark.read.schema(schemas[name]).parquet(f"{folder}/{name}").filter(F.col("batch") < batch)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], schemas[name])

    def put(rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        latest = table(spark, "clock", batch).agg(F.max("latest")).first()[0]
        late = F.coalesce(F.col(time) < F.lit(latest) - F.expr(f"INTERVAL {delay}"), F.lit(False)) if latest else F.lit(False)
        known = table(spark, "decisions", batch).select(key).distinct().withColumn("__known", F.lit(True))
        marked = rows.withColumn("__late", late).join(known, key, "left")
        able = ~F.col("__late") & F.col("__known").isNull()
        order = F.struct(F.col(time).isNull(), F.col(time), *[F.col(c) for c in columns])
        first = marked.filter(able).groupBy(key).agg(F.min(order).alias("__first"))
        # Whole repeated rows are equal to the first; all but one of them are repeats.
        held = marked.groupBy(*columns, "__late", "__known").agg(F.count(F.lit(1)).alias("__times")).join(first, key, "left")
        held = cut(held.withColumn("__won", F.coalesce(able & (order == F.col("__first")), F.lit(False))))
        put(held.filter("__won").select(*columns), "decisions", batch)
        again = F.explode(F.sequence(F.lit(1), F.col("__times") - F.when(F.col("__won"), 1).otherwise(0)))
        reason = F.when(F.col("__late"), "late").otherwise("repeated")
        put(held.filter("__times > 1 OR NOT __won").withColumn("__copy", again).select(*columns, reason.alias("reason")), "refused", batch)
        put(held.agg(F.max(time).alias("latest")), "clock", batch)

    query = (decisions.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
