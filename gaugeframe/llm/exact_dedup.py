"""Exact duplicates by a content sort: splitters, external sort, comparison of neighbours.

Rows are range-partitioned on the head of their bytes and their digest by sampled splitters; the sort
puts equal bytes next to each other, and windows over the full bytes compare neighbours. A text
that holds more than its share of the rows is first divided into chunks by a hash of the id, and
the heads of its chunks (a bounded number) are compared once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm.common import fresh
from gaugeframe.runtime import cut, tune

HEAD = 16
SHARES = 4


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest",
                     normalise: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row per input row.

    Texts are equal when their normalised bytes are; null counts as empty. The smallest (or largest)
    id of a group stays; a null id only stays where a group has no other. Of repeated rows with
    the kept id one stays. Other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = tune(docs.sparkSession)
    text_column = F.coalesce(normalise if normalise is not None else F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_column.cast("binary").alias("bytes"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("bytes", 256))).withColumn("head", F.substring("bytes", 1, HEAD))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = _hot(rows, parts)
    chunk = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("chunks"))).cast("int")
    dealt = rows.join(F.broadcast(hot), "digest", "left").withColumn("chunk", chunk)

    best = (F.max if keep == "largest" else F.min)("doc_id")
    order = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    equal = Window.partitionBy("head", "digest", "chunk", "bytes")
    ranged = dealt.repartitionByRange(parts, "head", "digest", "chunk")
    local = ranged.select(
        "doc_id", "digest", "chunk", F.col("chunks").isNotNull().alias("hot"),
        F.row_number().over(equal.orderBy(order)).alias("place"),
        best.over(equal).alias("local_id"), F.count(F.lit(1)).over(equal).alias("local_size"), "bytes")
    heads_only = F.when(F.col("hot") & (F.col("place") == 1), F.col("bytes")).alias("bytes")
    local = cut(local.select("doc_id", "digest", "chunk", "hot", "place", "local_id", "local_size", heads_only))

    merged = (local.filter("hot and place = 1").groupBy("digest", "bytes")
              .agg(best.alias("keep_id"), F.sum("local_size").alias("group_size"),
                   F.collect_list("chunk").alias("chunks"))
              .select("digest", F.explode("chunks").alias("chunk"), F.lit(True).alias("hot"), "keep_id", "group_size"))
    out = local.join(F.broadcast(merged), ["digest", "chunk", "hot"], "left")
    keep_id = F.when(F.col("hot"), F.col("keep_id")).otherwise(F.col("local_id"))
    kept = (F.col("place") == 1) & F.col("doc_id").eqNullSafe(keep_id)
    return out.select("doc_id", keep_id.alias("keep_id"),
                      F.coalesce("group_size", "local_size").alias("group_size"),
                      kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _hot(rows: DataFrame, parts: int) -> DataFrame:
    """digest, chunks of the texts with more than 1 / (SHARES * parts) of all rows; at most SHARES * parts rows."""
    share = max(8.0, rows.count() / (SHARES * parts))
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share)
    return counts.select("digest", F.ceil(F.col("n") / share).cast("int").alias("chunks"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without repeated texts; the smallest id of each text stays and columns stay as they are.

    Rows are told apart by id and text, so an id that occurs with two texts loses only the repeated one.
    """
    result = exact_duplicates(docs, doc_id, text)
    own, sha = fresh(docs, "__id"), fresh(docs, "__sha")
    lost = result.filter(~F.col("kept")).select(
        F.col("doc_id").alias(own), F.unhex("text_sha256").alias(sha),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("__same"))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    same = F.col(doc_id).eqNullSafe(F.col(own)) & (digest == F.col(sha))
    copies = lost.filter(~F.col("__same")).select(own, sha).distinct()
    left = docs.join(copies.hint("shuffle_hash"), same, "left_anti")
    repeats = lost.filter("__same").select(own, sha).distinct()
    if repeats.isEmpty():
        return left
    once = docs.join(repeats, same, "left_semi").dropDuplicates([doc_id, text])
    return left.join(repeats, same, "left_anti").unionByName(once)
