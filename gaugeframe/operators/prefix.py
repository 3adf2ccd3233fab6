"""Distributed running totals and row numbers.

A running total over a group is a window ordered inside the group. That is fine while every group
fits in a task. A group above ``gaugeframe.rowsPerBucket`` rows is cut into value buckets at fixed
boundaries; each bucket is summed alone and starts from the total of the buckets before it, so
no task ever holds a whole hot group. The boundaries are literals, so a recomputed
stage places every row in the same bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeframe.functions.scalar import hex_word
from gaugeframe.runtime import cut, rows_per_bucket

MAX_BUCKETS = 4096
SAMPLES_PER_BUCKET = 500
BUCKET = "__bucket"
HOT = "__hot"


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))


def value_boundaries(source: DataFrame, keys: Sequence[str], order: str, limit: int | None = None,
                     most: int = MAX_BUCKETS, repeats: bool = False) -> list[float]:
    """Inner bucket boundaries, empty when no group of the source is above the limit.

    Boundaries are quantiles over all rows, so a bucket holds about total / buckets rows whatever
    the groups look like, and no group can hold more than that in one bucket. They come from a
    sample of bounded size; it only decides where to cut, never what is counted. With ``repeats``
    a value that fills several buckets is listed as often.
    """
    limit = limit or rows_per_bucket(source.sparkSession)
    top = group_sizes(source, keys).agg(F.max("__rows"), F.sum("__rows")).first()
    largest, total = top[0] or 0, top[1] or 0
    if largest <= limit:
        return []
    buckets = bucket_count(total, limit, most)
    fraction = min(1.0, SAMPLES_PER_BUCKET * buckets / total)
    values = source.select(F.col(order).cast("double").alias("v")).sample(fraction, seed=17)
    points = [i / buckets for i in range(1, buckets)]
    found = sorted(values.approxQuantile("v", points, 1 / (8 * buckets)))
    return found if repeats else sorted(set(found))


def bucket_count(rows: int, limit: int, most: int = MAX_BUCKETS) -> int:
    return max(2, min(most, math.ceil(rows / limit)))


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str],
                   source: DataFrame | None = None, bounds: list[float] | None = None) -> DataFrame:
    """Add ``<name>_before`` (total of the rows ordered before) and ``<name>_total`` per group.

    Rows must be unique in ``keys + order``. ``order[0]`` is numeric and carries the buckets;
    ``source`` is a cheaper frame with the same keys and order column for sizing the groups;
    ``bounds`` without a source apply to every group. Keys must not be NULL.
    """
    keys, order, sums = list(keys), list(order), list(sums)
    every_group = bounds is not None and source is None
    source = df if source is None else source
    if bounds is None:
        bounds = value_boundaries(source, keys, order[0])
    if not bounds:
        part = Window.partitionBy(*(keys or [F.lit(0)]))
        before = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums],
                         *[F.sum(s).over(part).alias(f"{s}_total") for s in sums])

    hot_flag = F.lit(True)
    if keys and not every_group:
        limit = rows_per_bucket(df.sparkSession)
        hot = group_sizes(source, keys).filter(F.col("__rows") > limit).select(*keys, F.lit(True).alias(HOT))
        df = df.join(hot, keys, "left")
        hot_flag = F.coalesce(F.col(HOT), F.lit(False))
    splits = [-math.inf, *bounds, math.inf]
    slotted = Bucketizer(splits=splits, inputCol="__order", outputCol="__slot").transform(
        df.withColumn("__order", F.col(order[0]).cast("double")))
    bucketed = slotted.withColumn(BUCKET, F.when(hot_flag, F.col("__slot").cast("int")).otherwise(F.lit(0)))
    bucketed = bucketed.drop("__order", "__slot", HOT)

    cells = bucketed.groupBy(*keys, BUCKET).agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    part = Window.partitionBy(*(keys or [F.lit(0)]))   # at most MAX_BUCKETS rows per group
    earlier = part.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *keys, BUCKET,
        *[F.coalesce(F.sum(f"__{s}").over(earlier), F.lit(0)).alias(f"__{s}_offset") for s in sums],
        *[F.sum(f"__{s}").over(part).alias(f"{s}_total") for s in sums])
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"__{s}_inside") for s in sums])
    joined = local.join(offsets, [*keys, BUCKET])
    return joined.select(
        *df.drop(HOT).columns,
        *[(F.col(f"__{s}_inside") + F.col(f"__{s}_offset")).alias(f"{s}_before") for s in sums],
        *[F.col(f"{s}_total") for s in sums])


def hash_index(df: DataFrame, keys: Sequence[str], digest: Column, tie: Sequence[str],
               name: str = "idx", total: str = "n") -> DataFrame:
    """Number the rows of each group from 0 in the order of a digest, with the group size.

    The digest words are uniform over 32 bits, so bucket boundaries need no look at the values.
    """
    base = df.withColumn("__h", hex_word(digest).cast("double")).withColumn("__one", F.lit(1).cast("bigint"))
    keyed = df.select(*keys)
    limit = rows_per_bucket(df.sparkSession)
    top = group_sizes(keyed, keys).agg(F.max("__rows"), F.sum("__rows")).first()
    bounds = []
    if (top[0] or 0) > limit:
        buckets = bucket_count(top[1], limit)
        bounds = [4294967296.0 * i / buckets for i in range(1, buckets)]
    out = running_totals(base, keys, ["__h", *tie], ["__one"], source=keyed, bounds=bounds)
    return (out.withColumnRenamed("__one_before", name).withColumnRenamed("__one_total", total)
            .drop("__h", "__one"))


def ordered_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                  name: str = "idx", total: str = "n") -> DataFrame:
    """Number the rows of each group from 0 in any sort order.

    Rows are range-partitioned over the whole (keys, order) sequence and written once, so the
    range a row falls in is data and survives a lost executor.
    """
    keys = list(keys)
    ranges = cut(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = part.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranges.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__rows"))
               .select(*keys, "__range", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__offset"),
                       F.sum("__rows").over(part).alias(total)))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order)
    numbered = ranges.withColumn("__inside", F.row_number().over(inside) - 1)
    return (numbered.join(offsets, [*keys, "__range"])
            .withColumn(name, (F.col("__inside") + F.col("__offset")).cast("bigint"))
            .drop("__range", "__inside", "__offset"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float],
                    lower: Sequence[str] = (), source: DataFrame | None = None,
                    bounds: list[float] | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group, from the two order statistics around each rank.

    NULLs are left out. Columns named in ``lower`` take the lower order statistic instead of interpolating. A cheap
    frame that contains these rows may be given as ``source`` for sizing the groups; the caller
    passes ``bounds=[]`` when the group size is known to be small.
    """
    keys = list(keys)
    clean = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    hist = clean.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    sizing = clean if source is None else source.select(*keys, F.col(value).cast("double").alias("__v"))
    ranked = running_totals(hist, keys, ["__v"], ["__n"], source=sizing, bounds=bounds)
    first, last = F.col("__n_before"), F.col("__n_before") + F.col("__n") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (last >= rank), F.col("__v")))

    picks = []
    for name, q in points.items():
        position = F.lit(q) * (F.col("__n_total") - 1)
        low = F.floor(position)
        high = F.least(low + 1, F.col("__n_total") - 1)
        picks += [at(low).alias(f"__{name}_lo"), at(high).alias(f"__{name}_hi"), F.max(position - low).alias(f"__{name}_w")]
    wide = ranked.groupBy(*keys).agg(F.max("__n_total").alias("n"), *picks)
    return wide.select(*keys, "n", *[
        (F.col(f"__{name}_lo") if name in lower else
         F.col(f"__{name}_lo") + (F.col(f"__{name}_hi") - F.col(f"__{name}_lo")) * F.col(f"__{name}_w")).alias(name)
        for name in points])
