"""Operating-point counts, rates and intervals at a frozen threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.scalar import wilson
from gaugeframe.operators.prefix import exact_quantiles

# Declared area bins as (name, exclusive upper fraction).
AREA_BINS = (
    ("tiny_below_0.1_percent", 0.001),
    ("small_0.1_to_1_percent", 0.01),
    ("medium_1_to_5_percent", 0.05),
    ("large_at_least_5_percent", None),
)


def confusion_counts(threshold: Column) -> list[Column]:
    flagged = F.col("score") >= threshold
    return [F.count_if(flagged & (F.col("label") == 1)).alias("tp"), F.count_if(flagged & (F.col("label") == 0)).alias("fp"),
            F.count_if(~flagged & (F.col("label") == 0)).alias("tn"), F.count_if(~flagged & (F.col("label") == 1)).alias("fn")]


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
        "false_alarm_rate": F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")),
        "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))})


def confusion(df: DataFrame, threshold: Column, keys: Sequence[str] = ()) -> DataFrame:
    return with_rates(df.groupBy(*keys).agg(*confusion_counts(threshold)))


def with_intervals(rates: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return rates.withColumns({
        "recall_interval": wilson(tp, tp + fn), "false_alarm_interval": wilson(fp, fp + tn),
        "precision_interval": wilson(tp, tp + fp)})


def normal_threshold(df: DataFrame, q: float, keys: Sequence[str] = (), source: DataFrame | None = None) -> DataFrame:
    """Linear quantile of the normal scores, how many reach it, and their population deviation."""
    keys = list(keys)
    normals = df.filter(F.col("label") == 0)
    cut = exact_quantiles(normals, keys, "score", {"threshold": q}, source=source).withColumnRenamed("n", "normal_count")
    spread = [F.count_if(F.col("score") >= F.col("threshold")).alias("exceedances"), F.stddev_pop("score").alias("score_std")]
    if keys:
        return normals.join(cut, keys).groupBy(*keys, "threshold", "normal_count").agg(*spread)
    whole = normals.select("score", cut.select("threshold").scalar().alias("threshold"), cut.select("normal_count").scalar().alias("normal_count"))
    return whole.groupBy("threshold", "normal_count").agg(*spread)


def area_bin(fraction: Column) -> Column:
    ladder = None
    for name, upper in AREA_BINS:
        if upper is None:
            return ladder.otherwise(name)
        ladder = F.when(fraction < upper, name) if ladder is None else ladder.when(fraction < upper, name)


def area_groups(df: DataFrame, fraction: Column, threshold: Column) -> DataFrame:
    """Detection by defect area; declared bins without rows stay with NULL recall.

    A defect without a fraction, or with one outside [0, 1], is in no bin: such rows come last as 'invalid_fraction', where there are any.
    """
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(AREA_BINS)], "bin_order int, area_bin string")
    valid = F.coalesce(fraction.isNotNull() & ~F.isnan(fraction) & fraction.between(0, 1), F.lit(False))
    found = df.filter(F.col("label") == 1).groupBy(F.when(valid, area_bin(fraction)).otherwise("invalid_fraction").alias("area_bin")).agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("score") >= threshold).alias("detected"))
    filled = bins.join(found, "area_bin", "full").fillna(0, ["images", "detected"]).fillna(len(AREA_BINS), ["bin_order"])
    return filled.select(
        "bin_order", "area_bin", "images", "detected", (F.col("images") - F.col("detected")).alias("missed"),
        F.try_divide("detected", "images").alias("recall"), wilson(F.col("detected"), F.col("images")).alias("interval"))


def recall_by_group(df: DataFrame, threshold: Column, keys: Sequence[str]) -> DataFrame:
    return df.filter(F.col("label") == 1).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("score") >= threshold).alias("detected")
    ).withColumn("recall", F.try_divide("detected", "images"))


def stress_summary(conditions: DataFrame, threshold: Column, base: str = "original") -> DataFrame:
    """Each condition against the base condition of the same group; rows whose group lacks it are counted in ``without_base``."""
    clean = conditions.filter(F.col("condition") == base).select("group_id", F.col("score").alias("base_score"))
    paired = conditions.join(clean, "group_id", "left")
    now, was = F.col("score") >= threshold, F.col("base_score") >= threshold
    return with_rates(paired.groupBy("condition").agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("base_score").isNull()).alias("without_base"), F.count_if(now != was).alias("flips"),
        F.count_if(now & ~was).alias("accepted_to_flagged"), F.count_if(~now & was).alias("flagged_to_accepted"),
        F.avg(F.abs(F.col("score") - F.col("base_score"))).alias("mean_abs_change"), *confusion_counts(threshold)))
