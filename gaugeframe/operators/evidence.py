"""Replaying reported numbers from what was saved. Results are violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.selection import decision


def close(a: Column, b: Column, relative: float = 1e-12, absolute: float = 1e-15) -> Column:
    near = F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return (a.isNull() & b.isNull()) | F.coalesce(near & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def differing_metrics(reported: DataFrame, recomputed: DataFrame, keys: Sequence[str], relative: float = 1e-12,
                      absolute: float = 1e-15) -> DataFrame:
    """Long tables (keys, metric, value): reported numbers that the predictions do not reproduce."""
    names = [*keys, "metric"]
    a = reported.select(*names, F.col("value").alias("reported"), F.lit(True).alias("in_report"))
    b = recomputed.select(*names, F.col("value").alias("recomputed"), F.lit(True).alias("in_replay"))
    joined = a.join(b, names, "full_outer")
    reason = (F.when(F.col("in_replay").isNull(), "unknown metric").when(F.col("in_report").isNull(), "not reported")
              .when(~close(F.col("reported"), F.col("recomputed"), relative, absolute), "differs"))
    return joined.select(*names, "reported", "recomputed", reason.alias("reason")).filter("reason IS NOT NULL")


def decision_violations(predictions: DataFrame, keys: Sequence[str], key: str) -> DataFrame:
    """Stored decisions that differ from score >= threshold, and runs with several thresholds."""
    wrong = predictions.filter(~F.col("predicted_defective").eqNullSafe(F.col("score") >= F.col("threshold"))).select(
        *keys, F.col(key).cast("string").alias("subject"), F.lit("decision").alias("reason"))
    several = predictions.groupBy(*keys).agg(F.min("threshold").alias("low"), F.max("threshold").alias("high")).filter("low <> high").select(
        *keys, F.lit(None).cast("string").alias("subject"), F.lit("several thresholds").alias("reason"))
    return wrong.unionByName(several)


def threshold_violations(stored: DataFrame, replayed: DataFrame, keys: Sequence[str], relative: float = 1e-12) -> DataFrame:
    joined = stored.select(*keys, F.col("threshold").alias("stored")).join(
        replayed.select(*keys, F.col("threshold").alias("replayed")), list(keys), "left")
    return joined.filter(~close(F.col("stored"), F.col("replayed"), relative))


def record_differences(declared: DataFrame, actual: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields changed, added or removed between a declared record and the actual one."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([key], list(fields), "field", name).withColumn(f"has_{name}", F.lit(True))
    joined = long(declared, "declared").join(long(actual, "actual"), [key, "field"], "full_outer")
    reason = (F.when(F.col("has_actual").isNull(), "removed").when(F.col("has_declared").isNull(), "added")
              .when(~F.col("declared").eqNullSafe(F.col("actual")), "changed"))
    return joined.select(key, "field", "declared", "actual", reason.alias("reason")).filter("reason IS NOT NULL")


def started_too_early(evaluations: DataFrame, freezes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Evaluations that start before the last selection of their study was frozen."""
    frozen = freezes.groupBy(*keys).agg(F.max("frozen_at").alias("frozen_at"))
    return evaluations.join(frozen, list(keys), "left").filter(
        F.col("frozen_at").isNull() | F.col("started_at").isNull() | (F.col("started_at") < F.col("frozen_at")))


def config_disagreements(runs: DataFrame, keys: Sequence[str], config: str, free: Sequence[str]) -> DataFrame:
    """Groups whose run configurations differ outside the named free fields."""
    fixed = F.map_filter(config, lambda k, _: ~k.isin(*free))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(fixed), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n")
    digests = runs.select(*keys, F.sha2(text, 256).alias("__digest")).groupBy(*keys).agg(
        F.min("__digest").alias("low"), F.max("__digest").alias("high"), F.count(F.lit(1)).alias("runs"))
    return digests.filter("low <> high").select(*keys, "runs")


def incomplete_runs(steps: DataFrame, run: str, state: Column) -> DataFrame:
    return steps.groupBy(run).agg(F.count(F.lit(1)).alias("steps"), F.count_if(~state).alias("open_steps")).filter("open_steps > 0")


def gallery_violations(stored: DataFrame, predictions: DataFrame, decisions: DataFrame, limit: int = 3, image: str = "image",
                       threshold: Column | None = None, digest: str | None = None) -> DataFrame:
    """Stored examples that are repeated or differ from the predictions, and groups of the wrong size.

    ``decisions`` holds (decision, available) counts. An image stored twice is a repeat, in whatever groups. With a threshold the
    group of every example is recomputed from its saved score and label; a missing one fails. With ``digest`` the named
    column of content digests must agree as well.
    """
    true = {"true_score": F.col("score"), "true_label": F.col("label")} | ({"true_digest": F.col(digest)} if digest else {})
    truth = predictions.select(image, *[c.alias(n) for n, c in true.items()])
    kept = [F.max("score").alias("score"), F.max("label").alias("label"), *([F.max(digest).alias("digest")] if digest else [])]
    rows = stored.groupBy(image, "decision").agg(*kept)
    times = stored.groupBy(image).agg(F.count(F.lit(1)).alias("rows"))
    checked = rows.join(times, image).join(truth, image, "left")
    reason = F.when(F.col("rows") > 1, "repeated").when(F.col("true_score").isNull(), "foreign")
    if threshold is not None:
        group = F.when(threshold.isNotNull() & F.col("true_label").isNotNull(), decision(F.col("true_score"), F.col("true_label"), threshold))
        reason = reason.when(~F.col("decision").eqNullSafe(group), "group")
    reason = reason.when(~close(F.col("score"), F.col("true_score")), "score").when(~F.col("label").eqNullSafe(F.col("true_label")), "label")
    if digest:
        reason = reason.when(~F.col("digest").eqNullSafe(F.col("true_digest")), "content")
    odd = checked.select("decision", F.col(image).cast("string").alias("subject"), reason.alias("reason")).filter("reason IS NOT NULL")
    sized = stored.groupBy("decision").agg(F.count_distinct(image).alias("kept"))
    sizes = decisions.join(sized, "decision", "left").filter(F.coalesce("kept", F.lit(0)) != F.least(F.lit(limit), F.col("available"))).select(
        "decision", F.lit(None).cast("string").alias("subject"), F.lit("group size").alias("reason"))
    return odd.unionByName(sizes)
